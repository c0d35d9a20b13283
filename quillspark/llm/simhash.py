"""SimHash near-dedup with vantage-point trees.

Every text gets a 64-bit SimHash of its word shingles. Distinct fingerprints are dealt to shards by a vantage-point tree:
at each node those within the node's radius of its vantage point go to one side, the rest to the other. A fingerprint
lives in one shard; by the triangle bounds it is also sent to the shards that can hold a neighbour, that is, at each node
to the far side when its distance is within the search radius of the boundary. Inside a shard the tree goes on until few
fingerprints are left, which are compared outright, so that no pair within the radius is lost. Each shard returns a
spanning forest of the links it saw, not all pairs; components come from alternating large-star and small-star rounds.

The upper tree is fitted on at most SAMPLE fingerprints (those with the smallest hashes) and only decides where rows
go: results do not depend on it. Cases: a null or wordless text has fingerprint 0 and links like any other; equal texts
share a fingerprint, so repeated rows cost nothing; null ids are kept, and count as larger than all others; an empty
table gives an empty result. Other columns pass through; fingerprint and component_id replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import stored

RADIUS, SHINGLE = 3, 3
#: Fingerprints that the upper tree is fitted on, and how many a shard is meant to hold.
SAMPLE, SHARD = 20_000, 30_000
#: Fingerprints that are compared outright rather than split further.
LEAF = 128


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    ws = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not ws:
        return 0
    if len(ws) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(ws), 42)
    grams = map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(ws) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with fingerprint, a long whose 64 bits are the SimHash."""
    fields = docs.drop("fingerprint").schema.fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint_of(x.as_py(), shingle) for x in batch.column(text_col)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*names, "fingerprint"])

    return docs.select(*names).mapInArrow(run, T.StructType([*fields, T.StructField("fingerprint", T.LongType())]))


def distance(prints: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ point)


def fit_tree(sample: np.ndarray, depth: int, seed: int = 7) -> list[tuple[int, int]]:
    """(vantage point, radius) of each node of a complete tree, the children of node i at 2i + 1 and 2i + 2.

    Of a few candidates that point is taken whose median distance leaves the fewest fingerprints at the boundary.
    """
    rng, nodes, members = np.random.default_rng(seed), [], [sample]
    for level in range(depth):
        below = []
        for part in members:
            best = (2.0, np.uint64(0), 32)
            for point in rng.choice(part, min(8, len(part)), replace=False) if len(part) else []:
                d = distance(part, point)
                radius = int(np.median(d))
                share = float(np.mean(np.abs(d.astype(int) - radius) <= RADIUS)) + abs(float(np.mean(d <= radius)) - 0.5)
                best = min(best, (share, point, radius))
            _, point, radius = best
            nodes.append((int(point), radius))
            near = distance(part, point) <= radius
            below += [part[near], part[~near]]
        members = below
    return nodes


def route(prints: np.ndarray, nodes: list[tuple[int, int]], depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into prints, shard, whether it lives there) for every shard that a fingerprint goes to."""
    index, node, home = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
    points, radii = np.array([p for p, _ in nodes], np.uint64), np.array([r for _, r in nodes], np.int64)
    for _ in range(depth):
        d = np.bitwise_count(prints[index] ^ points[node]).astype(np.int64)
        near, r = d <= radii[node], radii[node]
        to_near = np.where(home, near, d <= r + radius)
        # Of two neighbours on both sides of a boundary it is enough to send the near one across.
        to_far = np.where(home, ~near | (d > r - radius), d > r - radius)
        home_near, home_far = home & near, home & ~near
        index, node, home = (
            np.concatenate([index[to_near], index[to_far]]),
            np.concatenate([2 * node[to_near] + 1, 2 * node[to_far] + 2]),
            np.concatenate([home_near[to_near], home_far[to_far]]),
        )
    return index, node - (2**depth - 1), home


def leaf_labels(prints: np.ndarray, own: int, radius: int) -> np.ndarray:
    """For each of prints the smallest position that links within radius reach; only the first `own` are compared with all."""
    labels, step = np.arange(len(prints), dtype=np.int32), max(1, 1_000_000 // len(prints))
    far, todo = np.int32(len(prints)), range(0, own, step)
    while todo:
        before, linked = labels.copy(), []
        for i in todo:
            close = np.bitwise_count(prints[i : min(i + step, own), None] ^ prints[None, :]) <= radius
            if np.count_nonzero(close) > len(close):  # each is close to itself
                linked.append(i)
                low = np.where(close, labels[None, :], far).min(axis=1)
                labels = np.minimum(labels, np.where(close, low[:, None], far).min(axis=0))
        labels = labels[labels]
        todo = linked if not np.array_equal(labels, before) else []
    return labels


def links_inside(prints: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of positions that join all pairs within radius of which one lives here: each with the first of its leaf's group."""
    todo, found, rng = [(np.flatnonzero(home), np.flatnonzero(~home), 0)], [np.zeros((0, 2), np.int64)], np.random.default_rng(len(prints))
    while todo:
        own, guests, level = todo.pop()
        if len(own) > LEAF and level < 40:
            point = prints[own[rng.integers(len(own))]]
            d, g = distance(prints[own], point).astype(int), distance(prints[guests], point).astype(int)
            r = int(np.median(d))
            near = d <= r
            if not near.all():
                across = own[near & (d > r - radius)]
                todo += [(own[near], guests[g <= r + radius], level + 1), (own[~near], np.concatenate([guests[g > r - radius], across]), level + 1)]
                continue
        if len(own):
            everyone = np.concatenate([own, guests])
            first = everyone[leaf_labels(prints[everyone], len(own), radius)]
            found.append(np.stack([everyone, first], axis=1)[everyone != first])
    return np.concatenate(found)


def neighbour_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fingerprint) at most radius bits apart, enough to join all such pairs."""
    total = prints.count()
    depth = 0
    while total >> depth > SHARD:
        depth += 1
    sample = [r[0] for r in prints.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect()] if depth else []
    nodes = fit_tree(np.array(sample, np.int64).view(np.uint64), depth)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            index, shard, home = route(here, nodes, depth, radius)
            yield pa.RecordBatch.from_arrays([pa.array(here[index].view(np.int64)), pa.array(shard.astype(np.int32)), pa.array(home)], names=["fingerprint", "shard", "home"])

    def search(shard: pa.Table) -> pa.Table:
        here = shard.column("fingerprint").to_numpy().astype(np.int64).view(np.uint64)
        ends = links_inside(here, shard.column("home").to_numpy(zero_copy_only=False), radius)
        return pa.table({"a": here[ends[:, 0]].view(np.int64), "b": here[ends[:, 1]].view(np.int64)})

    sent = prints.select("fingerprint").mapInArrow(send, "fingerprint long, shard int, home boolean")
    return sent.groupBy("shard").applyInArrow(search, "a long, b long")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: the smallest node that links (a, b) reach, for each node that has a link.

    Large-star hangs each node's larger neighbours on its smallest one, small-star its smaller ones; both end when no
    link changes. Each round's links are a table in the shared folder.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    marks = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = stored(small.distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == marks:
            break
        marks = now
    else:
        raise RuntimeError(f"components had not settled after {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(printed: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """printed (with fingerprint) with component_id: the smallest id reachable over links of at most radius bits."""
    printed = printed.drop("component_id")
    prints = stored(printed.groupBy("fingerprint").agg(F.min(id_col).alias("__id")), "fingerprints")
    roots = components(neighbour_links(prints, radius))
    grouped = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select("fingerprint", "__id", F.coalesce("root", "fingerprint").alias("__root"))
    ids = grouped.groupBy("__root").agg(F.min("__id").alias("component_id"))
    named = grouped.join(ids, "__root").select("fingerprint", "component_id")
    return printed.join(named, "fingerprint")


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex and component_id of each document."""
    printed = stored(fingerprints(docs.select("doc_id", "text")).drop("text"), "simhashes")
    return near_duplicates(printed).select("doc_id", hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


# What near_copies makes of a text.


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; of fewer words the whole, of none none."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in ws), np.uint64, len(ws))
    size = min(shingle, len(ws))
    total = np.zeros(len(ws) - size + 1, np.uint64)
    for k in range(size):
        total = spread(total * np.uint64(0x9E3779B97F4A7C15) + each[k : len(ws) - size + 1 + k])
    return np.unique(total)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))
