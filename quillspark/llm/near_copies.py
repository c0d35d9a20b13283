"""Near copies: texts alike at a Jaccard similarity of 0.8 or more of their five-word shingles, and the groups they form.

Every text gets a 256-bit SimHash of its distinct shingles. The vantage-point tree of simhash, over its first 64 bits, links texts
at most simhash.RADIUS bits apart. Sets of similarity 0.8 differ in more bits, at which no triangle bound prunes, so that every text
also gets BANDS keys of ROWS MinHash values each; texts that share a key form a group. Inside a group fingerprints beyond RADIUS are put aside (a pair of similarity 0.8 differs in 39 bits, give or
take 6), as are sets whose sizes rule the similarity out; what is left is compared exactly. No task holds a group's shingles, but at most those of two blocks of its members.

Pairs come in two rounds. First each text meets what the tree links it to, and the nearest of a few hubs of its groups, which joins most of a large group of
copies at the price of one comparison a text: in groups over MANY the first hub is the member nearest to the majority of the
members' bits, as a text is whose copies were edited. Then every member outside the class of its group's first hub meets all other members of other
classes, in cells of two blocks of members, however large the group; inside a cell a vantage point and the triangle inequality
leave out what can't be within RADIUS. Links join into classes by star rounds. The first round is linear; the second one
grows with the members of a group that its first hub doesn't join, times the group, in tasks of bounded size.

A pair of similarity 0.8 shares no key with a chance of (1 - 0.8 ** ROWS) ** BANDS, under 0.0001, and lies beyond RADIUS with one
of about 0.0000001; nothing else is lost. Cases: null and wordless texts are equal to each other; equal texts count as one;
texts of fewer words are one shingle; a null id is larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import blank_trim, join_salted, stored
from quillspark.llm.simhash import components, neighbour_links, shingle_set, spread

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 18, 4
PRINTS, RADIUS = ("f0", "f1", "f2", "f3"), 70
#: Hubs of a group, members of a block, and members over which a group's middle is sought.
HUBS, BLOCK, MANY = 4, 512, 32
SEEDS = spread(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))
SIDES = spread(np.arange(1, len(PRINTS) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketch(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of a set of shingles, as 64-bit words, and its keys."""
    ones, least = np.zeros(64 * len(PRINTS), np.int64), np.full(len(SEEDS), ~np.uint64(0))
    for i in range(0, len(grams), 2048):
        part = grams[i : i + 2048]
        bits = np.unpackbits(spread(part[:, None] ^ SIDES).astype(">u8").view(np.uint8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        least = np.minimum(least, spread(part ^ SEEDS[:, None]).min(axis=1))
    prints = np.packbits(2 * ones > len(grams)).view(">u8").astype(np.uint64)
    keys, rows = np.zeros(BANDS, np.uint64), least.reshape(BANDS, ROWS)
    for r in range(ROWS):
        keys = spread(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return prints, keys if len(grams) else keys[:0]


def tag_of(text: Column) -> Column:
    """What texts are told apart by: the MD5 of a text; all without a word count as empty."""
    bare = F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.when(blank_trim(bare) == "", "").otherwise(bare)))


def sketches(rows: DataFrame) -> DataFrame:
    """id and tag of rows with n (distinct shingles), the fingerprint and the keys of text."""
    kinds = [("n", pa.int32(), T.IntegerType()), *((f, pa.int64(), T.LongType()) for f in PRINTS), ("keys", pa.list_(pa.int64()), T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                grams = shingle_set(x.as_py(), SHINGLE)
                prints, keys = sketch(grams)
                out.append((len(grams), *prints.view(np.int64).tolist(), keys.view(np.int64)))
            columns = [pa.array(c, t) for c, (_, t, _) in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for _, t, _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "tag", *(k for k, _, _ in kinds)])

    fields = rows.select("id", "tag").schema.fields
    return rows.select("id", "tag", "text").mapInArrow(run, T.StructType([*fields, *(T.StructField(k, t) for k, _, t in kinds)]))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """tag and its text's shingles, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                grams = pa.array([shingle_set(x.as_py(), SHINGLE).view(np.int64) for x in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), grams], names=["tag", "grams"])

    return rows.select("tag", "text").mapInArrow(run, "tag binary, grams array<long>")


def too_far(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can't be so similar."""
    return F.least(a, b) < similarity * F.greatest(a, b) - 1e-9


def nearest_hub(hubs: Column, similarity: float) -> Column:
    """(distance, tag) of the nearest hub that a row (tag, n, PRINTS) can be alike to; null for none."""
    distance = lambda h: sum((F.bit_count(h[f].bitwiseXOR(F.col(f))) for f in PRINTS), F.lit(0))
    able = F.filter(hubs, lambda h: (h["tag"] != F.col("tag")) & (distance(h) <= RADIUS) & ~too_far(h["n"], F.col("n"), similarity))
    return F.array_min(F.transform(able, lambda h: F.struct(distance(h).alias("d"), h["tag"].alias("tag"))))


def tree_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts (tag, n, PRINTS) that the vantage-point tree over f0 links and whose sizes allow the similarity. Texts of one
    fingerprint are paired with the first of them, and fingerprints with the first one of their leaf's group."""
    prints = stored(texts.groupBy(F.col("f0").alias("fingerprint")).agg(F.min(F.struct("tag", "n")).alias("own"), F.count("*").alias("__n")), "prints")
    same = join_salted(texts.select(F.col("f0").alias("fingerprint"), "tag", "n"), prints, ["fingerprint"], ["tag"]).select(F.struct("tag", "n").alias("x"), F.col("own").alias("y"))
    links = stored(neighbour_links(prints).distinct(), "tree-links")
    own = lambda side, name: prints.select(F.col("fingerprint").alias(side), F.col("own").alias(name))
    firsts = stored(own("b", "y").join(links.groupBy("b").agg(F.count("*").alias("__n")), "b"), "tree-firsts")
    near = join_salted(links, firsts, ["b"], ["a"]).join(own("a", "x"), "a").select("x", "y")
    pairs = same.unionByName(near).where((F.col("x.tag") != F.col("y.tag")) & ~too_far(F.col("x.n"), F.col("y.n"), similarity))
    return pairs.select(F.col("x.tag").alias("a"), F.col("y.tag").alias("b")).distinct()


def grouped(texts: DataFrame) -> DataFrame:
    """texts (tag, n, PRINTS, keys) once for each group of several that they are in: band, key and size. Of groups with the same
    members one counts."""
    rows = texts.select("tag", "n", *PRINTS, F.posexplode("keys").alias("band", "key"))
    same = [F.bit_xor(F.xxhash64("tag", F.lit(j))).alias(f"same{j}") for j in (1, 2)]
    groups = rows.groupBy("band", "key").agg(F.count("*").alias("__n"), *same).where("__n > 1")
    groups = stored(groups.dropDuplicates(["__n", "same1", "same2"]).select("band", "key", "__n", F.col("__n").alias("size")), "groups")
    return join_salted(rows, groups, ["band", "key"], ["tag"])


def with_hubs(members: DataFrame, similarity: float) -> DataFrame:
    """members with main (the group's first hub) and near (the nearest hub that they can be alike to)."""
    bits = range(64)
    ones = members.where(F.col("size") > MANY).groupBy("band", "key").agg(F.first("size").alias("__n"), *(F.sum(F.getbit("f0", F.lit(i))).alias(f"b{i}") for i in bits))
    middle = sum((F.when(2 * F.col(f"b{i}") > F.col("__n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in bits[1:]), F.when(2 * F.col("b0") > F.col("__n"), 1).otherwise(0).cast("long"))
    rows = join_salted(members, stored(ones.select("band", "key", "__n", middle.alias("middle")), "middles"), ["band", "key"], ["tag"], "left")
    hub = lambda off, j: F.min(F.struct(off.alias("off"), F.xxhash64("tag", F.lit(j)).alias("h"), "tag", "n", *PRINTS))
    off = F.coalesce(F.bit_count(F.col("f0").bitwiseXOR(F.col("middle"))), F.lit(0))
    hubs = F.array(hub(off, 0), *(hub(F.lit(0), j) for j in range(1, HUBS)))
    groups = stored(rows.groupBy("band", "key").agg(F.first("size").alias("__n"), hubs.alias("hubs")), "hubs")
    met = join_salted(members, groups, ["band", "key"], ["tag"])
    return met.select("band", "key", "size", "tag", "n", *PRINTS, F.get("hubs", 0)["tag"].alias("main"), nearest_hub(F.col("hubs"), similarity).alias("near"))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar. Each pair meets its two sets in two joins; a b of many pairs is dealt to parts."""
    first = pairs.join(sets.select(F.col("tag").alias("a"), F.col("grams").alias("ga")), "a")
    few = sets.join(pairs.groupBy(F.col("b").alias("tag")).agg(F.count("*").alias("__n")), "tag").select(F.col("tag").alias("b"), F.col("grams").alias("gb"), "__n")
    both = F.size(F.array_intersect("ga", "gb"))
    met = join_salted(first, stored(few, "second-sets"), ["b"], ["a"]).select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb")).alias("sum"))
    return met.where(F.col("both") >= similarity * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b")


def distances(prints: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ point).sum(axis=1, dtype=np.int64)


class Cell(NamedTuple):
    """Members of a group, some as hosts and some as guests: tags, sizes, fingerprints, classes and shingles."""

    tags: list[bytes]
    sizes: np.ndarray
    prints: np.ndarray
    roots: np.ndarray
    host: np.ndarray
    grams: list[np.ndarray]


def cell_links(cell: Cell, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links of guests to hosts of other classes, enough to join all pairs alike: what a link joins is not compared again.

    Hosts go in the order of their distance from a vantage point. The shingles of a guest are marked, and counted in all
    hosts left at once.
    """
    hosts, guests, found, roots = np.flatnonzero(cell.host), np.flatnonzero(~cell.host), [], cell.roots.copy()
    if not len(hosts) or not len(guests):
        return found
    point = cell.prints[guests[0]]
    from_point = distances(cell.prints[hosts], point)
    hosts = hosts[np.argsort(from_point, kind="stable")]
    from_point = np.sort(from_point)
    every, number = np.unique(np.concatenate(cell.grams), return_inverse=True)
    ends = np.cumsum(cell.sizes)
    marked = np.zeros(len(every), bool)
    for g, d in zip(guests.tolist(), distances(cell.prints[guests], point).tolist(), strict=True):
        able = hosts[np.searchsorted(from_point, d - RADIUS) : np.searchsorted(from_point, d + RADIUS, "right")]
        both = (cell.sizes[able] + cell.sizes[g]) * (similarity / (1 + similarity)) - 1e-9
        keep = (roots[able] != roots[g]) & (np.minimum(cell.sizes[able], cell.sizes[g]) >= both) & (distances(cell.prints[able], cell.prints[g]) <= RADIUS)
        able, both = able[keep], both[keep]
        if not len(able):
            continue
        mine = number[ends[g] - cell.sizes[g] : ends[g]]
        marked[mine] = True
        at = np.concatenate([number[ends[h] - cell.sizes[h] : ends[h]] for h in able])
        shared = np.add.reduceat(marked[at].astype(np.int64), np.cumsum(cell.sizes[able]) - cell.sizes[able])
        marked[mine] = False
        for h in able[shared >= both].tolist():
            if roots[h] != roots[g]:
                found.append((cell.tags[g], cell.tags[h]))
                roots[roots == roots[h]] = roots[g]
    return found


def left_links(members: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of members of one group but of different classes (node, root), enough to join all that are alike."""
    root = lambda c: classes.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rows = members.drop("near").join(root("tag"), "tag", "left").join(root("main"), "main", "left")
    rows = rows.withColumns({"root": F.coalesce("tag_root", "tag"), "outside": F.coalesce("tag_root", "tag") != F.coalesce("main_root", "main")})
    rows = stored(rows.drop("main", "tag_root", "main_root"), "members")
    groups = rows.where("outside").groupBy("band", "key").agg(F.count("*").alias("guests"), F.first("size").alias("__n"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    met = join_salted(rows, stored(groups, "open-groups"), ["band", "key"], ["tag"])
    met = met.withColumns({"hosts": blocks("size"), "guests": blocks("guests")})
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    own = lambda side, c: F.pmod(F.xxhash64("tag", F.lit(side)), F.col(c)).cast("int")
    keep = ["tag", "n", *PRINTS, "root"]
    as_host = met.select("band", "key", own(1, "hosts").alias("hb"), every("guests").alias("gb"), F.lit(True).alias("host"), *keep)
    as_guest = met.where("outside").select("band", "key", every("hosts").alias("hb"), own(2, "guests").alias("gb"), F.lit(False).alias("host"), *keep)
    cell = ["band", "key", "hb", "gb"]

    def search(table: pa.Table, out: list) -> None:
        prints = np.stack([table.column(f).to_numpy() for f in PRINTS], axis=1).view(np.uint64)
        roots = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        sizes = table.column("n").to_numpy().astype(np.int64)
        grams = [x.values.to_numpy() for x in table.column("grams")]
        out += cell_links(Cell(table.column("tag").to_pylist(), sizes, prints, roots, table.column("host").to_numpy(zero_copy_only=False), grams), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # rows of the cell that is not over yet
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cell], axis=1)
            starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            out: list = []
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if held and tuple(marks[a]) != last:
                    search(pa.concat_tables(held), out)
                    held = []
                held.append(table.slice(a, b - a))
                last = tuple(marks[a])
            yield from named(out)
        out = []
        if held:
            search(pa.concat_tables(held), out)
        yield from named(out)

    def named(out: list) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(out), 10_000):
            part = out[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.binary())], names=["a", "b"])

    every = as_host.unionByName(as_guest).join(sets, "tag")
    return every.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a binary, b binary").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id_col, tag, component_id (the smallest id reachable over texts at least so similar) and first: whether the row's id and text are
    those that stand for its class."""
    rows = docs.select(F.col(id_col).alias("id"), tag_of(F.col(text_col)).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = stored(sketches(rows), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n", *PRINTS, "keys")]
    texts = stored(sketched.groupBy("tag").agg(F.min("id").alias("id"), F.count("*").alias("__n"), *firsts), "texts")
    groups = stored(grouped(texts.drop("id", "__n")), "grouped")
    tree = stored(tree_pairs(texts, similarity), "tree-pairs")
    wanted = groups.select("tag").union(tree.select("a")).union(tree.select("b")).distinct().join(texts.select("tag", "id"), "tag").withColumnsRenamed({"tag": "__tag", "id": "__id"})
    chosen = rows.join(wanted, (F.col("tag") == F.col("__tag")) & F.col("id").eqNullSafe(F.col("__id")))
    sets = stored(shingle_sets(chosen).dropDuplicates(["tag"]), "shingle-sets")
    members = stored(with_hubs(groups, similarity), "members")
    hubs = members.where("near IS NOT NULL").groupBy(F.col("tag").alias("a")).agg(F.min("near")["tag"].alias("b"))
    tried = stored(tree.unionByName(hubs).distinct(), "first-pairs")
    links = stored(alike(tried, sets, similarity), "first-links")
    more = stored(left_links(members, components(links), sets, similarity), "left-links")
    roots = components(links.unionByName(more))
    named = texts.join(roots, F.col("tag") == F.col("node"), "left").select("tag", "id", "__n", F.coalesce("root", "tag").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first"))
    classes = stored(named.join(first, "root").select("tag", "first", "__n"), "classes")
    out = join_salted(sketched.select("id", "tag"), classes, ["tag"], ["id"])
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tag") == F.col("first.tag"))
    return out.select(F.col("id").alias(id_col), "tag", F.col("first.id").alias("component_id"), own.alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their class: of each group of near copies the smallest id's, and the rows that repeat it."""
    first = near_copies(docs, id_col, text_col, similarity).where("first").select(F.col(id_col).alias("__id"), F.col("tag").alias("__tag")).distinct()
    return docs.join(first, F.col(id_col).eqNullSafe(F.col("__id")) & (tag_of(F.col(text_col)) == F.col("__tag")), "left_semi")
