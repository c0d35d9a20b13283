"""Hard negatives by segment summaries.

Every vector is cut into segments, at LEVELS from coarse to fine, and for each segment its mean and deviation are stored. Over a
segment of m components two vectors' inner product lies within m * (product of means) plus or minus m * (product of
deviations), so that the sums over a level's segments bound the score. Pairs that a coarse level can't rule out go to the next
one, and those that the finest leaves are scored exactly.

Anchors are a stated query set that is held against all rows in cells: a block of anchors (at most about ANCHORS) and a block of
rows (ROWS). Positives meet the rows of their own label alone, so that a label that most rows have is many cells. A task
holds a cell's anchors and sees its rows in tiles; what it has found so far is a floor for the bounds. Each cell names its best
rows, and a ranking in Spark picks those of all cells.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows that repeat an id the one
with the smallest label and vector does. Only vectors of one length meet; empty ones score 0. Ties go to the smaller id.
Scores beyond 2**53 are computed in Python's integers and returned at the ends of a long's range if they are beyond it. An empty
table, or one without anchors, gives an empty result. Columns other than id, vector and label are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import join_salted, stored

#: Segments of each level.
LEVELS = (2, 8, 32)
#: Anchors and rows of a cell, anchors and rows held against each other at once.
ANCHORS, ROWS, TILE = 4096, 2048, 512
#: Whole numbers up to which sums of doubles are exact.
EXACT = 2**53
FOUND = "anchor_id long, ask_id long, row_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """id, label, dim and v (whole numbers as doubles) of the rows that take part."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    # NaN and infinities aren't below the largest double.
    finite = F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= 1.7976931348623157e308))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.when(finite, F.transform(x, lambda c: F.floor(c * scale).cast("double"))).alias("v"))
    once = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"))
    return once.select("id", "x.label", F.size("x.v").alias("dim"), "x.v")


def segments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, each times the root of its segment's size."""
    means, devs = [], []
    for level in LEVELS:
        for part in np.array_split(v, min(level, max(v.shape[1], 1)), axis=1):
            root = np.sqrt(max(part.shape[1], 1))
            means.append(part.mean(axis=1) * root if part.shape[1] else np.zeros(len(v)))
            devs.append(part.std(axis=1) * root if part.shape[1] else np.zeros(len(v)))
    return np.stack(means, axis=1), np.stack(devs, axis=1)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def summarised(rows: DataFrame) -> DataFrame:
    """rows of quantised with means and devs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                means, devs = segments(matrix(part.column(part.schema.get_field_index("v")), part.num_rows) if dim else np.zeros((part.num_rows, 0)))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (means, devs)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, "means", "devs"])

    return rows.mapInArrow(run, rows.select("*", F.array().cast("array<double>").alias("means"), F.array().cast("array<double>").alias("devs")).schema)


def in_cells(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Both tables dealt to cells (keys, ab, rb), and the names of a cell: an anchor goes to each block of rows of its keys, a row to
    each block of anchors."""
    blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).join(anchors.groupBy(*keys).agg(F.count("*").alias("na")), keys)
    sizes = stored(sizes.select(*keys, "__n", blocks("__n", ROWS).alias("rbs"), blocks("na", ANCHORS).alias("abs")), "cells")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = [*keys, "ab", "rb"]
    columns = dict.fromkeys([*cell, "is_row", "id", "label", "dim", "v", "means", "devs", "asks"])
    dealt = join_salted(rows, sizes, keys, ["id"]).withColumns({"ab": every("abs"), "rb": own("rbs"), "is_row": F.lit(True), "asks": F.lit(None).cast(anchors.schema["asks"].dataType)})
    held = join_salted(anchors, sizes, keys, ["id"]).withColumns({"ab": own("abs"), "rb": every("rbs"), "is_row": F.lit(False)})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*columns).unionByName(held.select(*columns)).repartition(parts, *cell).sortWithinPartitions(*cell, "is_row"), cell


class Part:
    """Rows of one cell as arrays."""

    def __init__(self, table: pa.RecordBatch | pa.Table):
        get, n = lambda c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c), table.num_rows
        self.ids, self.labels = get("id").to_numpy(zero_copy_only=False), np.array(get("label").to_pylist(), object)
        self.v, self.means, self.devs = (matrix(get(c), n) for c in ("v", "means", "devs"))
        self.most = np.abs(self.v).max(initial=0)
        self.norms = np.sqrt((self.v**2).sum(axis=1))


class Held:
    """Up to TILE anchors of a cell with what each asks for (the scores from low to high of rows of its own label or of others), and
    the best rows found so far for each ask."""

    def __init__(self, part: Part, asks: list[list[tuple[int, float, float]]], most: int, same: bool):
        self.part, self.asks, self.most, self.same, self.width = part, asks, most, same, max(map(len, asks))
        bound = lambda k, none: np.array([[float(a[k]) for a in row] + [none] * (self.width - len(row)) for row in asks])
        self.low, self.high = bound(1, np.inf), bound(2, -np.inf)
        self.floor = self.low.copy()
        self.score, self.row_ids, self.at, self.ask = (np.zeros(0, np.int64) for _ in range(4))

    def able(self, rows: Part, alive: np.ndarray) -> np.ndarray:
        """The pairs of alive that no level's bounds rule out."""
        slack, at = 1e-9 * self.part.norms[:, None] * rows.norms + 1e-6, 0
        for level in LEVELS if rows.v.shape[1] else ():
            k = slice(at, at + min(level, rows.v.shape[1]))
            at = k.stop
            middle, give = self.part.means[:, k] @ rows.means[:, k].T, self.part.devs[:, k] @ rows.devs[:, k].T + slack
            lower, upper, left = middle - give, middle + give, np.zeros_like(alive)
            for j in range(self.width):
                sure = np.where(alive & (upper <= self.high[:, j, None]), lower, -np.inf)
                if sure.shape[1] >= self.most:  # so many rows score at least that, and not too high
                    known = np.partition(sure, -self.most, axis=1)[:, -self.most]
                    self.floor[:, j] = np.where(known > self.floor[:, j], known, self.floor[:, j])
                left |= (upper >= self.floor[:, j, None]) & (lower <= self.high[:, j, None])
            alive = alive & left
        return alive

    def take(self, rows: Part) -> None:
        """Holds rows against the anchors."""
        mine = self.part
        alive = ((mine.labels[:, None] == rows.labels) == self.same) & (mine.ids[:, None] != rows.ids)
        if mine.most * rows.most * max(rows.v.shape[1], 1) < EXACT:
            alive = self.able(rows, alive)
            a, r = np.nonzero(alive)
            score = ((mine.v @ rows.v.T)[a, r] if 10 * len(a) > alive.size else np.einsum("ij,ij->i", mine.v[a], rows.v[r])).astype(np.int64)
            fits = [(score >= self.floor[a, j]) & (score <= self.high[a, j]) for j in range(self.width)]
        else:
            a, r = np.nonzero(alive)
            score = np.array([sum(int(x) * int(y) for x, y in zip(mine.v[i], rows.v[k], strict=True)) for i, k in zip(a, r, strict=True)] + [None], object)[:-1]
            fits = [np.array([j < len(self.asks[i]) and self.asks[i][j][1] <= s <= self.asks[i][j][2] for i, s in zip(a, score, strict=True)], bool) for j in range(self.width)]
        for j, fit in enumerate(fits):
            new = (score[fit], rows.ids[r[fit]], a[fit], np.full(np.count_nonzero(fit), j))
            self.score, self.row_ids, self.at, self.ask = (np.concatenate(x) for x in zip((self.score, self.row_ids, self.at, self.ask), new, strict=True))
        self.trim()

    def trim(self) -> None:
        """Keeps the best rows of each ask; where there are enough, the least of them is the ask's floor."""
        rank = np.unique(self.score, return_inverse=True)[1]
        order = np.lexsort((self.row_ids, -rank, self.ask, self.at))
        group = self.at[order] * self.width + self.ask[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        last, kept = order[place == self.most - 1], order[place < self.most]
        if self.score.dtype != object:
            self.floor[self.at[last], self.ask[last]] = np.maximum(self.floor[self.at[last], self.ask[last]], self.score[last])
        self.score, self.row_ids, self.at, self.ask = self.score[kept], self.row_ids[kept], self.at[kept], self.ask[kept]

    def found(self) -> pa.RecordBatch:
        scores = [min(max(int(s), -(2**63)), 2**63 - 1) for s in self.score]
        asked = [self.asks[i][j][0] for i, j in zip(self.at, self.ask, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(self.part.ids[self.at]), pa.array(asked, pa.int64()), pa.array(self.row_ids), pa.array(scores, pa.int64())], names=["anchor_id", "ask_id", "row_id", "score"])


def best(rows: DataFrame, anchors: DataFrame, keys: list[str], most: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """anchor_id, ask_id, row_id and score of the `most` best rows for each ask of each anchor, with their rank.

    anchors: rows with asks, an array of (id, score): wanted are scores from low to high percent of it. A null array asks once, for
    any score.
    """
    dealt, cell = in_cells(rows, anchors, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], []

        def hold() -> None:  # the anchors of a cell that came in one or more batches
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            for at in range(0, table.num_rows, TILE):
                part = table.slice(at, TILE)
                asks = [[(x["id"], -(-low * x["score"] // 100), high * x["score"] // 100) for x in row] if row is not None else [(0, float("-inf"), float("inf"))] for row in part.column("asks").to_pylist()]
                held.append(Held(Part(part), asks, most, same))

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in (*cell, "is_row")), strict=True))
            starts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(marks)], strict=True):
                if marks[a][:-1] != now:
                    yield from (h.found() for h in held)
                    now, held = marks[a][:-1], []
                    waiting.clear()
                if not marks[a][-1]:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if waiting:
                    hold()
                for at in range(a, b, ROWS) if held else ():
                    part = Part(batch.slice(at, min(ROWS, b - at)))
                    for h in held:
                        h.take(part)
        yield from (h.found() for h in held)

    rank = F.row_number().over(Window.partitionBy("anchor_id", "ask_id").orderBy(F.desc("score"), "row_id"))
    return dealt.mapInArrow(run, FOUND).withColumn("rank", rank).where(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor among rows (of quantised) and each of its first positives, the first negatives: rows of other labels whose score
    is from low to high percent of the positive's. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = stored(summarised(rows), "vectors")
    asks = "array<struct<id: long, score: long>>"
    anchors = rows.where(is_anchor)
    near = stored(best(rows, anchors.withColumn("asks", F.lit(None).cast(asks)), ["dim", "label"], positives, True), "positives")
    asked = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("row_id").alias("id"), "score")).cast(asks).alias("asks"))  # at most positives
    found = best(rows, anchors.join(asked, "id"), ["dim"], negatives, False, low, high)
    scores = near.select("anchor_id", F.col("row_id").alias("ask_id"), F.col("score").alias("positive_score"))
    out = found.join(scores, ["anchor_id", "ask_id"])
    return out.select("anchor_id", F.col("ask_id").alias("positive_id"), "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def noisy_label(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """Every seventh row has the next label."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))


def negatives(embeddings: DataFrame) -> DataFrame:
    return mine(quantised(embeddings, "vec_id", "embedding", noisy_label()), F.col("id") % 100 == 0)


ORACLE = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score QUALIFY rank <= 10"""
