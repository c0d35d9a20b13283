"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one blank, and their n-grams of one to three code points are hashed to
BUCKETS. Document frequencies count all documents that may be learnt from. Weights are learnt by follow-the-regularised-leader
(FTRL-proximal) with an elastic net: the L1 part leaves most of them zero, the L2 part shrinks the rest. Rounds of training
run in SHARDS tasks at once; each goes on from the mean of all shards' states. A temperature, fitted on texts that
no weight was learnt from, makes the probabilities honest.

Learning reads about PER_LANGUAGE distinct texts of each language, those whose hashes are smallest (one in CALIBRATION of
them for the temperature): a documented bound, which holds one common text and one common language in check. Document
frequencies and predictions cover all documents, and whole texts.

Cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing can be learnt from. Rows of a null
id are not held out and not learnt from. Repeated rows are predicted alike, and learnt from once. Very long texts cost a few
bytes for each code point. An empty table gives an empty result. Columns other than the id and the text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import stored

UND = "und"
BITS = 16
BUCKETS, ORDERS = 1 << BITS, (1, 2, 3)
#: Texts of a language that are learnt from at most, and one in how many of these the temperature is fitted on.
PER_LANGUAGE, CALIBRATION = 1500, 5
SHARDS, ROUNDS = 8, 3
#: FTRL: learning rate and its offset, elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.01
#: Code points that are hashed at once.
PIECE = 1 << 20
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once in each worker."""
    if not LETTERS:
        LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return LETTERS[0]


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters, with a single blank for whatever stands between them and at both ends."""
    got = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = letters()[got]
    cleaned = np.concatenate([[np.uint32(32)], np.where(kept, got, np.uint32(32)), [np.uint32(32)]]).astype(np.uint32)
    blank = cleaned == 32
    return cleaned[~(blank & np.concatenate([[False], blank[:-1]]))]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and how often each occurs."""
    chars, total = code_points(text), None
    for at in range(0, len(chars), PIECE):
        part = chars[at : at + PIECE + max(ORDERS) - 1]
        hashes = []
        for n in ORDERS:
            starts = min(PIECE, len(part) - n + 1)
            if starts > 0:
                mixed = np.full(starts, n, np.uint32)
                for k in range(n):
                    mixed = (mixed ^ part[k : k + starts]) * FACTORS[k]
                    mixed ^= mixed >> np.uint32(15)
                hashes.append(((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int64))
        every = np.concatenate(hashes)
        if total is None and len(chars) < 4000:
            return np.unique(every, return_counts=True)
        counts = np.bincount(every, minlength=BUCKETS)
        total = counts if total is None else total + counts
    found = np.flatnonzero(total)
    return found, total[found]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of a text, of length 1 in all."""
    found, counts = grams(text)
    values = (1 + np.log(counts)) * idf[found]
    return found, values / max(np.sqrt(values @ values), 1e-12)


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """text and lang of the documents that may be learnt from: those not held out that have a letter."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.where((F.crc32(F.col("id").cast("string")) % 5 != 0) & F.rlike("text", F.lit(r"\p{L}"))).select("text", "lang")


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket in how many texts it occurs, and how many texts there are. A task sends at most a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                held[grams(x.as_py())[0]] += 1
            held[BUCKETS] += batch.num_rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "texts"])

    summed = rows.select("text").mapInArrow(run, "bucket long, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in summed.collect():  # at most BUCKETS + 1 rows
        out[r["bucket"]] = r["texts"]
    return out[:BUCKETS], int(out[BUCKETS])


def sample(rows: DataFrame) -> DataFrame:
    """lang, text and h of about PER_LANGUAGE distinct texts of each language: those whose hashes h are smallest. Hashes alone are
    counted, and a language's share of them bounds h."""
    labelled = rows.where(F.col("lang").isNotNull()).withColumn("h", F.xxhash64("text"))
    counts = labelled.select("lang", "h").distinct().groupBy("lang").agg((PER_LANGUAGE / F.count("*")).alias("share"))
    part = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    return labelled.join(F.broadcast(stored(counts, "sample-shares")), "lang").where(part <= F.col("share")).dropDuplicates(["lang", "h"]).select("lang", "text", "h")  # a row per language


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket, language; and a row of biases at the end
    temperature: float


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def proximal(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that FTRL's state (z, n) stands for."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(state: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """One pass of FTRL over rows (language, buckets, values); state: z and n, changed in place."""
    z, n = state
    for y, found, values in rows:
        w = proximal(z[found], n[found])
        p = softmax(values @ w)
        p[y] -= 1
        g = values[:, None] * p
        z[found] += g - (np.sqrt(n[found] + g * g) - np.sqrt(n[found])) / ALPHA * w
        n[found] += g * g


def with_bias(found: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(found, BUCKETS), np.append(values, 1.0)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, from 0.01 to 100, by golden section on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    low, high, part = np.log(0.01), np.log(100.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model of all labelled documents that aren't held out; None if there are none."""
    rows = learnable(docs, id_col, text_col, lang_col)
    texts, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + texts)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [with_bias(*weighted(x.as_py(), idf)) for x in batch.column(1)]
            lists = [pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["lang", "h", "found", "values"])

    vectors = stored(sample(rows).mapInArrow(run, "lang string, h long, found array<int>, values array<float>"), "vectors")
    languages = sorted(r[0] for r in vectors.select("lang").distinct().collect())
    if not languages:
        return None
    place = {x: i for i, x in enumerate(languages)}
    aside = F.pmod("h", F.lit(CALIBRATION)) == 0
    shards = vectors.where(~aside).withColumn("shard", F.pmod(F.xxhash64("h", "lang"), F.lit(SHARDS)).cast("int"))
    state = np.zeros((2, BUCKETS + 1, len(languages)))

    def train(table: pa.Table) -> pa.Table:
        table, mine = table.sort_by([("h", "ascending"), ("lang", "ascending")]), state.copy()
        learn(mine, [(place[y.as_py()], f.values.to_numpy(), v.values.to_numpy().astype(float)) for y, f, v in zip(table["lang"], table["found"], table["values"], strict=True)])
        return pa.table({"change": pa.array([(mine - state).astype("<f8").tobytes()], pa.binary())})

    for _ in range(ROUNDS):
        changes = shards.groupBy("shard").applyInArrow(train, "change binary").collect()  # SHARDS rows, a number for each bucket and language
        state = state + sum((np.frombuffer(r[0], "<f8").reshape(state.shape) for r in changes), np.zeros_like(state)) / SHARDS
    weights = proximal(state[0], state[1])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = [v.values.to_numpy() @ weights[f.values.to_numpy()] for f, v in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits, pa.list_(pa.float64()))], names=["lang", "logits"])

    tried = vectors.where(aside).select("lang", "found", "values").mapInArrow(judge, "lang string, logits array<double>").collect()
    temperature = best_temperature(np.array([r["logits"] for r in tried]), np.array([place[r["lang"]] for r in tried])) if tried else 1.0
    return Model(languages, idf, weights, temperature)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = letters()
        for batch in batches:
            names, scores = [], []
            for x in batch.column(2):
                text = x.as_py()
                if model is None or not text or not known[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
                    names.append(UND)
                    scores.append(0.0)
                    continue
                found, values = with_bias(*weighted(text, model.idf))
                p = softmax(values @ model.weights[found] / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    held: Column = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col), held, F.col(text_col))
    return rows.mapInArrow(run, rows.select(F.col(id_col), "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def predictions(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
