"""Pairs of adjacent words of letters, counted by document: by bucket, and by pair for buckets that are asked for.

Arrow tasks cut texts into words at white space and number the distinct ones, so that pairs are numbers until they are counted. A pair
counts once a document. What a task returns is bounded by buckets and languages, or holds the pairs of the buckets asked for alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets that the pairs of a language are counted in, texts that are cut at once, and languages whose buckets a task holds at once.
BUCKETS, TEXTS, LANGUAGES = 1 << 16, 500, 64
LETTERS = r"^\p{L}+$"


def word_hashes(words: pa.Array) -> np.ndarray:
    """Of the length of each word and its first and last 8 bytes: words that share them share buckets."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8))
    sizes = np.diff(ends)
    out = sizes.astype(np.uint64)
    for k in range(8):
        for at in (ends[:-1] + k, ends[1:] - 1 - k):
            out = out * np.uint64(0x100000001B3) + np.where(k < sizes, data[np.maximum(at, 0)], 0).astype(np.uint64)
    return out


def pairs_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The distinct pairs of each text as (text, left word, right word) with their buckets, and the words that the numbers stand for."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    fits = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    at = np.flatnonzero((row[1:] == row[:-1]) & fits[1:] & fits[:-1])
    n = max(len(words), 1)
    row, pair = np.divmod(pc.unique(pa.array((row[at] * n + code[at]) * n + code[at + 1])).to_numpy(), n * n)
    left, right = np.divmod(pair, n)
    hashes = word_hashes(words)
    mixed = (hashes[left] * np.uint64(0x9E3779B97F4A7C15) + hashes[right] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return row, left, right, (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS, words


def coded_languages(langs: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    coded = langs.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def bucket_totals(texts: DataFrame) -> DataFrame:
    """lang, bucket and total, the number of pairs in it, of texts (lang, text)."""

    def rows(held: dict[str | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                row, _, _, bucket, _ = pairs_of(part.column(1))
                lang, names = coded_languages(part.column(0))
                for k, name in enumerate(names):
                    held[name] = held.get(name, 0) + np.bincount(bucket[lang[row] == k], minlength=BUCKETS)
                if len(held) > LANGUAGES:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    made = texts.select("lang", "text").mapInArrow(run, "lang string, bucket int, total long")
    return made.groupBy("lang", "bucket").agg(F.sum("total").alias("total"))


def pair_counts(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """lang, phrase and docs of the pairs in the buckets (lang, bucket), at most BUCKETS numbers a language."""
    wanted: dict[str | None, np.ndarray] = {}
    for r in buckets.groupBy("lang").agg(F.collect_list("bucket").alias("all")).toLocalIterator():
        wanted[r["lang"]] = np.isin(np.arange(BUCKETS), r["all"])
    none = np.zeros(BUCKETS, bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                row, left, right, bucket, words = pairs_of(part.column(1))
                lang, names = coded_languages(part.column(0))
                keep = np.stack([wanted.get(name, none) for name in names])[lang[row], bucket]
                n = max(len(words), 1)
                found, docs = np.unique((lang[row[keep]] * n + left[keep]) * n + right[keep], return_counts=True)
                of, pair = np.divmod(found, n * n)
                phrases = pc.binary_join_element_wise(words.take(pa.array(pair // n)), words.take(pa.array(pair % n)), " ")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(of)), phrases, pa.array(docs.astype(np.int64))], names=["lang", "phrase", "docs"])

    made = texts.select("lang", "text").mapInArrow(run, "lang string, phrase string, docs long")
    return made.groupBy("lang", "phrase").agg(F.sum("docs").alias("docs"))
