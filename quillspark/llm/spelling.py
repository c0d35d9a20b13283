"""Spelling variants by a variable-length gram index.

Words are counted, and every word is cut into grams of QMIN to QMAX code points, one for each place: a gram is lengthened
while it is among the frequent ones. The dictionary of frequent grams is pruned by count to fewer than DICTIONARY, whatever the
corpus, so that it can be sent to all tasks.

One edit affects only the grams that it touches: each gram is chosen by its own code points alone, so that those which end before
the edited place stay at their distance from the word's start, and those which begin after it at their distance from its end.
Hence for each place of a word (or range of places, in words of over PLACES code points) the number of grams that an edit there
can affect is known, and all others must be in the near word too. The lists of those grams are merged by meeting in one key,
made of all of them and of the length without the edited code point: a replacement makes both words lose one there, an insertion
the longer one. A place whose edit affects all grams has the remaining code points as its key. What meets is verified by edit
distance, so that the pairs are exactly those that differ by one code point; words that share a key differ at one place and at
the few code points near it that no gram left covers.

A word's form is its near word of largest count, if that is at least `ratio` times its own; the root follows forms to their end,
by doubling, in rounds that grow with the logarithm of a chain's length (counts grow by the ratio at every step).

Cases: null and empty texts have no words; a row of a null id has its runs unchanged; rows that repeat count each; an empty table
gives an empty result. Columns other than the id and the text are dropped. Ties among near words go to the smaller word in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, let, stored

QMIN, QMAX = 2, 4
#: Frequent grams are fewer than DICTIONARY; one of FREQUENT places or fewer is never frequent.
DICTIONARY, FREQUENT = 20_000, 200
PLACES = 48
MASK = 2**64 - 1


def runs(text: Column, least: int) -> Column:
    """The maximal runs of `[A-Za-z\\u00C0-\\u00FF]` of at least so many code points, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))


def with_slips(doc_id: Column, run: Column, one_in: int = 199) -> Column:
    """The run, or where one_in divides the CRC32 h of `<doc_id>:<run>` the run without its code point h % length."""
    slipped = lambda h, at: F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return let(
        F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run)),
        lambda h: F.when(h % one_in == 0, slipped(h, (h % F.length(run)).cast("int"))).otherwise(run),
    )


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, least: int = 5) -> DataFrame:
    """word and n of the distinct words of so many code points and occurrences at least."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs(F.col(text_col), length)).alias("run"))
    words = found.select(with_slips(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def frequent_grams(words: DataFrame) -> frozenset[str]:
    """Grams of QMIN to QMAX - 1 code points at over one in DICTIONARY of all places, and over FREQUENT."""

    def grams_of_size(q: int) -> Column:
        starts = F.when(F.length("word") >= q, F.sequence(F.lit(1), F.length("word") - (q - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.substr("word", i, F.lit(q))), F.array().cast("array<string>"))

    grams = F.concat(*(grams_of_size(q) for q in range(QMIN, QMAX)))
    counts = stored(words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("places")), "grams")
    total = counts.agg(F.sum("places")).first()[0] or 0
    return frozenset(r[0] for r in counts.where(F.col("places") > max(FREQUENT, total // DICTIONARY)).select("gram").collect())  # fewer than DICTIONARY


def grams_of(word: str, frequent: frozenset[str]) -> list[tuple[int, int]]:
    """Start and end of the gram of each place; one that the word's end cuts short is none."""
    out = []
    for p in range(len(word) - QMIN + 1):
        end = p + QMIN
        while word[p:end] in frequent and end - p < QMAX and end < len(word):
            end += 1
        if end - p == QMAX or word[p:end] not in frequent:
            out.append((p, end))
    return out


def keys_of(word: str, frequent: frozenset[str]) -> set[tuple[int, bool]]:
    """(key, whether a code point was taken away) for each place of an edit."""
    size, grams = len(word), grams_of(word, frequent)
    left, right = [0] * (size + 1), [0] * (size + 2)  # sums of the hashes of grams that end up to i, or start from i on
    kept_left, kept_right = [0] * (size + 1), [0] * (size + 2)
    for p, end in grams:
        gram = word[p:end]
        left[end] += xxhash.xxh64_intdigest(f"{p}<{gram}")
        right[p] += xxhash.xxh64_intdigest(f"{size - p}>{gram}")
        kept_left[end] += 1
        kept_right[p] += 1
    for i in range(1, size + 1):
        left[i] += left[i - 1]
        kept_left[i] += kept_left[i - 1]
    for i in range(size, -1, -1):
        right[i] += right[i + 1]
        kept_right[i] += kept_right[i + 1]
    out = set()
    for taken in (True, False):
        rest = size - taken  # the length without the edited code point; its places are 0 to rest
        width = -(-(rest + 1) // PLACES)
        for first in range(0, rest + 1, width):
            after = min(first + width - 1, rest) + taken  # the first code point beyond the last place
            if kept_left[first] + kept_right[after]:
                key = f"{rest}|{left[first] & MASK}|{right[after] & MASK}"
            else:
                key = f"{rest}|{word[:first]}|{word[after:]}"
            out.add((xxhash.xxh64_intdigest(key), taken))
    return out


def keyed(words: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """key, word, n and taken: the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, row, keys, taken = batch.slice(at, 500), [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    for key, t in keys_of(word, frequent):
                        row.append(i)
                        keys.append(key)
                        taken.append(t)
                chosen = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), *chosen.columns, pa.array(taken, pa.bool_())], names=["key", "word", "n", "taken"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, taken boolean")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near and near_n of all pairs that differ by one code point, in both directions."""
    index = stored(keyed(words, frequent_grams(words)), "gram-index")
    a, b = index.where("taken").select("key", F.col("word").alias("a"), F.col("n").alias("a_n")), index.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "taken")
    met = a.join(b, "key").where((~F.col("taken") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    pairs = met.select("a", "a_n", "b", "b_n").distinct()
    both = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): the last word that forms lead to."""
    chains = stored(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        ends = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(chains.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        chains = after.drop("moved")
        if after.where("moved").isEmpty():
            return chains


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = stored(counted_words(docs, id_col, text_col, length, least), "words")
    near = near_words(words)
    best = F.min(F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))).alias("best")
    found = stored(near.groupBy("word").agg(F.count("*").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")), "near-words")
    out = words.join(found, "word", "left").join(roots(found.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
