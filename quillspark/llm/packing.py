"""Packing by minimum bin slack.

Texts become token ids with an end id; what fills whole windows is cut off, and the remainders, all shorter than a
window, are packed. Only their lengths matter, and there are fewer of those than a window has places: counts per length
go to the driver, where a bitset subset-sum picks the multiset of lengths that fills a window closest, takes it as
often as the counts allow, and goes on with what is left. The plan (ranges of ranks per length) is as small as the set
of lengths, whatever the corpus; each piece looks its place up by its rank among the pieces of its length. Ranks are
counted in parts of a length, as many as its count asks for: full windows are most pieces of a large corpus, and no task holds
more than about RANKED of them.

Cases: a null or empty text has the end id alone; repeated rows are packed each; very long texts are cut; an empty table
gives an empty result. Columns other than the id and the text are dropped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import stored

WINDOW, END = 4096, 2
#: Pieces of a length that a task ranks at most; fewer where a thousandth of all pieces is less, but not under LEAST_RANKED.
RANKED, LEAST_RANKED = 50_000, 100
#: Token ids by lower-cased word, kept in each Python worker; emptied at about CACHED bytes.
CACHE: dict[str, dict[bytes, bytes]] = {}
CACHED, ENTRY = 150_000_000, 150


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids as little-endian 32-bit bytes. Words between ASCII blanks are encoded each by itself and remembered: the tokenizer
    drops white space, lower-cases, and never joins what white space parts. A text that holds a special token goes to the
    tokenizer whole, as it is; in other texts lower-casing must not make one (`<|ENDOFTEXT|>`)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = CACHE.setdefault(path, {})
        self.held = sum(len(k) + len(v) + ENTRY for k, v in self.known.items())

    def learn(self, words: set[bytes]) -> None:
        if self.held > CACHED:
            self.known.clear()
            self.held = 0
        words = {w for w in words if w not in self.known}
        # A mark after a letter is a token of its own.
        stems = {w: w[:-1] for w in words if w[-1:] in b".,;:!?" and w[-2:-1].islower()}
        fresh = [w for w in words | {p for w, s in stems.items() for p in (s, w[-1:])} if w not in stems and w not in self.known]
        self.tokenizer.encode_special_tokens = True
        for w, got in zip(fresh, self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False), strict=True):
            self.known[w] = np.array(got.ids, "<u4").tobytes()
            self.held += len(w) + len(self.known[w]) + ENTRY
        for w, s in stems.items():
            self.known[w] = self.known[s] + self.known[w[-1:]]
            self.held += len(w) + len(self.known[w]) + ENTRY

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            if any(x in text for x in self.special):
                self.tokenizer.encode_special_tokens = False
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            ws = text.encode().lower().split()
            try:
                yield b"".join([known[w] for w in ws])
            except KeyError:
                self.learn(set(ws))
                yield b"".join([known[w] for w in ws])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """The id, start, length, ids_crc32, doc_tokens and, if asked for, the ids of each piece of at most WINDOW tokens."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, got in enumerate(encoder.encode([x or "" for x in batch.column(1).to_pylist()])):
                got += END.to_bytes(4, "little")
                for at in range(0, len(got), 4 * WINDOW):
                    part = got[at : at + 4 * WINDOW]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(crc32(part))
                    total.append(len(got) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    longs = [T.StructField(n, T.LongType()) for n in names[1:5]]
    schema = T.StructType([T.StructField(id_col, kind), *longs, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum is largest within capacity.

    Bit s of a bitset: sum s can be reached. Lengths are added from the longest on, each as powers of two of itself, until
    capacity is reached; the steps are then walked back from the best sum.
    """
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], capacity // length) if length <= capacity else 0, 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            size *= 2
        if reach >> capacity & 1:
            break
    best, picked = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            picked[length] = picked.get(length, 0) + take
    return picked


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, pieces of the length in a sequence, offset of the first of them)."""
    left, used, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        picked = fullest({k: n for k, n in rest.items() if n}, window - longest)
        picked[longest] = picked.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in picked.items()), 0
        for length in sorted(picked, reverse=True):
            n = picked[length]
            rows.append((length, used[length], times * n, sequence, n, offset))
            used[length] += times * n
            left[length] -= times * n
            offset += n * length
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(parts: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """parts (pieces, of which a plain table should be given: they are read twice) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    table = plan(counts, window)
    part = min(max(sum(counts.values()) // 1000, LEAST_RANKED), RANKED)
    salts = parts.sparkSession.createDataFrame([(k, -(-n // part)) for k, n in counts.items()], "length long, __salts long")
    # Rows that repeat an id and a start are told apart by nothing, and meet in one part.
    salted = parts.join(F.broadcast(salts), "length").select(*parts.columns, F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.col("__salts")).cast("int").alias("__salt"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(id_col, "start", "ids_crc32", "doc_tokens"))
    ranked = salted.withColumn("__rank", rank).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before") - 1)
    ranked = ranked.select(*parts.columns, "__rank")

    names = [*parts.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(table[:, 2].max(initial=0) + table[:, 1].max(initial=0)) + 1  # more than any rank
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, length * span + rank, "right") - 1]
            k = rank - row[:, 1]
            columns = batch.columns[:-1] + [pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, with_ids: bool = False, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place; without the ids unless asked for."""
    return pack(stored(pieces(docs, tokenizer=tokenizer, with_ids=with_ids), "pieces"))
