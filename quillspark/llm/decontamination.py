"""Benchmark decontamination by size-partitioned MinHash containment search.

An item leaks into a document when at least THRESHOLD of the item's word shingles occur in it. Items are partitioned by
size; in a partition whose items have up to u shingles, an item's sketch is its k smallest shingle hashes, k = floor((1 -
THRESHOLD) * u) + 1. A document that holds the item can lack at most floor((1 - THRESHOLD) * q) of its q shingles, so that
it must hold all but as many of the sketch: searching the sketches finds every leak, however long the document. The
documents' hashes are looked up in the sketches of those partitions alone that a document of its size can hold; the
candidates are then verified by exact containment of the shingles themselves. DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits. An item of fewer than SHINGLE words is one shingle as long as
itself. Cases: null, empty or wordless items and documents match nothing; repeated items count once; repeated documents
are matched each; an empty table gives an empty result. find_leaks returns the document's id and the item's id alone;
in clean, other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import let, stored

SHINGLE, THRESHOLD = 5, 0.8
#: Sketch entries (some 30 bytes each), and bytes of the items' shingles, up to which they are sent to every executor; more are joined by
#: shuffling.
BROADCAST_ENTRIES, BROADCAST_BYTES = 1_000_000, 64_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def starts(ws: Column, size: int) -> Column:
    return F.when(F.size(ws) >= size, F.sequence(F.lit(0), F.size(ws) - size)).otherwise(F.array().cast("array<int>"))


def hashes(ws: Column, size: int) -> Column:
    """Distinct hashes of the shingles of so many words; the size is hashed along."""
    return F.array_distinct(F.transform(starts(ws, size), lambda i: F.xxhash64(F.lit(size), *(F.get(ws, i + k) for k in range(size)))))


def shingles(ws: Column, size: int | Column) -> Column:
    """Distinct shingles as texts; size may be a column."""
    at = F.when(F.size(ws) >= size, F.sequence(F.lit(0), F.size(ws) - size)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(ws, i + 1, size), " ")))


def partitioned(items: DataFrame, item_id: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """item (its number), item_id, width (words of a shingle), q, partition, k, shingles and sketch of each item with words."""
    ws = items.select(F.col(item_id).alias("item_id"), tokens(F.col(text_col)).alias("ws")).where(F.size("ws") > 0).distinct()
    sized = ws.withColumn("width", F.least(F.size("ws"), F.lit(SHINGLE)))
    by_width = F.coalesce(*(F.when(F.col("width") == n, hashes(F.col("ws"), n)) for n in range(1, SHINGLE + 1)))
    most = F.floor((1 - F.lit(threshold).cast("decimal(10,6)")) * (F.pow(2, F.col("partition") + 1) - 1).cast("int")).cast("int")
    return (
        sized.withColumns({"shingles": shingles(F.col("ws"), F.col("width")), "hashes": by_width, "item": F.xxhash64("item_id", "ws")})
        .withColumn("q", F.size("shingles"))
        .withColumn("partition", F.floor(F.log2("q")).cast("int"))
        .withColumn("k", F.least("q", most + 1))
        .withColumn("sketch", F.slice(F.array_sort("hashes"), 1, F.col("k")))
        .withColumn("may_lack", F.floor((1 - F.lit(threshold).cast("decimal(10,6)")) * F.col("q")).cast("int"))
        .drop("ws", "hashes")
    )


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, item_id, n_shingles (of the item), n_found (of them in the document), containment: a row per document and item leaked into it."""
    known = stored(partitioned(items, item_id, item_text, threshold), "items")
    text_bytes = F.octet_length(F.array_join("shingles", "")) + 24 * F.size("shingles")
    sizes = known.agg(F.sum(F.size("sketch")).alias("entries"), F.sum(text_bytes).alias("bytes"), F.array_sort(F.collect_set("width")).alias("widths")).first()
    widths = sizes["widths"] or [SHINGLE]
    sent = F.broadcast if (sizes["entries"] or 0) <= BROADCAST_ENTRIES else (lambda df: df)
    sent_whole = F.broadcast if (sizes["bytes"] or 0) <= BROADCAST_BYTES else (lambda df: df)
    # The least number of shingles a document must have for an item, and the least of its sketch it must hold.
    sketches = known.select("item", (F.col("q") - F.col("may_lack")).alias("least"), (F.col("k") - F.least("may_lack", F.col("k") - 1)).alias("hits_needed"), F.explode("sketch").alias("hash"))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash"), F.col(text_col).alias("__text"))
    # let: a filter that Spark infers and pushes down must not carry the split into the lambdas; outer: it is to infer none.
    hashed = rows.select("__id", "__hash", let(tokens(F.col("__text")), lambda ws: F.concat(*(hashes(ws, n) for n in widths))).alias("hashes"))
    candidates = (
        hashed.select("__id", "__hash", F.size("hashes").alias("n"), F.explode_outer("hashes").alias("hash"))
        .join(sent(sketches), "hash")
        .where(F.col("n") >= F.col("least"))
        .groupBy("__id", "__hash", "item")
        .agg(F.count_distinct("hash").alias("hits"), F.first("hits_needed").alias("hits_needed"))
        .where(F.col("hits") >= F.col("hits_needed"))
    )
    per_doc = (
        candidates.join(sent_whole(known.select("item", "item_id", "q", "width", "shingles")), "item")
        .groupBy(F.col("__id").alias("__id2"), F.col("__hash").alias("__hash2"))
        .agg(F.collect_list(F.struct("item_id", "q", "width", "shingles")).alias("items"))
    )
    both = rows.join(per_doc, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")))

    def held(sets: Column) -> Column:
        """Each candidate item held against the document's set of shingles as wide as its own."""
        at = F.array(*map(F.lit, widths))

        def found(x: Column) -> Column:
            mine = F.element_at(sets, F.array_position(at, x["width"]).cast("int"))
            return F.struct(x["item_id"].alias("item_id"), x["q"].alias("q"), F.size(F.array_intersect(mine, x["shingles"])).alias("found"))

        return F.transform("items", found)

    made = let(tokens(F.col("__text")), lambda ws: let(F.array(*(shingles(ws, n) for n in widths)), held))
    checked = both.select("__id", F.explode_outer(made).alias("x"))
    return (
        checked.select(F.col("__id").alias(id_col), F.col("x.item_id").alias(item_id), F.col("x.q").cast("long").alias("n_shingles"), F.col("x.found").cast("long").alias("n_found"))
        .withColumn("containment", F.col("n_found") / F.col("n_shingles"))
        .where(F.col("n_found") >= F.col("n_shingles") * F.lit(threshold).cast("decimal(10,6)"))
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id no leak was found in."""
    leaks = find_leaks(docs, items, id_col, text_col).select(F.col(id_col).alias("__leaked")).distinct()
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col("__leaked")), "left_anti")


ORACLE = r"""
WITH RECURSIVE
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (SELECT item_id, ws, least(len(ws), 5) AS width FROM i WHERE len(ws) > 0),
ish AS (SELECT DISTINCT item_id, width, array_to_string(ws[s:s + width - 1], ' ') AS shingle
        FROM (SELECT *, unnest(range(1, len(ws) - width + 2)) AS s FROM iw)),
widths AS (SELECT DISTINCT width FROM iw),
dsh AS (SELECT DISTINCT doc_id, width, array_to_string(ws[s:s + width - 1], ' ') AS shingle
        FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS s FROM d, widths)),
q AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*)::DOUBLE / n_shingles AS containment
FROM ish JOIN dsh USING (width, shingle) JOIN q USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
