"""Line dedup: lines that many documents hold are dropped from all but one of them.

Lines are exploded, normalised and hashed to 128 bits; distinct documents are counted per hash; the lines of hashes over
the threshold are dropped, and each text is put together again from the positions that stay.

Cases: a null or empty text is one empty line. A document is a doc_id; rows that repeat a doc_id count once and are all
kept, each judged on its own text. A null doc_id is one more document, smaller than all others. Other columns pass
through; kept_text, n_lines and n_dropped replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, blank_trim, join_salted, let, stored


def line_key(line: Column) -> Column:
    """What lines are compared by: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(blank_trim(line))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped.

    A key of at least min_chars code points found in at least min_docs documents loses all its lines except those in
    the largest id that holds it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"__id": F.col(id_col), "__hash": F.xxhash64(text)})
    lines = (  # outer: for explode Spark would make all keys twice, to filter on their number
        rows.select("__id", "__hash", F.posexplode_outer(F.transform(F.split(text, "\n", -1), line_key)).alias("__pos", "__key"))
        .where(F.length("__key") >= min_chars)
        .select("__id", "__hash", "__pos", F.xxhash64("__key").alias("__k1"), F.xxhash64(F.lit(1), "__key").alias("__k2"))
    )
    common = stored(
        lines.groupBy("__k1", "__k2")
        .agg(F.count_distinct(F.struct("__id")).alias("__docs"), F.max("__id").alias("__keeper"), F.count("*").alias("__n"))
        .where(F.col("__docs") >= min_docs)
        .drop("__docs"),
        "common-lines",
    )
    dropped = (
        join_salted(lines, common, ["__k1", "__k2"], ["__id", "__hash"])
        .where(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .groupBy(F.col("__id").alias("__id2"), F.col("__hash").alias("__hash2"))
        .agg(F.collect_set("__pos").alias("__gone"))
    )
    gone = F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    kept = let(
        F.split(text, "\n", -1),
        lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i)), "\n"),
    )
    return (
        rows.join(dropped, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), "left")
        .withColumns(
            {
                "kept_text": F.when(F.size(gone) == 0, text).otherwise(kept),
                "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
                "n_dropped": F.size(gone).cast("long"),
            }
        )
        .drop("__id", "__hash", "__id2", "__hash2", "__gone")
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
