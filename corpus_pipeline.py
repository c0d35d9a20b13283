"""A corpus pipeline of the training-data operators, from raw documents to packed token windows.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, line_dedup, near_copies, packing, quality_rules
from quillspark.llm.common import MADE, drop_paths, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: what they reject goes."""
    judged = quality_rules.judge(docs, keep=tuple(docs.columns))
    return judged.where("kept").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines of three documents or more stay in one; a document left without text goes."""
    cut = line_dedup.dedup_lines(docs).where(F.col("n_dropped") < F.col("n_lines"))
    return cut.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of texts alike (0.8 of their five-word shingles) the smallest id stays, with the rows that repeat it."""
    return near_copies.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item of benchmark go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every piece of every document left, with its place."""
    return packing.packed(docs)


STAGES = [("quality rules", keep_good), ("line dedup", drop_common_lines), ("near dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]
#: The posteriors of stage 1, the fingerprints of stage 3 and the tokens of stage 5 are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, past = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        drop_paths(spark, MADE[past:-1])  # what the stage read and made on its way
    return docs
