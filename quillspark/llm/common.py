"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes of `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset a local session gets a temporary one;
    on a cluster, whose machines share no such folder, that fails."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders made by this process, until drop_paths deletes them.
MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    MADE.append(f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of new_path whose rows nobody reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        MADE.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read back: lineage ends there, and no executor's loss undoes it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched."""
    return F.translate(text, UPPER, LOWER)


def blank_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The maximal runs of `[^\\x20\\x09-\\x0D]` in a text; none for null."""
    bare = blank_trim(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


#: A key is hot when it holds over one in HOT rows, so that there are fewer than HOT of them, and over LEAST_HOT; its rows are dealt
#: to parts of about that size.
HOT, LEAST_HOT = 1000, 1000


def join_salted(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner", n: str = "__n") -> DataFrame:
    """many joined with few, a table with one row per key and n, the rows that many has of the key (which goes).

    Spark can't split a hot partition that is joined with an aggregate: the rows of a hot key are dealt to parts by the hash of
    `by`, and that key's row of few is repeated for each. The hot keys, fewer than HOT, are broadcast; cold keys have one part.
    """
    total = few.agg(F.sum(n)).first()[0] or 0
    size = max(LEAST_HOT, total // HOT)
    keys = [f"__hot_{c}" for c in on]
    hot = few.where(F.col(n) > size).select(*(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), F.ceil(F.col(n) / size).cast("int").alias("__parts"))

    def with_parts(df: DataFrame) -> DataFrame:
        same = [F.col(c) == F.col(k) for c, k in zip(on, keys, strict=True)]
        return df.join(F.broadcast(hot), same, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).drop(*keys)

    dealt = with_parts(many).withColumn("__part", F.pmod(F.xxhash64(*by), F.col("__parts")).cast("int")).drop("__parts")
    spread = with_parts(few.drop(n)).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return dealt.join(spread, [*on, "__part"], how).drop("__part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
