"""Datasets of records: idempotent upserts and merges, partitioned writes, upgrades on read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.panel import with_coverage
from quillspark.session import drop_folder


def last_rows(df: DataFrame, key: str, order: str | None, before: tuple[str, ...] = ()) -> DataFrame:
    """Of each key the row with the largest values of before, then of order; what is left equal is settled by the rows' hashes, so that
    every run picks the same one."""
    first = [F.desc(c) for c in (*before, *([order] if order else []))]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*first, F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns))))
    return df.withColumn("__n", rank).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str = "record_id", order: str | None = None) -> DataFrame:
    """All records; of one key the new one wins, and among new ones that with the largest order (the arrival, so that the last write wins)."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return last_rows(both, key, order, ("__batch",)).drop("__batch")


def added(old: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """The keys of new that old lacks."""
    return new.select(key).distinct().join(old.select(key), key, "left_anti")


def merge_fields(old: DataFrame, new: DataFrame, identity: list[str], values: list[str], latest: str | None = None, maps: list[str] = (), key: str = "record_id", changeable: dict[str, str] | None = None) -> DataFrame:
    """Field by field: a new value that is not null wins, the larger `latest`, and maps are merged, new entries winning.

    identity columns must agree, but for those of a new record (n) for which changeable has a condition that holds; identity_ok
    says so, and was has the old values, for collisions to be set aside.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    agree = F.lit(True)
    for c in identity:
        free = F.coalesce(F.expr((changeable or {}).get(c, "false")), F.lit(False))
        agree &= F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) | F.col(f"o.{key}").isNull() | F.col(f"n.{key}").isNull() | free
    columns = [pick(c).alias(c) for c in (key, *identity, *values)]
    if latest:
        columns.append(F.greatest(f"o.{latest}", f"n.{latest}").alias(latest))
    columns += [merged_map(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in maps]
    return both.select(*columns, agree.alias("identity_ok"), F.struct(*(F.col(f"o.{c}").alias(c) for c in identity)).alias("was"))


def merged_map(old: Column, new: Column) -> Column:
    """Both maps' entries, new ones winning; a null map is an absent one."""
    stay = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    both = F.map_from_entries(F.concat(F.map_entries(stay), F.map_entries(new)))
    return F.when(old.isNull() | new.isNull(), F.coalesce(new, old)).otherwise(both)


def upsert_versions(old: DataFrame, new: DataFrame, key: str = "record_id", version: str = "version", seq: str = "seq") -> DataFrame:
    """Of each key the highest version; on a tie new beats old, and of one batch the first."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("__batch"), seq))
    return both.withColumn("__n", rank).where("__n = 1").drop("__n", "__batch")


def affected_partitions(trends: DataFrame, coverage: DataFrame) -> DataFrame:
    """The (source, topic_id) partitions that hold a day, country and language with new coverage."""
    return trends.join(coverage, ["source", "geography", "day"], "left_semi").select("source", "topic_id").distinct()


def latest_range(runs: DataFrame) -> DataFrame:
    """Per source the requested range of its last run without an error."""
    good = runs.where("error IS NULL").groupBy("source").agg(F.max_by(F.struct("requested_start", "requested_end"), "run_id").alias("r"), F.max("run_id").alias("run_id"))
    return good.select("source", "run_id", "r.requested_start", "r.requested_end")


def write_partitioned(df: DataFrame, path: str, by: list[str], sort: list[str]) -> None:
    """Zstandard Parquet; the partitions that df has are replaced whole, the others stay."""
    df.repartition(*by).sortWithinPartitions(*by, *sort).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def touched_rows(spark: SparkSession, path: str, new: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the dataset in those partitions that new has rows of; none where there is no dataset yet."""
    touched = new.select(*by).distinct()
    try:
        return spark.read.parquet(path).select(*new.columns).join(F.broadcast(touched) if touched.limit(10_001).count() <= 10_000 else touched, by, "left_semi")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], new.schema)


def staging(path: str) -> str:
    return f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"


def upsert_into(spark: SparkSession, path: str, new: DataFrame, by: list[str], sort: list[str], key: str = "record_id", order: str | None = None) -> int:
    """Upserts new into the partitioned dataset and returns how many keys were added.

    Only partitions that new touches are read and rewritten; they are staged first, since what is read can't be overwritten,
    and the staged copy goes once they are published.
    """
    old, staged = touched_rows(spark, path, new, by), staging(path)
    fresh = added(old, new, key).count()
    upsert(old, new, key, order).write.parquet(staged)
    write_partitioned(spark.read.schema(new.schema).parquet(staged), path, by, sort)
    drop_folder(spark, staged)
    return fresh


class CollisionError(ValueError):
    """New records that claim the id of a different one."""


def merge_into(
    spark: SparkSession, path: str, new: DataFrame, identity: list[str], values: list[str], by: list[str], sort: list[str], quarantine: str,
    latest: str | None = None, maps: list[str] = (), key: str = "record_id", changeable: dict[str, str] | None = None,
) -> int:
    """Merges new into the partitioned dataset field by field and returns how many records the touched partitions have.

    One pass merges, counts collisions as it writes, and parts them from the rest. If there are any, they are appended to the
    quarantine table with what they collide with, the dataset stays as it is, and the merge fails. by must be among the columns that can't change.
    """
    staged, seen = staging(path), Observation()
    merged = merge_fields(touched_rows(spark, path, new, by), new, identity, values, latest, maps, key, changeable)
    counted = merged.observe(seen, F.count("*").alias("rows"), F.count_if(~F.col("identity_ok")).alias("collisions"))
    counted.write.partitionBy("identity_ok").parquet(staged)
    rows, collisions = seen.get["rows"], seen.get["collisions"]
    back = spark.read.schema(merged.schema).parquet(staged)
    if collisions:
        back.where("NOT identity_ok").drop("identity_ok").write.mode("append").parquet(quarantine)
        drop_folder(spark, staged)
        raise CollisionError(f"{collisions} records collide with others of their id; see {quarantine}")
    write_partitioned(back.drop("identity_ok", "was"), path, by, sort)
    drop_folder(spark, staged)
    return rows


def refresh_coverage(spark: SparkSession, path: str, coverage: DataFrame, sort: list[str], by: tuple[str, ...] = ("source", "topic_id")) -> list[tuple]:
    """Renews the shares of those partitions of the dataset that new coverage concerns, and returns them.

    They alone are read, staged and overwritten; the files of all others stay.
    """
    trends = spark.read.parquet(path)
    touched = [tuple(r) for r in affected_partitions(trends, coverage).select(*by).collect()]  # partitions, each a folder
    if not touched:
        return []
    known = spark.createDataFrame(touched, trends.select(*by).schema)
    renewed, staged = with_coverage(trends.join(F.broadcast(known), list(by), "left_semi"), coverage).select(*trends.columns), staging(path)
    renewed.write.parquet(staged)
    write_partitioned(spark.read.schema(renewed.schema).parquet(staged), path, list(by), sort)
    drop_folder(spark, staged)
    return touched


def upgraded(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Old columns under their new names, where the new ones are absent; where both are there, new values win."""
    for old, new in renames.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    return df


TREND_RENAMES = {"monitored_count": "global_monitored_count", "attention_share": "global_attention_share"}


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """By the columns, each in its own type's order: null texts as empty ones, other nulls first."""
    kinds = dict(df.dtypes)
    return df.orderBy(*(F.coalesce(c, F.lit("")) if kinds[c] == "string" else F.asc_nulls_first(c) for c in columns))


def scan(df: DataFrame, start: str | None = None, end: str | None = None, day: str = "day", any_of: dict[str, list] | None = None, overlap: dict[str, list] | None = None) -> DataFrame:
    """The rows of the days, with values of the lists, and with arrays that overlap theirs; all plain predicates, so that they reach the files."""
    from quillspark.functions.values import in_range

    df = df.where(in_range(F.to_date(day), start, end))
    for column, values in (any_of or {}).items():
        df = df.where(F.col(column).isin(list(values)))
    for column, values in (overlap or {}).items():
        df = df.where(F.arrays_overlap(column, F.array(*map(F.lit, values))))
    return df


def unknown_ids(wanted: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return wanted.select(column).distinct().join(known.select(column), column, "left_anti")


def require_known(wanted: DataFrame, known: DataFrame, column: str) -> None:
    """Fails with the unknown ids, if there are any."""
    missing = [r[0] for r in unknown_ids(wanted, known, column).orderBy(column).limit(20).collect()]
    if missing:
        raise ValueError(f"unknown {column}: {', '.join(map(str, missing))}")
