"""Backfill windows and the ledger of their runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.values import record_id

OPEN = ("pending", "running", "failed")


def windows(queries: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """queries x the windows of so many days that cover the range, the last one clipped; with window_id."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    out = queries.withColumn("start_day", F.explode(F.sequence(first, last, F.make_interval(days=F.lit(days)))))
    return with_window_id(out, queries.columns, end, days)


def with_window_id(rows: DataFrame, keys: list[str], end: str, days: int) -> DataFrame:
    """rows (keys, start_day) with the end_day and window_id of their window."""
    out = rows.withColumn("end_day", F.least(F.lit(end).cast("date"), F.date_add("start_day", days - 1)))
    return out.withColumn("window_id", record_id("window-v1", *keys, "start_day", "end_day"))


def window_states(events: DataFrame, queries: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Per window of queries (their columns and start_day) with any of the events (those columns, day, ts and status): the last status and the attempts.

    A day lies in one window, whose start is found by arithmetic: events are folded first and then held against the queries alone.
    The windows themselves are not joined, as Spark takes an exploded table for as small as what it was made of, and broadcasts it.
    """
    first, keys = F.lit(start).cast("date"), queries.columns
    began = F.date_add(first, (F.floor(F.datediff("day", first) / days) * days).cast("int"))
    inside = events.where(F.col("day").between(first, F.lit(end).cast("date"))).withColumn("start_day", began)
    folded = inside.groupBy(*keys, "start_day").agg(F.max_by("status", "ts").alias("status"), F.count("*").alias("attempts"))
    return folded.join(queries, keys, "left_semi")


def fold(events: DataFrame) -> DataFrame:
    """Per window the last status, the attempts (started events) and the articles of successes."""
    return events.groupBy("window_id").agg(F.max_by("status", "ts").alias("status"), F.count_if(F.col("status") == "started").alias("attempts"), F.sum("articles").alias("articles"))


def unfinished(planned: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Planned windows whose last status is open (none: pending); keys name a window in both."""
    latest = states.select(*keys, "status")
    out = planned.join(latest, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return out.where(F.col("status").isin(*OPEN))


def run_summary(windows_with_status: DataFrame, by: list[str]) -> DataFrame:
    """Per run the windows of each status, whether all are done, and the distinct queries."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = windows_with_status.groupBy(*by).agg(
        F.count("*").alias("windows"), *map(count, ("success", "failed", "pending", "split")), F.bool_and(F.col("status").isin("success", "split")).alias("complete"), F.count_distinct("query_id").alias("queries")
    )
    return out


def latest_status(events: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    return events.withColumn("__n", rank).where("__n = 1").drop("__n")
