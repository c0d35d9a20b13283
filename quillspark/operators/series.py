"""Comparisons, summaries and spacing of daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.values import ratio, resolution

METRICS = ("matched_count", "country_share", "attention_index")


def compare_sources(trends: DataFrame, left: str, right: str, left_metric: str, right_metric: str) -> DataFrame:
    """Per topic and geography, over the days that both sources have: correlation, means and zero days."""
    if not {left_metric, right_metric} <= set(METRICS):
        raise ValueError("a comparison takes one of " + ", ".join(METRICS))
    keys = ["topic_id", "geography"]

    def side(source: str, metric: str, name: str) -> DataFrame:
        rows = trends.where((F.col("source") == source) & F.col("geography").isNotNull() & F.col(metric).isNotNull()).groupBy(*keys, "day")
        # Differing values for a day are a conflict, but for rounding.
        low, high = F.min(F.col(metric).cast("double")), F.max(F.col(metric).cast("double"))
        checked = F.when(high - low > 1e-9 * F.greatest(F.abs(low), F.abs(high)), F.raise_error(F.lit(f"{source} has several values for a day"))).otherwise(high)
        return rows.agg(checked.cast("double").alias(name))

    if left == right:
        right_metric = left_metric
    a, b = side(left, left_metric, "a"), side(right, right_metric, "b")
    paired = a.join(b, [*keys, "day"]).groupBy(*keys).agg(
        F.count("*").alias("paired_days"), F.avg("a").alias("left_mean"), F.avg("b").alias("right_mean"),
        ratio(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("correlation"),
        F.count_if(F.col("a") == 0).alias("left_zero_days"), F.count_if(F.col("b") == 0).alias("right_zero_days"),
    )
    days = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return paired.join(days(a, "left_days"), keys).join(days(b, "right_days"), keys).withColumn("correlation", F.when(F.col("paired_days") > 1, F.round("correlation", 12)))


def coverage_summary(trends: DataFrame) -> DataFrame:
    """Rows, first and last day, days and geographies by source, by topic and over all, in one pass."""
    sets = trends.groupingSets([["source"], ["topic_id"], []], "source", "topic_id")
    return sets.agg(
        F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_distinct("day").alias("days"), F.count_distinct("geography").alias("geographies"),
    )


def islands(days: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive days per key: start, end and number of days."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    runs = days.select(*keys, "day").distinct().withColumn("island", F.date_sub("day", rank))
    return runs.groupBy(*keys, "island").agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count("*").alias("days")).drop("island")


def spacing(days: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the days, the median gap between them and the resolution's name."""
    gaps = days.select(*keys, "day").distinct().withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy(*keys).orderBy("day"))))
    out = gaps.groupBy(*keys).agg(F.count("*").alias("days"), F.median("gap").alias("median_gap"))
    return out.withColumn("resolution", resolution(F.col("median_gap"), F.col("days")))


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__n", rank).where("__n = 1").drop("__n")


def daily_counts(records: DataFrame, dims: list[str]) -> DataFrame:
    """Articles per day and dims (nulls are a group), each record_id counted once, by its last row."""
    return last_per_key(records, ["record_id"], "arrival").groupBy("day", *dims).agg(F.count("*").alias("articles"))
