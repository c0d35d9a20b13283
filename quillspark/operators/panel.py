"""Dense topic x country x day panels and the counts that fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.values import political_share, ratio
from quillspark.operators.matching import small


def calendar(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows x every day of the range (column day)."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return rows.withColumn("day", F.explode(days))


def spine(topics: DataFrame, countries: DataFrame, start: str, end: str) -> DataFrame:
    """Every day, topic and country: dimension tables, crossed."""
    return calendar(topics.crossJoin(small(countries)), start, end)


def dense(panel_spine: DataFrame, counts: DataFrame, keys: list[str], zeros: dict[str, object]) -> DataFrame:
    """The spine with counts; a cell without any gets the value that zeros names for the column."""
    out = panel_spine.join(counts, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zeros.items()})


def url_counts(attributed: DataFrame) -> DataFrame:
    """Distinct matched urls per topic, day and country."""
    return attributed.groupBy("topic_id", "day", "country").agg(F.count_distinct("url").alias("matched_count"))


def language_breakdown(attributed: DataFrame) -> DataFrame:
    """Per topic, day and country the urls of each language, as JSON in the order of languages."""
    by_language = attributed.groupBy("topic_id", "day", "country", "lang").agg(F.count_distinct("url").alias("count"))
    items = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("language"), "count"))))
    return by_language.groupBy("topic_id", "day", "country").agg(items.alias("language_counts_json"))


def monitored_counts(catalogue: DataFrame) -> DataFrame:
    """Distinct catalogue urls per day and country."""
    return catalogue.groupBy("day", "country").agg(F.count_distinct("url").alias("monitored_count"))


def mapping_stats(matched: DataFrame, attributed: DataFrame) -> DataFrame:
    """Per topic, over the whole window: distinct matched and attributed urls, and their ratio."""
    total = matched.groupBy("topic_id").agg(F.count_distinct("url").alias("total_matched_urls"))
    found = attributed.groupBy("topic_id").agg(F.count_distinct("url").alias("attributed_matched_urls"))
    out = total.join(found, "topic_id", "left").withColumn("attributed_matched_urls", F.coalesce("attributed_matched_urls", F.lit(0)).cast("long"))
    return out.withColumn("attribution_rate", ratio(F.col("attributed_matched_urls"), F.col("total_matched_urls")))


def signal_counts(rows: DataFrame) -> DataFrame:
    """Per topic, day and country (one row per url): matched, with any signal, and with each."""
    flags = ["political_actor", "government_action", "party_politics", "official"]
    union = F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2]) | F.col(flags[3])
    counts = rows.groupBy("topic_id", "day", "country").agg(
        F.count("*").alias("matched_count"), F.count_if(union).alias("political_count"), *(F.count_if(F.col(f)).alias(f"{f}_count") for f in flags)
    )
    return counts.withColumn("political_share", political_share(F.col("political_count"), F.col("matched_count")))


def with_coverage(trends: DataFrame, coverage: DataFrame) -> DataFrame:
    """trends with shares by the coverage of their day, country and language; a row's own denominator serves where there is none."""
    c = coverage.select(*(F.col(x).alias(f"c_{x}") for x in ("source", "geography", "language", "day")), "country_count", "global_count")
    same = (F.col("source") == F.col("c_source")) & (F.col("geography") == F.col("c_geography")) & (F.col("day") == F.col("c_day"))
    out = trends.join(c, same & F.col("language").eqNullSafe(F.col("c_language")), "left")
    own: Column = F.coalesce("country_count", "monitored_count")
    return out.withColumns({"monitored_count": own, "country_share": ratio(F.col("matched_count"), own), "global_share": ratio(F.col("matched_count"), F.col("global_count"))}).drop(
        "c_source", "c_geography", "c_language", "c_day", "country_count", "global_count"
    )
