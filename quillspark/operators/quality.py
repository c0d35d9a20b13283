"""Completeness and quality checks; each returns the rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_cells(spine: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the spine that the panel lacks, and of the panel beyond the spine."""
    gap = spine.select(*keys).distinct().join(panel, keys, "left_anti").withColumn("problem", F.lit("missing"))
    return gap.unionByName(panel.select(*keys).distinct().join(spine, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_days(series: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Days of the range that a series with any row lacks; a series without rows counts as zero, and is not here."""
    days = series.select(*keys).distinct().withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return days.join(series.select(*keys, "day"), [*keys, "day"], "left_anti")


def unexpected(labels: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return labels.select(column).distinct().join(known.select(column), column, "left_anti")


def of_known_labels(rows: DataFrame, known: DataFrame, column: str, explicit: bool) -> DataFrame:
    """The rows whose label is known. Where the labels were asked for one by one (explicit) any other one fails; else rows of others are
    ignored, as a source returns all that it has."""
    if explicit:
        others = [r[0] for r in unexpected(rows, known, column).orderBy(column).limit(20).collect()]
        if others:
            raise ValueError(f"unexpected {column}: {', '.join(map(str, others))}")
    return rows.join(known.select(column), column, "left_semi")


def broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and the name of each rule that a row breaks; a rule that is null holds. One pass for all rules."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(names).alias("rule"))


def dimension_problems(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """table, key and rows of each repeated key of the dimension tables."""
    parts = [duplicates(df, keys).select(F.lit(name).alias("table"), F.concat_ws("|", *keys).alias("key"), "rows") for name, (df, keys) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def absent(required: DataFrame, present: DataFrame, column: str) -> DataFrame:
    return required.select(column).distinct().join(present.select(column), column, "left_anti")


def political_problems(signals: DataFrame, official: DataFrame, required: list[str]) -> DataFrame:
    """problem and key of what is wrong with the political dimension tables, in one table: signals (signal) that are required and missing or
    that repeat, and official domains (country, domain) that are blank, no bare host, or repeated within their country."""
    wanted = signals.sparkSession.createDataFrame([(x,) for x in required], "signal string")
    missing = absent(wanted, signals, "signal").select(F.lit("missing signal").alias("problem"), F.col("signal").alias("key"))
    repeated = duplicates(signals, ["signal"]).select(F.lit("repeated signal").alias("problem"), F.col("signal").alias("key"))
    cleaned = F.ltrim(F.lower(F.trim(F.coalesce("domain", F.lit("")))), F.lit("."))
    domains = official.select("country", cleaned.alias("domain")).groupBy("country", "domain").agg(F.count("*").alias("rows"))
    found = F.array_compact(F.array(
        F.when(F.col("domain") == "", "blank domain"), F.when((F.col("domain") != "") & ~bare_host(F.col("domain")), "not a bare host"), F.when(F.col("rows") > 1, "repeated domain"),
    ))
    key = F.concat_ws("|", F.col("country").cast("string"), "domain").alias("key")
    return missing.unionByName(repeated).unionByName(domains.select(F.explode(found).alias("problem"), key))


def foreign_domains(official: DataFrame, selected: DataFrame) -> DataFrame:
    """Official domains of countries that are not selected."""
    return official.join(selected, "country", "left_anti")


def bare_host(domain: Column) -> Column:
    return domain.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$")
