"""From hosts to countries by the longest domain suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.web import suffixes
from quillspark.operators.matching import small


def unambiguous_domains(mapped: DataFrame) -> DataFrame:
    """domain, country of the domains (lower-cased) that have one country alone."""
    rows = mapped.where("domain IS NOT NULL AND country IS NOT NULL").groupBy(F.lower("domain").alias("domain"))
    return rows.agg(F.count_distinct("country").alias("n"), F.min("country").alias("country")).where("n = 1").drop("n")


def attribute(rows: DataFrame, domains: DataFrame, official: DataFrame | None = None) -> DataFrame:
    """rows (host) with domain and country of the longest domain that the host equals or lies below; others go.

    Official domains go before mapped ones of the same length. Each distinct host is attributed once: its suffixes are
    exploded and joined by equality, so that no host is held against every domain.
    """
    ranked = domains.select("domain", "country", F.lit(1).alias("priority"))
    if official is not None:
        ranked = official.select("domain", "country", F.lit(0).alias("priority")).unionByName(ranked)
    hosts = rows.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    best = Window.partitionBy("host").orderBy(F.length("domain").desc(), "priority", "country")
    found = hosts.join(small(ranked), "domain").withColumn("__n", F.row_number().over(best)).where("__n = 1").select("host", "domain", "country")
    return rows.join(found, "host")


def flag_official(rows: DataFrame, official: DataFrame) -> DataFrame:
    """rows (host, country) with official: whether an official domain of the country is the host or above it."""
    hosts = rows.select("host", "country").distinct().select("host", "country", F.explode(suffixes(F.col("host"))).alias("domain"))
    hit = hosts.join(small(official), ["country", "domain"], "left_semi").select("host", "country").distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, ["host", "country"], "left").withColumn("official", F.coalesce("__hit", F.lit(False))).drop("__hit")


def country_codes(countries: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """countries (id, label, code) with the code that was given, else that of the alias of just this label, else that of the name that the
    label is but for its case; a country without any fails when its row is read. names and aliases: (label, code)."""
    table = lambda df, as_key, code: small(df.select(as_key.alias("__key"), F.col("code").alias(code)).groupBy("__key").agg(F.min(code).alias(code)))
    rows = countries.join(table(aliases, F.col("label"), "__alias").withColumnRenamed("__key", "__label"), F.col("label") == F.col("__label"), "left")
    rows = rows.withColumn("__key", F.lower("label")).join(table(names, F.lower("label"), "__known"), "__key", "left")
    failed = F.raise_error(F.concat(F.lit("country "), F.col("id").cast("string"), F.lit(" needs a code; its label is "), F.coalesce("label", F.lit("missing"))))
    return rows.withColumn("code", F.coalesce("code", "__alias", "__known", failed.cast("string"))).select(*countries.columns)


def mapped_counts(countries: DataFrame, domains: DataFrame) -> DataFrame:
    """country and how many domains it has, 0 included."""
    return countries.join(domains, "country", "left").groupBy("country").agg(F.count("domain").alias("mapped_domain_count"))


def suggestions(labels: DataFrame, available: DataFrame, n: int = 3) -> DataFrame:
    """label and the n available labels nearest to it by edit distance. Both are dimension tables: each has a row per country."""
    pairs = labels.select("label").distinct().crossJoin(small(available.select(F.col("label").alias("other")).distinct()))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("distance", "other"))
    near = pairs.withColumn("distance", F.levenshtein("label", "other")).withColumn("n", rank).where(F.col("n") <= n)
    return near.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "other"))), lambda x: x["other"]).alias("suggestions"))


def mapping_audit(countries: DataFrame, domains: DataFrame, available: DataFrame, examples: int = 5) -> DataFrame:
    """country, label, mapped_domain_count, the first domains, suggestions and mapping_supported of each requested country."""
    rank = F.row_number().over(Window.partitionBy("country").orderBy("domain"))
    firsts = domains.withColumn("n", rank).where(F.col("n") <= examples).groupBy("country").agg(F.array_sort(F.collect_list("domain")).alias("examples"))
    out = countries.join(mapped_counts(countries.select("country"), domains), "country").join(firsts, "country", "left").join(suggestions(countries, available), "label", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "country", "label", "mapped_domain_count", F.array_join(F.coalesce("examples", none), "|").alias("examples"),
        F.array_join(F.coalesce("suggestions", none), "|").alias("suggestions"), (F.col("mapped_domain_count") > 0).alias("mapping_supported"),
    )


def newest_catalogue(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows (url, host, lang) with title, domain and lang of their url's newest catalogue row, falling back on their own."""
    wanted = catalogue.join(rows.select("url").distinct(), "url", "left_semi")
    newest = wanted.groupBy("url").agg(F.max_by(F.struct("domain", "title", "lang"), F.struct("date", "title")).alias("c"))
    out = rows.join(newest, "url", "left")
    return out.withColumns({"domain": F.coalesce("c.domain", "host"), "title": F.col("c.title"), "lang": F.coalesce("c.lang", "lang")}).drop("c")
