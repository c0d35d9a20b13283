"""Writers: archives, comparison and review tables, event features and serving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.store import last_rows, ordered, scan


def append_envelopes(rows: DataFrame, path: str) -> None:
    """Raw responses as JSON lines, a folder per run; nothing written is changed."""
    rows.write.mode("append").partitionBy("run_id").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


#: Columns of the review table, in its order: fixed by its readers.
REVIEW = (
    "record_id", "date", "source", "topic_id", "geography", "url", "domain", "published_at", "outlet_name", "outlet_logo", "outlet_twitter", "title", "image_url", "description", "language",
    "author", "political", "political_actor", "government_action", "party_politics", "official_source", "matched_topic_phrases", "matched_political_phrases", "match_evidence_total",
    "match_evidence_truncated", "match_evidence_json", "collected_at", "metadata_json",
)
FLAGS = ("political_actor", "government_action", "party_politics", "official_source")


def review_rows(articles: DataFrame, political_only: bool = False, **filters) -> DataFrame:
    """Articles for review: REVIEW columns, those that articles lacks as null.

    political is the union of FLAGS; phrases of evidence (array of structs with kind and phrase) are joined in first-seen order;
    evidence and metadata (a map) become JSON with sorted keys; dates are ISO texts, and empty ones for nulls.
    """
    rows = scan(articles, **filters)
    have = set(rows.columns)
    rows = rows.withColumns({c: F.lit(None).cast("boolean" if c in FLAGS else "string") for c in REVIEW if c not in have and not c.startswith("match")})
    political = F.lit(False)
    for flag in FLAGS:
        political |= F.coalesce(flag, F.lit(False))
    rows = rows.withColumn("political", political)
    if political_only:
        rows = rows.where("political")
    phrases = lambda kind: F.array_join(F.array_distinct(F.transform(F.filter("evidence", lambda x: x["kind"] == kind), lambda x: x["phrase"])), " | ")
    named = [f.name for f in rows.schema["evidence"].dataType.elementType]
    item = lambda x: F.struct(*(x[c].alias(c) for c in sorted(named)))
    made = {
        "matched_topic_phrases": phrases("topic"),
        "matched_political_phrases": phrases("political_signal"),
        "match_evidence_total": F.col("evidence_total") if "evidence_total" in have else F.size("evidence").cast("long"),
        "match_evidence_truncated": F.col("truncated") if "truncated" in have else F.lit(False),
        "match_evidence_json": F.to_json(F.transform("evidence", item)),
        "metadata_json": F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))) if "metadata" in have else F.lit("{}"),
    }
    dates = {c: F.coalesce(F.date_format(c, "yyyy-MM-dd" if c == "date" else "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")) for c in ("date", "published_at", "collected_at")}
    return rows.withColumns(made).withColumns(dates).select(*REVIEW)


def event_geojson(events: DataFrame) -> DataFrame:
    """One JSON text per event with a point; the others go."""
    points = events.where((F.col("shape") == "Point") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    properties = F.struct(*(F.col(c) for c in events.columns if c not in ("lon", "lat", "shape")))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


#: Columns of the served table, in its order, and those of them that a window shows: fixed by its readers.
SERVING = (
    "record_id", "observation_date", "source", "topic_id", "query_id", "geography", "language", "matched_count", "country_attention_share", "attention_index", "political_count",
    "political_actor_count", "government_action_count", "party_politics_count", "official_source_count", "collected_at",
)
SHOWN = ("observation_date", "source", "topic_id", "geography", "matched_count", "country_attention_share", "attention_index", *SERVING[10:15])


def serving_rows(trends: DataFrame, topics: list[str], order: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """What is served of the topics and days: SERVING columns, of each record_id the row with the largest order (its arrival)."""
    rows = scan(trends.withColumnRenamed("day", "observation_date"), start, end, day="observation_date", any_of={"topic_id": topics})
    return last_rows(rows.select(*dict.fromkeys((*SERVING, order))), "record_id", order).select(*SERVING)


def serving_window(served: DataFrame, start: str, end: str, topics: list[str], include: list | None = None, exclude: list | None = None, offset: int = 0, limit: int = 1000) -> DataFrame:
    """A page of served rows: SHOWN columns, by day, topic and geography."""
    rows = scan(served, start, end, day="observation_date", any_of={"topic_id": topics})
    if include:
        rows = rows.where(F.col("geography").isin(include))
    if exclude:
        rows = rows.where(~F.col("geography").isin(exclude))
    return ordered(rows, "observation_date", "topic_id", "geography").offset(offset).limit(limit).select(*SHOWN)
