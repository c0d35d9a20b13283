"""Readers of the raw files: detections, event catalogues, boundaries, timelines, interest indexes and dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import optional_number, optional_text
from quillspark.functions.values import in_range, share_of_percent, utc_time, whole_number
from quillspark.operators.matching import small
from quillspark.operators.store import require_known

DETECTION_COLUMNS = ("latitude", "longitude", "acq_date", "confidence", "frp", "type")
HAZARDS = {"WF": "wildfire", "FL": "flood", "TC": "tropical_cyclone"}
#: Properties of a boundary that may hold its country's code, the first valid one counting, and those of a region's label, country and
#: type: fixed by the files' publisher.
ISO3_PROPERTIES = ("ISO_A3", "ADM0_A3", "SOV_A3", "GU_A3", "iso3")
REGION_LABELS, REGION_COUNTRIES, REGION_TYPES = ("name_en", "name"), ("adm0_a3", "ADM0_A3"), ("type_en", "type")


def fail_unless(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(value.cast("string"), F.lit("null")))))


def json_page(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of many lines; text that is no JSON, or not of this shape, fails."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def collection(spark: SparkSession, path: str) -> DataFrame:
    """place and f (a variant) of each feature of a feature collection; any other document fails."""
    page = json_page(spark, path, "type string, features array<string>")
    known = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("no FeatureCollection")).cast("array<string>"))
    return page.select(F.posexplode(known).alias("place", "text")).select("place", F.parse_json("text").alias("f"))


def required(rows: DataFrame, what: str) -> DataFrame:
    """rows of a small file, which must not be empty."""
    if rows.isEmpty():
        raise ValueError(f"no usable {what}")
    return rows


def fire_detections(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, windows: DataFrame | None = None, file: str = r"([^/]+)$", foreign: str = "fail") -> DataFrame:
    """Typed detections; a missing column or a bad number fails.

    A day must lie between start and end and, where windows (file, start_day, end_day) are given, in one of the windows of the file that
    it was read from; a file is known by the first group of the pattern `file` in its path, and one without a window holds no day. foreign: 'fail' lets
    any other day fail, 'mark' adds the column foreign.
    """
    raw = spark.read.csv(path, header=True)
    missing = [c for c in DETECTION_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"no columns {', '.join(missing)}")
    if foreign not in ("fail", "mark"):
        raise ValueError("foreign is fail or mark")
    day = F.col("acq_date").cast("date")
    ok = in_range(day, start, end)
    if windows is not None:
        spans = windows.groupBy(F.col("file").alias("__file")).agg(F.collect_list(F.struct("start_day", "end_day")).alias("__spans"))
        raw = raw.withColumn("__file", F.regexp_extract("_metadata.file_path", file, 1)).join(small(spans), "__file", "left")
        ok &= F.coalesce(F.exists("__spans", lambda w: day.between(w["start_day"], w["end_day"])), F.lit(False))
    ok = F.coalesce(ok, F.lit(False))
    checked = day if foreign == "mark" else fail_unless(ok, day, "a day outside the window")
    return raw.select(
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), checked.alias("day"),
        "confidence", F.col("frp").cast("double").alias("frp"), F.col("type").cast("int").alias("fire_type"), *([(~ok).alias("foreign")] if foreign == "mark" else []),
    )


def event_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of an event catalogue whose code is one of HAZARDS; id, type and start must be there."""
    f = collection(spark, path)
    get = lambda p, kind="string": F.try_variant_get("f", f"$.properties.{p}", kind)
    rows = f.select(
        get("eventtype").alias("code"), get("eventid").alias("event_id"), get("name").alias("name"), get("description").alias("description"),
        get("fromdate").alias("start"), get("todate").alias("end"), get("datemodified").alias("modified"), get("alertlevel").alias("alert_level"),
        optional_number(get("alertscore")).alias("alert_score"), get("affectedcountries", "array<struct<iso3:string>>").alias("countries"), get("iso3").alias("iso3"),
        F.try_variant_get("f", "$.geometry.type", "string").alias("shape"), F.try_variant_get("f", "$.geometry.coordinates[0]", "double").alias("lon"), F.try_variant_get("f", "$.geometry.coordinates[1]", "double").alias("lat"),
    )
    known = rows.where(F.coalesce(F.col("code"), F.lit("?")).isin("?", *HAZARDS))
    code = fail_unless(F.col("code").isNotNull() & F.col("event_id").isNotNull() & F.col("start").isNotNull(), F.col("code"), "an event without type, id or start")
    hazard = F.element_at(F.create_map(*(F.lit(x) for kv in HAZARDS.items() for x in kv)), code)
    listed = F.transform(F.coalesce("countries", F.array().cast("array<struct<iso3:string>>")), lambda c: c["iso3"])
    return known.select(
        F.concat_ws(":", F.lit("event"), code, "event_id").alias("record_id"), hazard.alias("hazard_type"), "shape", "lon", "lat",
        F.coalesce(optional_text(F.col("name")), optional_text(F.col("description")), F.concat_ws(" ", hazard, "event_id")).alias("name"),
        utc_time(F.col("start")).alias("start_at"), F.coalesce(utc_time(F.col("end")), utc_time(F.col("start"))).alias("end_at"), utc_time(F.col("modified")).alias("source_updated_at"),
        "alert_level", "alert_score", F.array_distinct(F.array_compact(F.concat(listed, F.array("iso3")))).alias("codes"),
    )


def with_shape(features: DataFrame) -> DataFrame:
    """features with polygons (each with its rings; null for other shapes) and box: the one given, else that of the points."""
    rings = "array<array<array<double>>>"
    single, many = F.try_variant_get("f", "$.geometry.coordinates", rings), F.try_variant_get("f", "$.geometry.coordinates", f"array<{rings}>")
    shape = F.try_variant_get("f", "$.geometry.type", "string")
    polygons = F.when(shape == "Polygon", F.array(single)).when(shape == "MultiPolygon", many)
    points = F.flatten(F.flatten("polygons"))
    axis = lambda i: F.transform(points, lambda p: F.get(p, i))
    edges = {"west": (0, F.array_min(axis(0))), "south": (1, F.array_min(axis(1))), "east": (2, F.array_max(axis(0))), "north": (3, F.array_max(axis(1)))}
    rows = features.withColumns({"polygons": polygons, "bbox": F.try_variant_get("f", "$.bbox", "array<double>")}).where("polygons IS NOT NULL AND (bbox IS NULL OR size(bbox) = 4)")
    return rows.withColumns({name: F.coalesce(F.get("bbox", i), computed) for name, (i, computed) in edges.items()}).drop("bbox")


def first_property(names: tuple[str, ...], valid=lambda text: text.isNotNull()) -> Column:
    texts = [F.try_variant_get("f", f"$.properties.{p}", "string") for p in names]
    return F.coalesce(*(F.when(valid(t), t) for t in texts))


BOX = ("west", "south", "east", "north")


def boundaries(spark: SparkSession, path: str, codes: list[str] | None = None) -> DataFrame:
    """place, iso3, polygons (each with its rings) and box of the features of a country boundary file, gzipped or not.

    The code is the first of ISO3_PROPERTIES that has three characters and isn't -99, in capitals; KOS is XKX. codes: keep these
    alone. A file without any usable boundary fails.
    """
    code = first_property(ISO3_PROPERTIES, lambda t: (F.length(t) == 3) & (t != "-99"))
    rows = collection(spark, path).withColumn("iso3", F.when(code == "KOS", "XKX").otherwise(F.upper(code))).where("iso3 IS NOT NULL")
    if codes is not None:
        rows = rows.where(F.col("iso3").isin(codes))
    return required(with_shape(rows).select("place", "iso3", "polygons", *BOX), "country boundary")


def region_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """place, label, region_type, iso3 (of its country), polygons and box of a file of first-order regions; those without label or
    country go, and a file without any fails."""
    rows = collection(spark, path).withColumns({"label": first_property(REGION_LABELS), "iso3": F.upper(first_property(REGION_COUNTRIES)), "region_type": first_property(REGION_TYPES)})
    return required(with_shape(rows.where("label IS NOT NULL AND iso3 IS NOT NULL")).select("place", "label", "region_type", "iso3", "polygons", *BOX), "region boundary")


def timeline_counts(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """series, day, value and norm of a timeline file, of the days asked for; values must be whole numbers."""
    raw = json_page(spark, path, "timeline array<struct<series:string,data:array<struct<date:string,value:string,norm:string>>>>")
    points = raw.select(F.explode("timeline").alias("t")).select("t.series", F.explode("t.data").alias("d")).withColumn("day", F.to_date(utc_time(F.col("d.date"))))
    value, norm = whole_number(F.col("d.value")), whole_number(F.col("d.norm"))
    checked = F.when(value.isNotNull() | F.col("d.value").isNull(), value).otherwise(F.raise_error(F.concat(F.lit("no whole number: "), F.col("d.value"))))
    return points.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("series", "day", checked.alias("value"), norm.alias("norm"))


def timeline_shares(spark: SparkSession, path: str, countries: DataFrame, start: str, end: str) -> DataFrame:
    """country, day, share and absent (no series for it: shares of zero) of a file with a series per country label."""
    from quillspark.functions.text import label_key

    raw = json_page(spark, path, "timeline array<struct<series:string,data:array<struct<date:string,value:string>>>>")
    points = raw.select(F.explode("timeline").alias("t")).select(label_key(F.col("t.series")).alias("key"), F.explode("t.data").alias("d"))
    shares = points.select("key", F.to_date(utc_time(F.col("d.date"))).alias("day"), share_of_percent(F.col("d.value")).alias("share"))
    known = countries.select("country", label_key(F.col("label")).alias("key"))
    present = small(shares.select("key").distinct().withColumn("present", F.lit(True)))
    spine = known.withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    out = spine.join(shares, ["key", "day"], "left").join(present, "key", "left")
    return out.select("country", "day", F.when(F.col("present").isNull(), F.coalesce("share", F.lit(0.0))).otherwise(F.col("share")).alias("share"), F.col("present").isNull().alias("absent"))


def interest_index(wide: DataFrame, term: str) -> DataFrame:
    """day and value of an interest index: the column of the term, or the only one besides date and isPartial; values 0 to 100, days once."""
    others = [c for c in wide.columns if c not in ("date", "isPartial")]
    column = term if term in others else others[0] if len(others) == 1 else None
    if column is None:
        raise ValueError(f"no column for {term!r}")
    long = wide.select("date", F.col(column).cast("double").alias(column)).unpivot(["date"], [column], "term", "value")
    day = F.col("date").cast("date")
    counted = long.select(day.alias("day"), "value", F.count("*").over(Window.partitionBy(day)).alias("n"))
    return counted.select(fail_unless(F.col("n") == 1, F.col("day"), "a day twice").alias("day"), fail_unless(F.col("value").between(0, 100), F.col("value"), "no value of an index").alias("value"))


GROUPS = "map<string,struct<phrases:array<string>,segmentation:string,status:string>>"


def topic_table(spark: SparkSession, path: str) -> DataFrame:
    """dimension_id, label and groups of a file of topics or signals (JSON lines); see phrase_table."""
    rows = spark.read.option("mode", "FAILFAST").schema(f"id string, label string, groups {GROUPS}").json(path)
    return rows.select(fail_unless(F.col("id").isNotNull() & (F.size("groups") > 0), F.col("id"), "a dimension without id or phrases").alias("dimension_id"), "label", "groups")


def query_table(spark: SparkSession, path: str) -> DataFrame:
    """Queries with their own and their topic's lists (JSON lines), as expanded_queries takes them."""
    lists = ", ".join(f"{of}_{c} array<string>" for of in ("topic", "query") for c in ("terms", "languages", "geographies"))
    return spark.read.option("mode", "FAILFAST").schema(f"topic_id string, query_id string, {lists}").json(path)


def country_table(spark: SparkSession, path: str, selected: list[str] | None = None) -> DataFrame:
    """country, label, ngram_label (the label unless given), geo and iso3 of the enabled countries (JSON lines); unknown selected ones, codes of
    another form and repeated ids fail."""
    raw = spark.read.option("mode", "FAILFAST").schema("id string, label string, enabled boolean, geo string, iso3 string, ngram_label string").json(path)
    if selected is not None:
        require_known(spark.createDataFrame([(x,) for x in selected], "id string"), raw, "id")
        raw = raw.where(F.col("id").isin(selected))
    form = lambda c, letters: F.col(c).isNull() | F.col(c).rlike(f"^[A-Z]{{{letters}}}$")
    once = F.count("*").over(Window.partitionBy("id")) == 1
    checked = fail_unless(once & (F.length("label") > 0) & form("geo", 2) & form("iso3", 3), F.col("id"), "a country given twice, or without label, or with a code of another form")
    rows = raw.select(checked.alias("country"), "label", F.coalesce("ngram_label", "label").alias("ngram_label"), "geo", "iso3", F.coalesce("enabled", F.lit(True)).alias("enabled"))
    return rows.where("enabled").drop("enabled")


def official_domain_table(spark: SparkSession, path: str) -> DataFrame:
    """country and domain (lower-cased, no leading dots) of a file of domain lists per country (JSON lines); a path, a blank or a repeat fails."""
    raw = spark.read.option("mode", "FAILFAST").schema("country string, domains array<string>").json(path)
    rows = raw.select("country", F.explode("domains").alias("d")).select("country", F.regexp_replace(F.lower(F.trim("d")), r"^\.+", "").alias("domain"))
    once = F.count("*").over(Window.partitionBy("country", "domain")) == 1
    return rows.select("country", fail_unless(once & (F.col("domain") != "") & ~F.contains("domain", F.lit("/")), F.col("domain"), "no bare host name, or one given twice").alias("domain"))


def phrase_table(topics: DataFrame) -> DataFrame:
    """One row per phrase of topics (dimension_id, groups: language -> {phrases, segmentation, status}), with its group's defaults."""
    groups = topics.select("dimension_id", F.explode("groups").alias("language", "g"))
    return groups.select(
        "dimension_id", F.nullif("language", F.lit("any")).alias("language"), F.explode("g.phrases").alias("phrase"),
        F.coalesce("g.segmentation", F.lit("space")).alias("segmentation"), F.coalesce("g.status", F.lit("draft")).alias("status"),
    )


def expanded_queries(topics: DataFrame) -> DataFrame:
    """A query's own lists or its topic's, terms of both, and a row per language and geography (null where it has none)."""
    none = F.array().cast("array<string>")
    own = lambda c: F.coalesce(f"query_{c}", f"topic_{c}")
    terms = F.array_distinct(F.concat(F.coalesce("topic_terms", none), F.coalesce("query_terms", none)))
    out = topics.select("topic_id", "query_id", terms.alias("terms"), own("languages").alias("ls"), own("geographies").alias("gs"))
    return out.select("topic_id", "query_id", "terms", "gs", F.explode_outer("ls").alias("language")).select("topic_id", "query_id", "terms", "language", F.explode_outer("gs").alias("geography"))


def decoded(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, schema))


def encoded_map(column: str) -> Column:
    """A map as JSON with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
