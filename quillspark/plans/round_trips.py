"""Queries of sources, sinks and streams: the driver's tables written to the shared folder in a source's format, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import values as V
from quillspark.operators import ledger, series, store
from quillspark.plans.queries import NAMED, TREND_ID, countries, domain_map, named_events, query, trends, two_sources
from quillspark.plans.views import Views
from quillspark.session import new_folder
from quillspark.sources import exports, files
from quillspark.streaming import attention


def in_folder(v: Views, name: str, write) -> str:
    path = new_folder(v.spark, name)
    write(path)
    return path


#: Pages of a catalogue that a task writes, give or take those that hash together.
PAGES = 8


def documents(v: Views, rows: DataFrame, name: str, by: str, parts: int | None = None) -> str:
    """A file for each value of by, of the JSON text in the only other column; written by so many tasks, if given."""
    return in_folder(v, name, lambda path: (rows.repartition(parts, by) if parts else rows.repartition(by)).write.partitionBy(by).text(path)) + "/*/part-*"


@query("""SELECT day, topic_id, geography, '{"geography":"' || geography || '","topic":"' || topic_id || '"}' AS metadata, topic_id AS topic FROM @v_panel""")
def a08_json_columns(v: Views) -> DataFrame:
    rows = v.panel.withColumn("metadata", F.create_map(F.lit("topic"), "topic_id", F.lit("geography"), F.col("geography").cast("string")))
    text = rows.select("day", "topic_id", "geography", files.encoded_map("metadata").alias("metadata"))
    path = in_folder(v, "json-columns", lambda p: text.write.json(p))
    back = v.spark.read.schema("day date, topic_id string, geography long, metadata string").json(path)
    return files.decoded(back.withColumn("text", F.col("metadata")), "metadata", "map<string,string>").select("day", "topic_id", "geography", F.col("text").alias("metadata"), F.col("metadata")["topic"].alias("topic"))


FIRST_DAY, LAST_DAY, FILE_DAYS = "2000-01-01", "2099-12-31", 5


def detection_files(v: Views, late: Column) -> tuple[str, DataFrame]:
    """Folders of detections by the first day of their window of the ledger (of the next one where late), and the windows."""
    first = F.lit(FIRST_DAY).cast("date")
    start = F.date_add(first, (F.floor(F.datediff("day", first) / FILE_DAYS) * FILE_DAYS + F.when(late, FILE_DAYS).otherwise(0)).cast("int"))
    rows = v.hotspots.select(start.alias("window"), "latitude", "longitude", F.col("day").alias("acq_date"), F.lit("0130").alias("acq_time"), "confidence", "frp", F.col("fire_type").alias("type"))
    path = in_folder(v, "detections", lambda p: rows.repartition("window").write.partitionBy("window").option("header", True).csv(p))
    planned = ledger.windows(v.spark.createDataFrame([("detections",)], "query_id string"), FIRST_DAY, LAST_DAY, FILE_DAYS)
    return path, planned.select(F.col("start_day").cast("string").alias("file"), "start_day", "end_day")


@query("SELECT day, latitude, longitude, confidence, frp, fire_type FROM @v_hotspots")
def a09_fire_detections(v: Views) -> DataFrame:
    path, windows = detection_files(v, F.lit(False))
    return files.fire_detections(v.spark, path, FIRST_DAY, LAST_DAY, windows, "window=([^/]+)/").select("day", "latitude", "longitude", "confidence", "frp", "fire_type")


@query(f"SELECT day, fire_type, count(*) AS detections, count(*) FILTER (WHERE event_id % 100 = 7) AS foreign_days FROM @v_hotspots WHERE day BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' GROUP BY 1, 2")
def a09_foreign_days(v: Views) -> DataFrame:
    """Some detections lie in the file of the window after theirs."""
    path, windows = detection_files(v, F.col("event_id") % 100 == 7)
    read = files.fire_detections(v.spark, path, FIRST_DAY, LAST_DAY, windows, "window=([^/]+)/", foreign="mark")
    return read.groupBy("day", "fire_type").agg(F.count("*").alias("detections"), F.count_if("foreign").alias("foreign_days"))


def geometry(kind: str, coordinates: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))


def feature_pages(features: DataFrame) -> DataFrame:
    """One feature collection as JSON for each page of features (page, feature)."""
    pages = features.groupBy("page").agg(F.collect_list("feature").alias("features"))
    return pages.select("page", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))


@query("""SELECT 'event:' || CASE hazard_type WHEN 'flood' THEN 'FL' WHEN 'wildfire' THEN 'WF' ELSE 'TC' END || ':' || record_id AS record_id, hazard_type, CASE WHEN record_id % 4 = 0 THEN hazard_type || ' ' || record_id ELSE 'Event ' || record_id END AS name,
CAST(start_day AS DATE) AS start_day, CAST(end_day AS DATE) AS end_day, alert_level, alert_score, lon, lat, CASE WHEN record_id % 2 = 0 THEN nation_a || ',' || nation_b ELSE CAST(nation_a AS VARCHAR) END AS codes FROM @v_events""")
def a10_event_catalogue(v: Views) -> DataFrame:
    """Pages of the catalogue hold the events of 10,000 ids at most; tasks are as many as pages ask for, whatever the session's number."""
    e = v.hazard_events
    code = F.when(F.col("hazard_type") == "flood", "FL").when(F.col("hazard_type") == "wildfire", "WF").otherwise("TC")
    properties = F.struct(
        code.alias("eventtype"), F.col("record_id").cast("string").alias("eventid"), F.when(F.col("record_id") % 4 == 0, " ").otherwise(F.concat(F.lit("Event "), "record_id")).alias("name"),
        F.date_format("start_day", "yyyy-MM-dd'T'HH:mm:ss").alias("fromdate"), F.date_format("end_day", "yyyyMMdd'T'HHmmss'Z'").alias("todate"), F.col("alert_level").alias("alertlevel"), F.col("alert_score").cast("string").alias("alertscore"),
        F.array(F.struct(F.col("nation_a").cast("string").alias("iso3"))).alias("affectedcountries"), F.when(F.col("record_id") % 2 == 0, F.col("nation_b")).otherwise(F.col("nation_a")).cast("string").alias("iso3"),
    )
    foreign = F.struct(F.lit("EQ").alias("eventtype"), F.col("record_id").cast("string").alias("eventid"))
    feature = lambda of: F.struct(F.lit("Feature").alias("type"), geometry("Point", F.array("lon", "lat")).alias("geometry"), of.alias("properties"))
    page = F.floor(F.col("record_id") / 10_000).alias("page")
    both = e.select(page, F.to_json(feature(properties)).alias("f")).unionByName(e.where("record_id % 5 = 0").select(page, F.to_json(feature(foreign)).alias("f")))
    parts = max(1, -(-e.select(page).distinct().count() // PAGES))
    pages = both.repartition(parts, "page").groupBy("page").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    got = files.event_features(v.spark, documents(v, pages, "catalogue", "page", parts))
    return got.select("record_id", "hazard_type", "name", F.to_date("start_at").alias("start_day"), F.to_date("end_at").alias("end_day"), "alert_level", "alert_score", "lon", "lat", F.array_join("codes", ",").alias("codes"))


def box_features(v: Views, properties: Column) -> DataFrame:
    """The rectangles of nations, some of them as one of two polygons, some with a box given."""
    ring = F.transform(F.array_append(F.get(F.get("polygons", 0), 0), F.get(F.get(F.get("polygons", 0), 0), 0)), lambda p: p)
    single = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry("Polygon", F.array(ring)).alias("geometry")))
    many = F.to_json(F.struct(F.lit("Feature").alias("type"), F.array("west", "south", "east", "north").alias("bbox"), properties.alias("properties"), geometry("MultiPolygon", F.array(F.array(ring), F.array(ring))).alias("geometry")))
    named = v.bounds.join(F.broadcast(countries(v)), F.col("area") == F.col("country"))  # 25 nations
    rows = named.select(F.lit(0).alias("page"), F.when(F.col("area") % 2 == 0, single).otherwise(many).alias("f"))
    return rows.groupBy("page").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))


@query("SELECT CASE WHEN n.n_nationkey % 7 = 0 THEN 'XKX' ELSE upper(n.n_name[1:3]) END AS iso3, b.west, b.south, b.east, b.north, CASE WHEN b.area % 2 = 0 THEN 1 ELSE 2 END AS polygons FROM @v_bounds b JOIN nation n ON n.n_nationkey = b.area WHERE n.n_nationkey % 5 <> 4")
def a11_country_boundaries(v: Views) -> DataFrame:
    """Some codes stand in a later property, some are -99 or too long, and some countries have none."""
    code = F.when(F.col("area") % 7 == 0, "KOS").otherwise(F.lower(F.substring("label", 1, 3)))
    first = F.when(F.col("area") % 5 == 4, "four").when(F.col("area") % 3 == 0, "-99").otherwise(code)
    properties = F.struct(first.alias("ISO_A3"), F.when(F.col("area") % 5 != 4, code).alias("SOV_A3"), F.col("label").alias("NAME"))
    got = files.boundaries(v.spark, documents(v, box_features(v, properties), "boundaries", "page"))
    return got.select("iso3", "west", "south", "east", "north", F.size("polygons").alias("polygons"))


@query("SELECT n.n_name AS label, upper(n.n_name[1:3]) AS iso3, CASE WHEN b.area % 3 = 0 THEN 'Province' END AS region_type, b.west, b.north FROM @v_bounds b JOIN nation n ON n.n_nationkey = b.area WHERE n.n_nationkey % 5 <> 4")
def a11_region_boundaries(v: Views) -> DataFrame:
    label = F.when(F.col("area") % 5 != 4, F.col("label"))
    properties = F.struct(F.when(F.col("area") % 2 == 0, label).alias("name_en"), label.alias("name"), F.lower(F.substring("label", 1, 3)).alias("ADM0_A3"), F.when(F.col("area") % 3 == 0, "Province").alias("type"))
    return files.region_boundaries(v.spark, documents(v, box_features(v, properties), "regions", "page")).select("label", "iso3", "region_type", "west", "north")


def timeline(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """A timeline document for each value of by (page), with one series (series, date and values)."""
    point = F.struct(F.date_format("day", "yyyyMMdd'T'HHmmss'Z'").alias("date"), *(F.col(c).cast("string").alias(c) for c in values))
    each = rows.groupBy(by, "series").agg(F.collect_list(point).alias("data"))
    return each.select(F.col(by).alias("page"), F.to_json(F.struct(F.array(F.struct("series", "data")).alias("timeline"))).alias("value"))


@query("SELECT topic_id AS series, day, CAST(sum(matched_count) AS BIGINT) AS value, CAST(sum(monitored_count) AS BIGINT) AS norm FROM @v_panel WHERE day BETWEEN '1994-01-01' AND '1995-12-31' GROUP BY 1, 2")
def a12_timeline_counts(v: Views) -> DataFrame:
    daily = v.panel.groupBy("topic_id", "day").agg(F.sum("matched_count").alias("value"), F.sum("monitored_count").cast("long").alias("norm"))
    path = documents(v, timeline(daily.withColumn("series", F.col("topic_id")), "topic_id", ["value", "norm"]), "timelines", "page")
    return files.timeline_counts(v.spark, path, "1994-01-01", "1995-12-31")


SHARES = "SELECT geography, day, 100 * sum(political_count) / sum(matched_count) AS percent FROM @v_panel WHERE day BETWEEN '1995-01-01' AND '1995-03-31' AND geography % 4 <> 3 GROUP BY 1, 2"


@query(f"""WITH x AS ({SHARES}) SELECT n.n_nationkey::BIGINT AS country, CAST(d AS DATE) AS day, round(CASE WHEN p.geography IS NULL THEN 0 ELSE x.percent / 100 END, 9) AS share, p.geography IS NULL AS absent
FROM nation n CROSS JOIN generate_series(DATE '1995-01-01', DATE '1995-03-31', INTERVAL 1 DAY) g(d) LEFT JOIN (SELECT DISTINCT geography FROM x) p ON p.geography = n.n_nationkey LEFT JOIN x ON x.geography = n.n_nationkey AND x.day = d""")
def a13_country_shares(v: Views) -> DataFrame:
    panel = store.scan(v.panel, "1995-01-01", "1995-03-31").where("geography % 4 <> 3").groupBy("geography", "day").agg((100 * F.sum("political_count") / F.sum("matched_count")).alias("value"))
    named = panel.join(F.broadcast(countries(v)), F.col("geography") == F.col("country")).withColumn("series", F.concat(F.initcap("label"), F.lit(" Volume Intensity")))
    path = documents(v, timeline(named, "country", ["value"]), "shares", "page")
    out = files.timeline_shares(v.spark, path, countries(v), "1995-01-01", "1995-03-31")
    return out.select("country", "day", F.round("share", 9).alias("share"), "absent")


INDEX = "SELECT day, round(100.0 * n / max(n) OVER (), 6) AS value FROM (SELECT day, CAST(sum(matched_count) AS DOUBLE) AS n FROM @v_panel GROUP BY 1)"


@query(INDEX)
def a14_interest_index(v: Views) -> DataFrame:
    daily = v.panel.groupBy("day").agg(F.sum("matched_count").cast("double").alias("n"))
    most = daily.agg(F.max("n")).first()[0] or 1.0
    wide = daily.select(F.col("day").cast("string").alias("date"), F.round(100.0 * F.col("n") / most, 6).alias("heat"), F.lit(False).alias("isPartial"))
    path = in_folder(v, "interest", lambda p: exports.write_csv(wide, p))
    return files.interest_index(v.spark.read.csv(path, header=True), "heat")


@query("SELECT dimension_id, language, phrase, segmentation, CASE WHEN segmentation = 'character' THEN 'validated' ELSE 'draft' END AS status FROM @v_phrases")
def a15_phrase_tables(v: Views) -> DataFrame:
    """Topics and signals: a line for each dimension and segmentation, with its phrases by language; defaults are left out."""
    rows = v.phrases.groupBy("dimension_id", "segmentation", F.coalesce("language", F.lit("any")).alias("language")).agg(F.collect_list("phrase").alias("phrases"))
    character = F.col("segmentation") == "character"
    group = F.struct("phrases", F.when(character, "character").alias("segmentation"), F.when(character, "validated").alias("status"))
    lines = rows.groupBy("dimension_id", "segmentation").agg(F.map_from_entries(F.collect_list(F.struct("language", group.alias("g")))).alias("groups"))
    path = in_folder(v, "topics", lambda p: lines.select(F.col("dimension_id").alias("id"), F.col("dimension_id").alias("label"), "groups").write.json(p))
    return files.phrase_table(files.topic_table(v.spark, path)).select("dimension_id", "language", "phrase", "segmentation", "status")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS country, n_name AS label, CASE WHEN n_nationkey % 3 = 0 THEN 'N ' || n_name ELSE n_name END AS ngram_label, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name[1:2]) END AS geo, upper(n_name[1:3]) AS iso3 FROM nation WHERE n_nationkey % 6 <> 5")
def a15_country_table(v: Views) -> DataFrame:
    key = F.col("n_nationkey")
    lines = v.table("nation").select(
        key.cast("string").alias("id"), F.col("n_name").alias("label"), F.when(key % 6 == 5, False).alias("enabled"), F.when(key % 2 == 0, F.upper(F.substring("n_name", 1, 2))).alias("geo"),
        F.upper(F.substring("n_name", 1, 3)).alias("iso3"), F.when(key % 3 == 0, F.concat(F.lit("N "), "n_name")).alias("ngram_label"),
    )
    return files.country_table(v.spark, in_folder(v, "countries", lambda p: lines.write.json(p)))


@query("SELECT CAST(country AS VARCHAR) AS country, domain FROM @v_map")
def a15_official_domains(v: Views) -> DataFrame:
    lists = domain_map(v).groupBy(F.col("country").cast("string").alias("country")).agg(F.collect_list(F.concat(F.lit(" ."), F.upper("domain"))).alias("domains"))
    return files.official_domain_table(v.spark, in_folder(v, "official", lambda p: lists.write.json(p)))


@query("SELECT topic_id, CAST(n_nationkey AS VARCHAR) AS geography, language FROM (SELECT DISTINCT dimension_id AS topic_id FROM @v_phrases WHERE evidence_kind = 'topic') t, nation, (VALUES ('en'), ('fr')) l(language) WHERE n_regionkey = 2")
def a15_query_table(v: Views) -> DataFrame:
    places = v.table("nation").where("n_regionkey = 2").agg(F.collect_set(F.col("n_nationkey").cast("string")).alias("query_geographies"))
    topics = v.phrases.where("evidence_kind = 'topic'").select(F.col("dimension_id").alias("topic_id")).distinct()
    lines = topics.crossJoin(F.broadcast(places)).withColumns({"query_id": F.lit("q"), "topic_languages": F.array(F.lit("en"), F.lit("fr")), "topic_geographies": F.array(F.lit("none"))})  # one row of places
    rows = files.expanded_queries(files.query_table(v.spark, in_folder(v, "queries", lambda p: lines.write.json(p))))
    return rows.select("topic_id", "geography", "language")


@query("SELECT day, topic_id, geography, CASE WHEN topic_id = 'R' THEN matched_count + 1 ELSE matched_count END AS matched_count FROM @v_panel")
def a17_partitioned_dataset(v: Views) -> DataFrame:
    """All topics written, then one of them again: only its partition is replaced."""
    rows = v.panel.select("day", "topic_id", "geography", "matched_count")

    def write(path: str) -> None:
        store.write_partitioned(rows, path, ["topic_id"], ["day", "geography"])
        store.write_partitioned(rows.where("topic_id = 'R'").withColumn("matched_count", F.col("matched_count") + 1), path, ["topic_id"], ["day", "geography"])

    return v.spark.read.schema(rows.schema).parquet(in_folder(v, "dataset", write))


@query("SELECT CAST(user_id % 3 AS INT) AS run_id, event_id, event_type FROM events UNION ALL SELECT 3, event_id, 'again' FROM events WHERE event_type = 'click'")
def a18_envelopes(v: Views) -> DataFrame:
    rows = v.table("events").select((F.col("user_id") % 3).cast("int").alias("run_id"), "event_id", "event_type")

    def write(path: str) -> None:
        exports.append_envelopes(rows, path)
        exports.append_envelopes(rows.where("event_type = 'click'").withColumns({"run_id": F.lit(3), "event_type": F.lit("again")}), path)

    return v.spark.read.schema("run_id int, event_id long, event_type string").json(in_folder(v, "envelopes", write)).select("run_id", "event_id", "event_type")


@query("SELECT day, lang, host, count(*) AS articles FROM @v_articles GROUP BY 1, 2, 3")
def a19_derived_dataset(v: Views) -> DataFrame:
    """Overwritten: of two writes the second one is read."""
    records = v.articles.withColumns({"record_id": V.record_id("article", "doc_id"), "arrival": F.col("doc_id")})
    counts = series.daily_counts(records, ["lang", "host"])

    def write(path: str) -> None:
        store.write_single(counts.withColumn("articles", F.lit(0).cast("long")), path)
        store.write_single(counts, path)

    return v.spark.read.schema(counts.schema).parquet(in_folder(v, "daily", write))


@query("SELECT topic_id, geography, count(*) AS paired_days, count(*) FILTER (WHERE matched_count = 0) AS left_zero_days FROM @v_panel WHERE day >= '1993-06-01' GROUP BY 1, 2")
def a20_comparison_file(v: Views) -> DataFrame:
    out = series.compare_sources(two_sources(v), "left", "right", "matched_count", "matched_count")
    path = in_folder(v, "comparison", lambda p: exports.write_csv(out, p))
    back = v.spark.read.csv(path, header=True)
    return back.select("topic_id", F.col("geography").cast("long").alias("geography"), F.col("paired_days").cast("long").alias("paired_days"), F.col("left_zero_days").cast("long").alias("left_zero_days"))


@query(f"SELECT record_id, lon, lat, hazard_type, map_country AS country FROM ({NAMED}) WHERE record_id % 8 > 1")
def a23_event_geojson(v: Views) -> DataFrame:
    """Events of eight in turn: two have no point."""
    turn = F.col("record_id") % 8
    shaped = named_events(v).withColumns({"shape": F.when(turn == 0, "Polygon").otherwise("Point"), "lon": F.when(turn != 1, F.col("lon"))})
    rows = shaped.select("record_id", "hazard_type", "map_country", "shape", "lon", "lat")
    path = in_folder(v, "geojson", lambda p: exports.event_geojson(rows).write.text(p))
    back = v.spark.read.text(path).select(F.from_json("value", "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<record_id:long,hazard_type:string,map_country:string>").alias("f"))
    at = lambda i: F.get("f.geometry.coordinates", i)
    return back.select("f.properties.record_id", at(0).alias("lon"), at(1).alias("lat"), "f.properties.hazard_type", F.col("f.properties.map_country").alias("country"))


@query("SELECT event_id AS record_id, CAST(user_id % 4 AS INT) AS source, CASE WHEN event_type = 'view' THEN 'third' WHEN event_type = 'click' THEN 'second' ELSE 'first' END AS version FROM events")
def j01_ingest(v: Views) -> DataFrame:
    """Two landings, and a batch that names some records twice: the last arrival of each stays."""
    rows = v.table("events").select(F.col("event_id").alias("record_id"), (F.col("user_id") % 4).cast("int").alias("source"), "event_type", F.lit("first").alias("version"), F.lit(1).alias("arrival"))
    again = rows.where("event_type IN ('click', 'view')").withColumns({"version": F.lit("second"), "arrival": F.lit(2)})
    third = rows.where("event_type = 'view'").withColumns({"version": F.lit("third"), "arrival": F.lit(3)})
    landing, data, marks = (new_folder(v.spark, x) for x in ("landing", "ingested", "marks"))
    schema = rows.drop("event_type").schema
    for batch in (rows, again.unionByName(third)):
        batch.drop("event_type").write.mode("append").parquet(landing)
        attention.ingest(v.spark, landing, schema, data, marks, ["source"], ["record_id"], "arrival").awaitTermination()
    return v.spark.read.schema(schema).parquet(data).select("record_id", "source", "version")


@query("SELECT dimension_id AS topic_id, count(DISTINCT url) AS urls FROM @v_matches WHERE evidence_kind = 'topic' GROUP BY 1")
def j04_live_matches(v: Views) -> DataFrame:
    """Some four batches, of a quarter of the files each; urls come again in later ones. Each task writes its own files, so that texts aren't
    shuffled and a batch is read by many."""
    quarter = max(1, -(-v.table("documents").count() // 4))
    path = in_folder(v, "live-articles", lambda p: v.articles.select("url", "lang", "text").write.option("maxRecordsPerFile", quarter).parquet(p))
    files_a_batch = max(1, -(-v.spark.read.schema("url string").parquet(path).select("_metadata.file_path").distinct().count() // 4))
    stream = v.spark.readStream.schema("url string, lang string, text string").option("maxFilesPerTrigger", files_a_batch).parquet(path)
    matched, marks = new_folder(v.spark, "live-matches"), new_folder(v.spark, "marks")
    attention.live_matches(stream, v.phrases, matched, marks).awaitTermination()
    return attention.live_url_counts(v.spark.read.schema("topic_id string, url string").parquet(matched))


#: Events arrive by their day, every tenth one up to 12 days later; a batch takes four days.
ARRIVALS = "SELECT *, CAST(floor((datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + CASE WHEN event_id % 10 = 0 THEN event_id % 13 ELSE 0 END) / 4) AS INT) AS batch FROM events"


@query(f"""WITH a AS ({ARRIVALS}), b AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS seen FROM a GROUP BY 1)
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS articles FROM a JOIN b USING (batch) WHERE b.seen IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > b.seen - INTERVAL 1 DAY GROUP BY 1, 2""")
def j02_late_rows(v: Views) -> DataFrame:
    """Files in the order of arrival, one a batch, in append mode: a row counts unless its day ended a day or more before the latest time
    seen up to the batch before last (a batch judges lateness by the watermark that the one before it began with). Two last files from far ahead close all days; their own stay open."""
    late = F.when(F.col("event_id") % 10 == 0, F.col("event_id") % 13).otherwise(0)
    events = v.table("events").select("ts", "event_type", F.floor((F.datediff("ts", F.lit("2024-01-01").cast("date")) + late) / 4).cast("int").alias("batch"))
    landing = new_folder(v.spark, "arrivals")
    batches = [r[0] for r in events.select("batch").distinct().orderBy("batch").collect()]  # a number for every four days
    for n in batches:
        events.where(F.col("batch") == n).drop("batch").coalesce(1).write.mode("append").parquet(landing)
    for ahead in ("2100-01-01", "2100-02-01"):
        events.drop("batch").limit(1).withColumn("ts", F.lit(ahead).cast(events.schema["ts"].dataType)).coalesce(1).write.mode("append").parquet(landing)
    stream = v.spark.readStream.schema(events.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(landing)
    return attention.drained(attention.live_counts(stream, ["event_type"])).where("day < '2100-01-01'")


COLLIDES = "geography % 10 = 5"


@query(f"""SELECT {TREND_ID} AS record_id, topic_id, CASE WHEN geography % 4 = 1 AND NOT {COLLIDES} THEN 'q2' ELSE 'q1' END AS query_expression, CASE WHEN geography % 2 = 1 AND NOT {COLLIDES} THEN matched_count + 5 ELSE matched_count END AS matched_count, 'merged' AS state, topic_id AS was FROM @v_panel
UNION ALL SELECT {TREND_ID}, 'Z', CASE WHEN geography % 4 = 1 THEN 'q2' ELSE 'q1' END, matched_count + 5, 'quarantined', topic_id FROM @v_panel WHERE {COLLIDES}""")
def h02_collisions(v: Views) -> DataFrame:
    """A merge in which some records claim the ids of others fails and leaves them in quarantine; without them it goes through. Records
    of n-grams may change their query expression."""
    path, quarantine = new_folder(v.spark, "merged"), new_folder(v.spark, "quarantine")
    old = trends(v).select("record_id", "topic_id", "geography", "matched_count", F.when(F.col("geography") % 4 == 1, "ngrams").otherwise("lines").alias("source"), F.lit("q1").alias("query_expression"))
    changed = F.when(F.col("geography") % 4 == 1, "q2").otherwise(F.col("query_expression"))
    new = old.where("geography % 2 = 1").withColumns({"matched_count": F.col("matched_count") + 5, "query_expression": changed, "topic_id": F.when(F.expr(COLLIDES), "Z").otherwise(F.col("topic_id"))})
    merge = lambda rows: store.merge_into(v.spark, path, rows, ["topic_id", "geography", "source", "query_expression"], ["matched_count"], ["source"], ["record_id"], quarantine, changeable={"query_expression": "n.source = 'ngrams'"})
    merge(old)
    try:
        merge(new)
    except store.CollisionError:
        merge(new.where(f"NOT {COLLIDES}"))
    shown = ["record_id", "topic_id", "query_expression", "matched_count"]
    kept = v.spark.read.schema(old.schema).parquet(path).select(*shown, F.lit("merged").alias("state"), F.col("topic_id").alias("was"))
    return kept.unionByName(v.spark.read.parquet(quarantine).select(*shown, F.lit("quarantined").alias("state"), F.col("was.topic_id").alias("was")))


@query("""WITH t AS (SELECT *, CASE WHEN geography < 13 THEN 'lines' ELSE 'others' END AS src FROM @v_panel), c AS (SELECT day, geography, CAST(sum(monitored_count) AS DOUBLE) AS n FROM @v_panel WHERE geography = 3 AND day >= '1998-01-01' GROUP BY 1, 2)
SELECT t.day, t.src AS source, t.topic_id, t.geography, coalesce(c.n, t.monitored_count) AS monitored_count, t.matched_count / nullif(coalesce(c.n, t.monitored_count), 0) AS country_share FROM t LEFT JOIN c ON c.day = t.day AND c.geography = t.geography AND t.src = 'lines'""")
def h04_refresh(v: Views) -> DataFrame:
    """Written, refreshed by coverage that came later, and read."""
    path, none = new_folder(v.spark, "trends"), F.lit(None)
    rows = v.panel.withColumns({"source": F.when(F.col("geography") < 13, "lines").otherwise("others"), "language": none.cast("string"), "country_share": V.ratio(F.col("matched_count"), F.col("monitored_count")), "global_share": none.cast("double")})
    store.write_partitioned(rows, path, ["source", "topic_id"], ["day", "geography"])
    late = v.panel.where("geography = 3 AND day >= '1998-01-01'").groupBy("geography", "day").agg(F.sum("monitored_count").alias("country_count"))
    store.refresh_coverage(v.spark, path, late.withColumns({"source": F.lit("lines"), "language": none.cast("string"), "global_count": none.cast("double")}), ["day", "geography"])
    return v.spark.read.schema(rows.schema).parquet(path).select("day", "source", "topic_id", "geography", "monitored_count", "country_share")
