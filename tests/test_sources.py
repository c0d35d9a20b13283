"""Readers, writers and streams on small files."""

import csv
import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspark.operators.store import write_single
from quillspark.sources import exports, files
from quillspark.streaming import attention


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_fire_detections(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("latitude,longitude,acq_date,acq_time,confidence,frp,type\n-7.25,33.5,2025-01-03,2359,h,71.2,2\n")
    row = files.fire_detections(spark, str(good), "2025-01-01", "2025-01-05").first()
    assert (row["latitude"], row["day"], row["frp"], row["fire_type"]) == (-7.25, date(2025, 1, 3), 71.2, 2)
    with pytest.raises(Exception, match="outside the window"):
        files.fire_detections(spark, str(good), "2025-02-01").collect()
    (tmp_path / "d").mkdir()
    for name, row_day in (("jan.csv", "2025-01-03"), ("feb.csv", "2025-02-03"), ("may.csv", "2025-05-03")):
        (tmp_path / "d" / name).write_text(good.read_text().replace("2025-01-03", row_day))
    spans = [("jan.csv", date(2025, 1, 1), date(2025, 1, 2)), ("jan.csv", date(2025, 1, 3), date(2025, 1, 31)), ("feb.csv", date(2025, 2, 1), date(2025, 2, 28)), ("may.csv", date(2025, 5, 1), date(2025, 5, 31))]
    held = lambda rows, **more: files.fire_detections(spark, str(tmp_path / "d"), windows=spark.createDataFrame(rows, "file string, start_day date, end_day date"), **more)
    assert held(spans).count() == 3 and {r["day"].month for r in held(spans).collect()} == {1, 2, 5}
    for wrong in (spans[:3], [*spans[:3], ("may.csv", date(2025, 2, 1), date(2025, 2, 28))]):  # no window, or that of another file
        with pytest.raises(Exception, match="outside the window"):
            held(wrong).collect()
        assert {r["day"].month: r["foreign"] for r in held(wrong, foreign="mark").collect()} == {1: False, 2: False, 5: True}
    with pytest.raises(ValueError, match="foreign"):
        held(spans, foreign="skip")
    bad = tmp_path / "b.csv"
    bad.write_text("latitude,longitude\n1,2\n")
    with pytest.raises(ValueError, match="acq_date"):
        files.fire_detections(spark, str(bad))


def feature(code, id_, **more):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"eventtype": code, "eventid": id_, "fromdate": "2025-01-01T00:00:00", "alertlevel": "Red", "alertscore": 2.5, "affectedcountries": [{"iso3": "ITA"}], "iso3": "FRA"} | more}


def test_event_features_and_geojson(spark, tmp_path):
    path = put(tmp_path / "e.json", {"type": "FeatureCollection", "features": [feature("WF", 7, name=" "), feature("EQ", 8), feature("FL", 9, name="Flood in X")]})
    got = {r["record_id"]: r for r in files.event_features(spark, path).collect()}
    assert set(got) == {"event:WF:7", "event:FL:9"} and got["event:WF:7"]["name"] == "wildfire 7" and got["event:FL:9"]["codes"] == ["ITA", "FRA"]
    out = [json.loads(r[0]) for r in exports.event_geojson(files.event_features(spark, path)).collect()]
    assert {o["geometry"]["coordinates"][0] for o in out} == {1.5}
    broken = put(tmp_path / "f.json", {"type": "FeatureCollection", "features": [feature("WF", 7, fromdate=None)]})
    with pytest.raises(Exception, match="without type"):
        files.event_features(spark, broken).collect()
    with pytest.raises(Exception, match="no FeatureCollection"):
        files.event_features(spark, put(tmp_path / "g.json", {"type": "Topology", "features": []})).collect()
    (tmp_path / "h.json").write_text('{"type": "FeatureCollection", "features": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.event_features(spark, str(tmp_path / "h.json")).collect()


def test_boundaries(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    page = {"type": "FeatureCollection", "features": [
        {"properties": {"ISO_A3": "-99", "ADM0_A3": "KOS"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"ISO_A3": "ITA"}, "bbox": [9, 9, 10, 10], "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"ISO_A3": "FR", "GU_A3": "fra"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"iso3": "NONE"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
    ]}
    path = tmp_path / "b.json.gz"
    path.write_bytes(gzip.compress(json.dumps(page).encode()))
    got = {r["iso3"]: r for r in files.boundaries(spark, str(path)).collect()}
    assert set(got) == {"XKX", "ITA", "FRA"} and (got["XKX"]["west"], got["XKX"]["east"], got["XKX"]["north"]) == (0, 2, 1) and got["ITA"]["west"] == 9 and len(got["ITA"]["polygons"]) == 2


    assert [r["iso3"] for r in files.boundaries(spark, str(path), ["ITA"]).collect()] == ["ITA"]
    with pytest.raises(ValueError, match="no usable country boundary"):
        files.boundaries(spark, str(path), ["DEU"])


def test_region_boundaries(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    shape = {"type": "Polygon", "coordinates": [ring]}
    page = {"type": "FeatureCollection", "features": [{"properties": {"name": "Umbria", "adm0_a3": "ita", "type_en": "Region"}, "geometry": shape}, {"properties": {"name": "Nowhere"}, "geometry": shape}]}
    got = files.region_boundaries(spark, put(tmp_path / "r.json", page)).collect()
    assert [(r["label"], r["iso3"], r["region_type"], r["east"]) for r in got] == [("Umbria", "ITA", "Region", 2.0)]
    with pytest.raises(ValueError, match="no usable region boundary"):
        files.region_boundaries(spark, put(tmp_path / "s.json", {"type": "FeatureCollection", "features": []}))


def test_timelines(spark, tmp_path):
    data = [{"date": f"2025010{d}T000000Z", "value": d, "norm": 100} for d in range(1, 9)]
    path = put(tmp_path / "t.json", {"timeline": [{"series": "Volume", "data": data}]})
    got = files.timeline_counts(spark, path, "2025-01-02", "2025-01-04").orderBy("day").collect()
    assert [(r["value"], r["norm"]) for r in got] == [(2, 100), (3, 100), (4, 100)]
    shares = put(tmp_path / "s.json", {"timeline": [{"series": "Italy Volume Intensity", "data": data[:2]}]})
    countries = spark.createDataFrame([("italy", "Italy"), ("france", "France")], "country string, label string")
    got = {(r["country"], r["day"].day): (r["share"], r["absent"]) for r in files.timeline_shares(spark, shares, countries, "2025-01-01", "2025-01-02").collect()}
    assert got == {("italy", 1): (0.01, False), ("italy", 2): (0.02, False), ("france", 1): (0.0, True), ("france", 2): (0.0, True)}


def test_interest_index(spark):
    wide = spark.createDataFrame([("2025-01-01", 40.0, False)], "date string, heat double, isPartial boolean")
    assert files.interest_index(wide, "anything").first()["value"] == 40.0
    with pytest.raises(Exception, match="a day twice"):
        files.interest_index(wide.unionByName(wide), "heat").collect()
    with pytest.raises(Exception, match="no value of an index"):
        files.interest_index(wide.withColumn("heat", F.lit(101.0)), "heat").collect()


def test_dimension_tables(spark):
    groups = "dimension_id string, groups map<string,struct<phrases:array<string>,segmentation:string,status:string>>"
    rows = spark.createDataFrame([("t", {"en": (["a", "b"], None, "validated"), "any": (["c"], "character", None)})], groups)
    got = {(r["phrase"], r["language"], r["segmentation"], r["status"]) for r in files.phrase_table(rows).collect()}
    assert got == {("a", "en", "space", "validated"), ("b", "en", "space", "validated"), ("c", None, "character", "draft")}
    a = "array<string>"
    schema = f"topic_id string, query_id string, topic_terms {a}, query_terms {a}, topic_languages {a}, query_languages {a}, topic_geographies {a}, query_geographies {a}"
    got = files.expanded_queries(spark.createDataFrame([("t", "q", ["x"], ["y", "x"], ["en"], ["de", "fr"], None, None)], schema)).collect()
    assert {(tuple(r["terms"]), r["language"], r["geography"]) for r in got} == {(("x", "y"), "de", None), (("x", "y"), "fr", None)}


def test_dimension_files(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
        return str(tmp_path / name)

    got = files.country_table(spark, lines("c.json", {"id": "fr", "label": "France", "iso3": "FRA"}, {"id": "xx", "label": "X", "enabled": False})).collect()
    assert [(r["country"], r["ngram_label"], r["iso3"]) for r in got] == [("fr", "France", "FRA")]
    for bad in ({"id": "fr", "label": "Again"}, {"id": "it", "label": "Italy", "geo": "ITA"}):
        with pytest.raises(Exception, match="given twice"):
            files.country_table(spark, lines("d.json", {"id": "fr", "label": "France"}, bad)).collect()
    with pytest.raises(ValueError, match="unknown id: zz"):
        files.country_table(spark, str(tmp_path / "c.json"), ["zz"])
    got = files.official_domain_table(spark, lines("o.json", {"country": "fr", "domains": [".Gouv.fr", "elysee.fr"]})).collect()
    assert {tuple(r) for r in got} == {("fr", "gouv.fr"), ("fr", "elysee.fr")}
    for bad in ("a.fr/x", " ", "A.fr"):
        with pytest.raises(Exception, match="no bare host"):
            files.official_domain_table(spark, lines("p.json", {"country": "fr", "domains": ["a.fr", bad]})).collect()
    with pytest.raises(Exception, match="without id or phrases"):
        files.topic_table(spark, lines("t.json", {"id": None, "groups": {"en": {"phrases": ["x"]}}})).collect()


def test_json_columns(spark):
    rows = spark.createDataFrame([({"b": "2", "a": "1"},)], "m map<string,string>")
    text = rows.select(files.encoded_map("m").alias("m"))
    assert text.first()[0] == '{"a":"1","b":"2"}' and files.decoded(text, "m", "map<string,string>").first()[0] == {"a": "1", "b": "2"}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "x"), ("r2", "y")], "run_id string, body string")
    for _ in range(2):
        exports.append_envelopes(rows, str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 4
    exports.write_csv(rows, str(tmp_path / "csv"))
    lines = [x for f in (tmp_path / "csv").glob("part-*") for x in csv.DictReader(f.open())]
    assert {x["body"] for x in lines} == {"x", "y"}
    write_single(rows, str(tmp_path / "one"))
    write_single(rows.limit(1), str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 1


def test_ingest_and_live_matches(spark, tmp_path):
    schema = "record_id string, source string, url string, lang string, text string, arrival int"
    rows = spark.createDataFrame([("a", "s", "u1", "en", "end of the day", 2), ("a", "s", "u1", "en", "end", 1), ("b", "s", "u2", "en", "none", 1), ("c", "s", "u1", "en", "of the", 1)], schema)
    rows.write.parquet(str(tmp_path / "landing"))
    for _ in range(2):
        attention.ingest(spark, str(tmp_path / "landing"), schema, str(tmp_path / "data"), str(tmp_path / "mark"), ["source"], ["record_id"], "arrival").awaitTermination()
    assert {(r["record_id"], r["arrival"]) for r in spark.read.parquet(str(tmp_path / "data")).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    phrases = spark.createDataFrame([("topic", "t", "of the", "en", "space")], "evidence_kind string, dimension_id string, phrase string, language string, segmentation string")
    out, mark = str(tmp_path / "matched"), str(tmp_path / "mark-2")
    for n in range(4):  # later landings bring no url twice
        rows.withColumn("url", F.concat("url", F.lit(str(n // 2)))).write.mode("append").parquet(str(tmp_path / "articles"))
        attention.live_matches(spark.readStream.schema(schema).parquet(str(tmp_path / "articles")), phrases, out, mark).awaitTermination()
    found = spark.read.parquet(out)
    assert [tuple(r) for r in attention.live_url_counts(found).collect()] == [("t", 2)] and found.count() == 2
    assert not (tmp_path / "mark-2" / "state").exists() and not [x for x in tmp_path.iterdir() if "staging" in x.name]
