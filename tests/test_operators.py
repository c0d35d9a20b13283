"""Expected values of the operators on tiny tables."""

import math
import random
import re
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.functions.web import host_of, suffixes
from quillspark.operators import attribution, events, hazards, ledger, matching, panel, quality, series, store

D = date


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def days(start, values):
    return [(D.fromordinal(start.toordinal() + i), v) for i, v in enumerate(values)]


def test_phrase_patterns_and_anchors(spark):
    rows = spark.createDataFrame([("cambio climático", "space"), ("气候变化", "character"), ("Flood", "space"), ("a+b c", "space")], "phrase string, segmentation string")
    got = {r["phrase"]: r for r in matching.with_patterns(rows).collect()}
    assert got["cambio climático"]["anchors"] == ["cambio", "Cambio"] and got["cambio climático"]["type"] == 1
    assert got["气候变化"]["anchors"] == ["候"] and got["气候变化"]["pattern"] == "气候变化" and got["气候变化"]["type"] == 2
    assert got["Flood"]["anchors"] == ["flood", "flood.", "flood,", "Flood", "Flood.", "Flood,"]
    texts = spark.createDataFrame([("x Cambio  climático.",), ("recambio climático",), ("A+B c",), ("aab c",)], "t string")
    hit = lambda p: [r[0] for r in texts.where(F.rlike(F.lower("t"), F.lit(got[p]["pattern"]))).collect()]
    assert hit("cambio climático") == ["x Cambio  climático."] and hit("a+b c") == ["A+B c"]


def test_phrase_normalisation_keeps_last_at_first_place(spark):
    rows = spark.createDataFrame([(1, ' "Sea Level" '), (2, "heat"), (3, "sea level"), (4, "  ")], "seq int, phrase string")
    got = T.distinct_phrases(rows, [], "seq").orderBy("place").collect()
    assert [(r["phrase"], r["place"], r["seq"]) for r in got] == [("sea level", 1, 3), ("heat", 2, 2)]


def test_labels_contexts_and_flags(spark):
    got = one(
        spark, key=T.label_key(F.lit("Côte d'Ivoire Volume Intensity")), label=T.display_label(F.lit("new_zealand"), F.lit(None).cast("string")),
        spaced=T.context(F.lit(None).cast("string"), F.lit("b"), F.lit("c"), F.lit("space")), joined=T.context(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("character")),
        flags=T.set_flags(b=F.lit(True), a=F.lit(False), c=F.lit(True)), text=T.optional_text(F.lit("  ")),
    )
    assert got == {"key": "côtedivoire", "label": "New Zealand", "spaced": " b c", "joined": "abc", "flags": "b,c", "text": None}


def test_values(spark):
    got = one(
        spark, none=V.ratio(F.lit(1), F.lit(0)), share=V.share_of_percent(F.lit("4")), over=V.share_of_percent(F.lit("101")), whole=V.whole_number(F.lit("3.0")),
        part=V.whole_number(F.lit("3.5")), zero=V.political_share(F.lit(0), F.lit(0)), off=V.political_share(F.lit(None).cast("long"), F.lit(3)), id=V.record_id("v1", F.lit("a"), F.lit(None).cast("string")),
    )
    import hashlib

    assert got == {"none": None, "share": 0.04, "over": None, "whole": 3, "part": None, "zero": 0.0, "off": None, "id": hashlib.sha256(b"v1|a|").hexdigest()}


def test_times(spark):
    rows = spark.createDataFrame([("20250106T101112Z",), ("20250106101112",), ("2025-01-06T12:11:12+02:00",), ("2025-01-06T10:11:12",), (None,)], "t string")
    assert {r[0] for r in rows.select(F.date_format(V.utc_time(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()} == {"2025-01-06 10:11:12", None}
    with pytest.raises(Exception, match="no such time"):
        spark.createDataFrame([("soon",)], "t string").select(V.utc_time(F.col("t"))).collect()


def test_hosts_and_suffixes(spark):
    rows = spark.createDataFrame([("https://News.Example.co.uk/a?b",), ("not a url",), (None,)], "url string")
    assert [r[0] for r in rows.select(host_of(F.col("url"))).collect()] == ["news.example.co.uk", None, None]
    assert spark.range(1).select(suffixes(F.lit("a.b.c"))).first()[0] == ["a.b.c", "b.c", "c"]


def test_attribution_takes_the_longest_suffix_and_official_first(spark):
    rows = spark.createDataFrame([("u1", "m.a.com"), ("u2", "b.a.com"), ("u3", "xa.com"), ("u4", "gov.b")], "url string, host string")
    domains = attribution.unambiguous_domains(spark.createDataFrame([("A.com", 1), ("b.a.com", 2), ("b", 3), ("c", 4), ("c", 5), (None, 6)], "domain string, country int"))
    official = spark.createDataFrame([("b", 9)], "domain string, country int")
    assert {(r["domain"], r["country"]) for r in domains.collect()} == {("a.com", 1), ("b.a.com", 2), ("b", 3)}
    got = attribution.attribute(rows, domains, official)
    assert {(r["url"], r["country"]) for r in got.collect()} == {("u1", 1), ("u2", 2), ("u4", 9)}
    assert {r["url"]: r["official"] for r in attribution.flag_official(got, official).collect()} == {"u1": False, "u2": False, "u4": True}


def test_dense_panel_and_coverage(spark):
    topics, countries = spark.createDataFrame([("t",)], "topic_id string"), spark.createDataFrame([(1,), (2,)], "country int")
    counts = spark.createDataFrame([("t", D(2025, 1, 2), 1, 7)], "topic_id string, day date, country int, matched_count long")
    out = panel.dense(panel.spine(topics, countries, "2025-01-01", "2025-01-03"), counts, ["topic_id", "day", "country"], {"matched_count": 0})
    assert out.count() == 6 and out.where("matched_count = 7").count() == 1 and out.where("matched_count = 0").count() == 5
    assert quality.missing_cells(panel.spine(topics, countries, "2025-01-01", "2025-01-03"), out, ["topic_id", "day", "country"]).count() == 0
    schema = "source string, geography int, language string, day date"
    trend = spark.createDataFrame([("s", 1, None, D(2025, 1, 1), 10, None), ("s", 2, None, D(2025, 1, 1), 10, 40.0)], schema + ", matched_count long, monitored_count double")
    cover = spark.createDataFrame([("s", 1, None, D(2025, 1, 1), 200.0, 1000.0)], schema + ", country_count double, global_count double")
    got = {r["geography"]: r for r in panel.with_coverage(trend, cover).collect()}
    assert (got[1]["country_share"], got[1]["global_share"]) == (0.05, 0.01) and got[2]["country_share"] == 0.25


BOXES = [(0, "italy", 10.0, 15.0, 40.0, 45.0), (1, "france", 0.0, 5.0, 40.0, 45.0), (2, "late", 10.0, 12.5, 40.0, 45.0)]


def boundaries(spark):
    rows = spark.createDataFrame(BOXES, "place int, area string, west double, east double, south double, north double")
    ring = hazards.rectangle(*(F.col(c) for c in ("west", "east", "south", "north")))
    hole = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((13.0, 43.0), (14.0, 43.0), (14.0, 44.0), (13.0, 44.0))))
    return rows.withColumn("polygons", F.array(F.when(F.col("area") == "italy", F.array(ring, hole)).otherwise(F.array(ring))))


def test_points_in_polygons(spark):
    points = spark.createDataFrame([(1, 12.0, 42.0), (2, -20.0, 0.0), (3, 15.0, 45.0), (4, 13.5, 43.5), (5, 2.0, 41.0), (6, 10.0, 42.0)], "id int, longitude double, latitude double")
    got = {r["id"]: r["area"] for r in hazards.locate(points, "id", boundaries(spark)).collect()}
    assert got == {1: "italy", 2: None, 3: "italy", 4: None, 5: "france", 6: "italy"}  # first in order, edges count, holes don't


def ray_cast(ring, x, y):
    """Even-odd rule over all sides of a ring at once."""
    x2, y2 = np.array(ring).T
    x1, y1 = np.roll(x2, 1), np.roll(y2, 1)
    turn = (y - y1) * (x2 - x1) - (x - x1) * (y2 - y1)
    on = (np.abs(turn) <= 1e-10) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
    across = (y1 > y) != (y2 > y)
    return bool(on.any() or ((x < ((x2 - x1) * (y - y1))[across] / (y2 - y1)[across] + x1[across]).sum() % 2))


def test_polygons_of_very_many_sides(spark, tmp_path):
    rng = random.Random(7)
    star = lambda n, cx, cy, r: [[cx + r * math.cos(2 * math.pi * i / n) + rng.random() / 200, cy + r * math.sin(2 * math.pi * i / n) + rng.random() / 200] for i in range(n)]
    comb = [[30 + i / 50, 10.0 if i % 2 else -10.0] for i in range(500)] + [[40.0, -12.0], [30.0, -12.0]]
    shapes = [(0, "coast", [[star(100_000, 5.0, 3.0, 12.0), star(300, 5.0, 3.0, 2.0)], [star(50, -30.0, 0.0, 3.0)]]), (1, "comb", [[comb]]), (2, "all", [[[[-60.0, -40.0], [60.0, -40.0], [60.0, 40.0], [-60.0, 40.0]]]]), (3, "none", [[[]], []])]
    rows = []
    for place, area, polygons in shapes:
        points = [p for polygon in polygons for ring in polygon for p in ring] or [[0.0, 0.0]]
        rows.append((place, area, min(p[0] for p in points), max(p[0] for p in points), min(p[1] for p in points), max(p[1] for p in points), polygons))
    spark.createDataFrame(rows, "place int, area string, west double, east double, south double, north double, polygons array<array<array<array<double>>>>").write.parquet(str(tmp_path / "b"))
    points = [(i, rng.uniform(-35, 45), rng.uniform(-20, 20)) for i in range(150)] + [(200 + i, *shapes[0][2][0][0][i * 900]) for i in range(50)] + [(300 + i, 30 + rng.random() * 10, rng.uniform(-12, 10)) for i in range(50)] + [(400, None, 1.0), (401, 1.0, None)]
    got = hazards.locate(spark.createDataFrame(points, "id int, longitude double, latitude double"), "id", spark.read.parquet(str(tmp_path / "b")))
    held = lambda polygon, x, y: bool(polygon and polygon[0]) and ray_cast(polygon[0], x, y) and not any(ray_cast(hole, x, y) for hole in polygon[1:])
    want = {i: next((area for _, area, polygons in shapes if any(held(p, x, y) for p in polygons)), None) if None not in (x, y) else None for i, x, y in points}
    assert {r["id"]: r["area"] for r in got.collect()} == want and set(want.values()) == {"coast", "comb", "all", None}
    shaped = hazards.shapes(spark.read.parquet(str(tmp_path / "b")))
    sides = hazards.banded_sides(shaped).select("place", "polygon", F.size("outer").alias("n"))
    most = {(r["place"], r["polygon"]): (r["n"], r["most"]) for r in sides.groupBy("place", "polygon").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    assert most[0, 0][0] < 3 * 100_300 and most[0, 0][1] < 2_000 and most[1, 0][0] <= 3 * 502


def test_fire_days_are_dense(spark):
    rows = [(1, 12.0, 42.0, "n", 10.5, 0), (2, 12.1, 42.0, "High", 5.5, 0), (3, 12.0, 42.0, "low", 3.0, 0), (4, 12.0, 42.0, "n", 3.0, 2), (5, -20.0, 0.0, "n", -1.0, 0)]
    found = spark.createDataFrame(rows, "id int, longitude double, latitude double, confidence string, frp double, fire_type int").withColumn("day", F.lit("2025-01-01").cast("date"))
    counts = hazards.country_days(hazards.locate(hazards.retained(found), "id", boundaries(spark)))
    areas = spark.createDataFrame([("italy", True), ("france", True), ("nowhere", False)], "area string, supported boolean")
    span = spark.createDataFrame([(D(2025, 1, 1),), (D(2025, 1, 2),)], "day date")
    got = {(r["day"].day, r["area"]): r for r in hazards.hazard_panel(span, areas, counts).collect()}
    assert len(got) == 6 and got[1, "italy"]["detections"] == 2 and got[1, "italy"]["power_sum"] == 16.0 and got[1, "italy"]["power_mean"] == 8.0 and got[1, "italy"]["high_confidence"] == 1
    assert got[2, "france"]["detections"] == 0 and got[1, "nowhere"]["detections"] is None
    fates = found.groupBy(hazards.row_fate(F.col("fire_type"), F.col("confidence")).alias("f")).count()
    assert {r["f"]: r["count"] for r in fates.collect()} == {"retained": 3, "low_confidence": 1, "non_vegetation": 1}


def test_comparison_of_sources(spark):
    rows = [("l", d, a) for d, a in days(D(2025, 1, 1), [0.01, 0.02, 0.03, 0.5])] + [("r", d, a) for d, a in days(D(2025, 1, 1), [0.1, 0.2, 0.3])]
    trends = spark.createDataFrame(rows, "source string, day date, country_share double").withColumns({"topic_id": F.lit("t"), "geography": F.lit("g"), "matched_count": F.lit(1), "attention_index": F.lit(None).cast("double")})
    r = series.compare_sources(trends, "l", "r", "country_share", "country_share").first()
    assert (r["paired_days"], r["left_days"], r["right_days"], r["correlation"]) == (3, 4, 3, 1.0)
    assert abs(r["left_mean"] - 0.02) < 1e-12 and abs(r["right_mean"] - 0.2) < 1e-12
    with pytest.raises(ValueError):
        series.compare_sources(trends, "l", "r", "other", "country_share")
    clash = trends.unionByName(trends.withColumn("country_share", F.col("country_share") + 1))
    with pytest.raises(Exception, match="several values"):
        series.compare_sources(clash, "l", "r", "country_share", "country_share").collect()


def test_islands_and_spacing(spark):
    rows = spark.createDataFrame([("a", D(2025, 1, 1)), ("a", D(2025, 2, 1)), ("a", D(2025, 2, 2)), ("a", D(2025, 2, 14)), ("b", D(2025, 1, 1)), ("b", D(2025, 1, 8)), ("c", D(2025, 1, 1))], "k string, day date")
    got = [(r["start_day"], r["days"]) for r in series.islands(rows, ["k"]).where("k = 'a'").orderBy("start_day").collect()]
    assert got == [(D(2025, 1, 1), 1), (D(2025, 2, 1), 2), (D(2025, 2, 14), 1)]
    assert {r["k"]: r["resolution"] for r in series.spacing(rows, ["k"]).collect()} == {"a": "irregular", "b": "weekly", "c": "single_point"}


@pytest.mark.parametrize(("before", "after", "low"), [([0, 1, 0, 1, 0, 1, 0], [8, 9, 8, 10, 9, 8, 10], True), ([5] * 7, [5] * 7, False)])
def test_permutation_test(spark, before, after, low):
    event = spark.createDataFrame([(1, D(2025, 1, 10), D(2025, 1, 12))], "record_id int, start_day date, end_day date")
    rows = days(D(2025, 1, 3), before) + days(D(2025, 1, 13), after)
    values = spark.createDataFrame([(1, "global", "t", d, v) for d, v in rows], "record_id int, scope string, topic_id string, day date, value long")
    pairs = events.before_after(event, values)
    exact, drawn = events.exact_test(pairs).first(), events.sampled_test(pairs, draws=500).first()
    assert exact["permutations"] == 3432 and (exact["p_value"] < 0.05) == low and (drawn["p_value"] < 0.05) == low
    if not low:
        assert exact["difference"] == 0 and exact["p_value"] >= 0.5
    short = events.before_after(event, values.where("day <> date'2025-01-04'"))
    assert short.first()["testable"] is False and events.exact_test(short).count() == 0


def test_event_windows_and_scopes(spark):
    event = spark.createDataFrame([(1, D(2025, 3, 1), D(2025, 3, 2), [1])], "record_id int, start_day date, end_day date, geography_ids array<int>")
    rows = spark.createDataFrame([(d, g, "t", 2, 1) for d in (D(2025, 2, 1), D(2025, 3, 1), D(2025, 3, 30), D(2025, 3, 31)) for g in (1, 2, 3)], "day date, geography int, topic_id string, matched_count long, political_count long")
    got = events.event_rows(event, rows, [1, 2])
    assert {r["scope"]: r["count"] for r in got.groupBy("scope").count().collect()} == {"affected": 3, "bloc": 6, "international": 6, "global": 9}
    total = {r["scope"]: r for r in events.totals(got).collect()}
    assert total["global"]["matches"] == 18 and total["global"]["political_percent"] == 50.0 and total["global"]["markets"] == 3
    assert {r["period"] for r in events.phase_means(got).collect()} == {"before", "during", "after"}
    name = lambda n, h, c: events.display_name(F.lit(n), F.lit(h), F.lit(c))
    assert list(one(spark, a=name("flood in x", "flood", "Peru"), b=name("Forest fires in x", "wildfire", "Peru"), c=name("Ana", "tropical_cyclone", "Peru")).values()) == ["Flood in Peru", "Wildfire in Peru", "Ana"]


def test_upserts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "t", 3)], "record_id string, source string, n int")
    assert store.upsert_into(spark, path, rows, ["source"], ["record_id"]) == 3
    assert store.upsert_into(spark, path, rows.where("source = 's'").withColumn("n", F.lit(9)), ["source"], ["record_id"]) == 0
    assert sorted((r["record_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 9), ("c", 3)]


def test_merges(spark):
    schema = "record_id string, topic string, matched long, share double, at int, meta map<string,int>"
    old = spark.createDataFrame([("a", "t", None, 0.04, 1, {"x": 1, "y": 1}), ("b", "t", 1, None, 1, None)], schema)
    new = spark.createDataFrame([("a", "t", 8, None, 2, {"y": 2}), ("b", "u", 2, None, 0, {"z": 1})], schema)
    got = {r["record_id"]: r for r in store.merge_fields(old, new, ["topic"], ["matched", "share"], "at", ["meta"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["matched"], a["share"], a["at"], a["meta"], a["identity_ok"]) == (8, 0.04, 2, {"x": 1, "y": 2}, True)
    assert (b["at"], b["meta"], b["identity_ok"]) == (1, {"z": 1}, False)
    versions = "record_id string, version int, seq int, origin string"
    got = store.upsert_versions(spark.createDataFrame([("a", 2, 1, "old"), ("b", 3, 1, "old")], versions), spark.createDataFrame([("a", 2, 1, "new"), ("a", 2, 2, "later"), ("b", 1, 1, "new")], versions))
    assert {r["record_id"]: r["origin"] for r in got.collect()} == {"a": "new", "b": "old"}


def test_collisions_are_set_aside(spark, tmp_path):
    schema, path, aside = "record_id string, source string, topic string, query string, n long", str(tmp_path / "data"), str(tmp_path / "aside")
    merge = lambda rows: store.merge_into(spark, path, spark.createDataFrame(rows, schema), ["source", "topic", "query"], ["n"], ["source"], ["record_id"], aside, changeable={"query": "n.source = 'ngrams'"})
    assert merge([("a", "ngrams", "t", "q", 1), ("b", "lines", "t", "q", 1)]) == 2
    merge([("a", "ngrams", "t", "q2", None), ("c", "lines", "t", "q", 3)])
    with pytest.raises(store.CollisionError, match="1 records"):
        merge([("b", "lines", "t", "q2", 9), ("d", "lines", "t", "q", 4)])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("record_id", "query", "n").collect()) == [("a", "q2", 1), ("b", "q", 1), ("c", "q", 3)]
    assert [(r["record_id"], r["query"], r["was"]["query"]) for r in spark.read.parquet(aside).collect()] == [("b", "q2", "q")]
    assert {x.name for x in tmp_path.iterdir()} == {"data", "aside"}


def test_only_dependent_partitions_are_refreshed(spark, tmp_path):
    schema = "source string, topic_id string, geography long, language string, day date, matched_count long, monitored_count double, country_share double, global_share double"
    rows = [(s, t, g, None, D(2025, 1, d), 3, 10.0, 0.3, None) for s in "xy" for t in "ab" for g in (1, 2) for d in (1, 2) if (t, g) != ("b", 2)]
    path = str(tmp_path / "data")
    store.write_partitioned(spark.createDataFrame(rows, schema), path, ["source", "topic_id"], ["day"])
    files = lambda: {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "data").rglob("part-*")}
    before = files()
    coverage = spark.createDataFrame([("x", 2, None, D(2025, 1, 2), 6.0, 12.0)], "source string, geography long, language string, day date, country_count double, global_count double")
    assert store.refresh_coverage(spark, path, coverage, ["day"]) == [("x", "a")]
    kept = {f for f, t in files().items() if before.get(f) == t}
    assert {f.parts[:2] for f in kept} == {("source=x", "topic_id=b"), ("source=y", "topic_id=a"), ("source=y", "topic_id=b")}
    got = [tuple(r) for r in spark.read.parquet(path).where("country_share <> 0.3").select("source", "topic_id", "geography", "monitored_count", "country_share", "global_share").collect()]
    assert got == [("x", "a", 2, 6.0, 0.5, 0.25)] and spark.read.parquet(path).count() == len(rows)


def test_codes_and_labels_that_nothing_knows(spark):
    names = spark.createDataFrame([("Norway", "NOR"), ("Russian Federation", "RUS")], "label string, code string")
    aliases = spark.createDataFrame([("Russia", "RUS")], "label string, code string")
    rows = lambda *x: spark.createDataFrame(x, "id string, label string, code string")
    got = attribution.country_codes(rows(("a", "NORWAY", None), ("b", "Russia", None), ("c", "Nowhere", "XNW")), names, aliases)
    assert {(r["id"], r["code"]) for r in got.collect()} == {("a", "NOR"), ("b", "RUS"), ("c", "XNW")}
    with pytest.raises(Exception, match="country d needs a code; its label is Atlantis"):
        attribution.country_codes(rows(("d", "Atlantis", None)), names, aliases).collect()
    labels, known = spark.createDataFrame([("x", 1), ("y", 2)], "label string, n int"), spark.createDataFrame([("x",)], "label string")
    assert [r["n"] for r in quality.of_known_labels(labels, known, "label", explicit=False).collect()] == [1]
    with pytest.raises(ValueError, match="unexpected label: y"):
        quality.of_known_labels(labels, known, "label", explicit=True)


def test_problems_of_political_tables(spark):
    signals = spark.createDataFrame([("a",), ("b",), ("b",)], "signal string")
    official = spark.createDataFrame([("NO", "Gov.no"), ("NO", " .gov.no"), ("SE", "gov.se/x"), ("SE", None), ("FI", "gov.fi")], "country string, domain string")
    got = {tuple(r) for r in quality.political_problems(signals, official, ["a", "c"]).collect()}
    assert got == {("missing signal", "c"), ("repeated signal", "b"), ("repeated domain", "NO|gov.no"), ("not a bare host", "SE|gov.se/x"), ("blank domain", "SE|")}


def test_ledger(spark):
    got = ledger.windows(spark.createDataFrame([("q",)], "query_id string"), "2025-01-01", "2025-01-12", 5).orderBy("start_day").collect()
    assert [(r["start_day"].day, r["end_day"].day) for r in got] == [(1, 5), (6, 10), (11, 12)] and len({r["window_id"] for r in got}) == 3
    log = spark.createDataFrame([("w", "started", 1, None), ("w", "failed", 2, None), ("w", "started", 3, None), ("w", "success", 4, 7), ("x", "started", 1, None), ("x", "failed", 2, None)], "window_id string, status string, ts int, articles long")
    states = ledger.fold(log)
    assert {r["window_id"]: (r["status"], r["attempts"], r["articles"]) for r in states.collect()} == {"w": ("success", 2, 7), "x": ("failed", 1, None)}
    plan = spark.createDataFrame([("w",), ("x",), ("y",)], "window_id string")
    assert {(r["window_id"], r["status"]) for r in ledger.unfinished(plan, states).collect()} == {("x", "failed"), ("y", "pending")}


def test_checks(spark):
    rows = spark.createDataFrame([("a", D(2025, 1, 1), 1), ("a", D(2025, 1, 3), -1), ("a", D(2025, 1, 3), 2)], "k string, day date, n int")
    assert [r["day"].day for r in quality.missing_days(rows, ["k"], "2025-01-01", "2025-01-03").collect()] == [2]
    assert quality.duplicates(rows, ["k", "day"]).first()["rows"] == 2
    assert [tuple(r) for r in quality.broken(rows, "k", {"count": F.col("n") >= 0}).collect()] == [("a", "count")]
    with pytest.raises(ValueError, match="unknown k: a"):
        store.require_known(rows, rows.where("false"), "k")


def test_old_columns_are_renamed(spark):
    old = spark.createDataFrame([(1, 0.5)], "monitored_count int, attention_share double")
    assert store.upgraded(old, store.TREND_RENAMES).columns == ["global_monitored_count", "global_attention_share"]
    both = spark.createDataFrame([(1, 2), (3, None)], "monitored_count int, global_monitored_count int")
    assert [r[0] for r in store.upgraded(both, store.TREND_RENAMES).orderBy(F.col("global_monitored_count")).collect()] == [2, 3]


def test_article_signals_and_evidence(spark):
    rows = [("topic", "t1", "p1"), ("topic", "t2", "p2"), ("political_signal", "political_actor", "p3"), ("topic", "t1", "p1")]
    found = spark.createDataFrame(rows, "evidence_kind string, dimension_id string, phrase string").withColumns({"day": F.lit("2025-01-01").cast("date"), "url": F.lit("u"), "host": F.lit("h"), "language": F.lit("en"), "lang": F.lit("en"), "segmentation": F.lit("space"), "context": F.lit("c")})
    first = matching.one_per_evidence(found)
    assert first.count() == 3
    s = matching.article_signals(first).first()
    assert s["topics"] == ["t1", "t2"] and s["political_actor"] and not s["party_politics"]
    lists = {r["topic_id"]: r for r in matching.evidence_lists(first, most=1).withColumn("joined", matching.phrases_joined()).collect()}
    assert lists["t1"]["evidence_total"] == 2 and lists["t1"]["truncated"] and lists["t1"]["joined"] == "p3"


def test_last_record_per_key_and_daily_counts(spark):
    rows = spark.createDataFrame([("r1", 1, "English"), ("r1", 2, "English"), ("r2", 3, "French"), ("r3", 4, None)], "record_id string, arrival int, language string").withColumn("day", F.lit(datetime(2025, 1, 1)).cast("date"))
    assert {r["language"]: r["articles"] for r in series.daily_counts(rows, ["language"]).collect()} == {"English": 1, "French": 1, None: 1}


def test_order_is_that_of_each_type(spark):
    rows = spark.createDataFrame([("b", 10), ("b", 9), (None, 1), ("b", None), ("a", 100)], "name string, size long")
    assert [tuple(r) for r in store.ordered(rows, "name", "size").collect()] == [(None, 1), ("a", 100), ("b", None), ("b", 9), ("b", 10)]


def test_the_last_arrival_is_served(spark):
    from quillspark.sources import exports

    fill = {c: F.lit(None).cast("string") for c in exports.SERVING}
    rows = spark.createDataFrame([("r", D(2025, 1, 1), "t", 1, 5), ("r", D(2025, 1, 1), "t", 2, 4), ("s", D(2025, 1, 2), "u", 1, 9)], "record_id string, day date, topic_id string, arrival int, matched_count long")
    rows = rows.withColumns({c: x for c, x in fill.items() if c not in ("record_id", "observation_date", "topic_id", "matched_count")})
    got = exports.serving_rows(rows, ["t"], "arrival")
    assert got.columns == list(exports.SERVING) and [(r["record_id"], r["matched_count"]) for r in got.collect()] == [("r", 4)]


@pytest.mark.parametrize("few", [0, 32])
def test_texts_meet_phrases_of_any_language_and_mode(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW", few)
    phrases = spark.createDataFrame(
        [
            ("topic", "t", "of the", "en", "space"), ("topic", "any", "of the", None, "space"), ("topic", "c", "fth", "en", "character"), ("topic", "d", "a-b c", "en", "space"), ("topic", "p", "++", "en", "space"),
            ("topic", "l", "day", "fr", "space"), ("topic", "q", r"(\E x", None, "space"), ("topic", "z", "气候 变化", "zh", "character"),
        ],
        "evidence_kind string, dimension_id string, phrase string, language string, segmentation string",
    )
    texts = [
        (1, "en", "End OF\n the, day"), (2, "fr", "of the day"), (3, "en", "of, the"), (4, "en", "soft heath ofthe"), (5, "en", "(a-b  c)"), (6, "en", "a b c ++"), (7, "en", "a-b cc"), (8, "en", None), (9, "en", "wolf then"),
        (10, "en", "x++ y"), (11, "de", "a (\\e\tX."), (12, "zh", "全球气候变化问题" * 50), (13, "en", "w " * 63 + "++"), (14, "en", "x" * 63 + "fth"), (1, "en", "End OF\n the, day"),
    ]
    articles = spark.createDataFrame(texts, "doc_id int, lang string, text string")
    got = [(r["doc_id"], r["dimension_id"]) for r in matching.match_texts(articles, phrases).collect()]
    assert sorted(got) == sorted([(1, "t"), (1, "any"), (2, "any"), (2, "l"), (4, "c"), (5, "d"), (6, "p"), (11, "q"), (12, "z"), (13, "p"), (14, "c")])
    assert matching.match_texts(articles, phrases.where("false")).count() == 0


def test_a_large_catalogue_is_joined_by_token(spark, monkeypatch):
    """100,000 phrases, sent to all or shuffled, against a plain search; no array of phrases stands in the plan."""
    made = spark.range(100_000).select(F.lit("topic").alias("evidence_kind"), (F.col("id") % 7).cast("string").alias("dimension_id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" v"), (F.col("id") % 13).cast("string")).alias("phrase"), F.lit(None).cast("string").alias("language"), F.lit("space").alias("segmentation"))
    articles = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("W"), (F.col("id") * 331 + i * 7).cast("string"), F.lit("  v"), ((F.col("id") + i) % 13).cast("string"))), "\n").alias("text"))
    held = {(r["phrase"], r["dimension_id"]) for r in made.collect()}
    expected = {(r["doc_id"], p, d) for r in articles.collect() for ws in [r["text"].lower().split()] for i in range(len(ws) - 1) for p in [f"{ws[i]} {ws[i + 1]}"] for d in "0123456" if (p, d) in held}
    for most in (matching.BROADCAST_BYTES, 0):
        monkeypatch.setattr(matching.small, "__defaults__", (most,))
        out = matching.match_texts(articles, made)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {(r["doc_id"], r["phrase"], r["dimension_id"]) for r in out.collect()} == expected and expected and len(plan) < 20_000


def test_code_points_of_blocks(spark, monkeypatch):
    texts = ["Ab c" * 70, "气候😀变化 x", "", None, " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r["doc_id"], r["pos"], r["pre"], r["ngram"], r["post"]) for r in matching.ngram_rows(rows, ["doc_id"], types=(2,)).collect())
    assert got == [(i, k, t[max(k - 12, 0) : k], c, t[k + 1 : k + 13]) for i, t in enumerate(texts) for k, c in enumerate(t or "") if c.strip()]


def test_rows_of_ngrams_are_written_from_the_end(spark, tmp_path):
    """Parquet files of them are smaller than those of the same rows from a text's beginning."""
    from quillspark.plans import queries as plans

    made = plans.QUERIES["a16_ngram_rows"](spark, "/root/testdata/sf0.001").coalesce(1)
    for name, rows in (("end", made), ("beginning", made.sortWithinPartitions("type", "doc_id", "pos"))):
        rows.write.parquet(f"{tmp_path}/{name}")
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert size("end") < 0.97 * size("beginning") and read("end").exceptAll(read("beginning")).isEmpty() and read("end").count() == read("beginning").count()


def test_contexts_of_anchors_equal_those_of_all_words(spark):
    phrases = spark.createDataFrame([("topic", "t", "of the", "en", "space"), ("topic", "u", "day", None, "space")], "evidence_kind string, dimension_id string, phrase string, language string, segmentation string")
    articles = spark.createDataFrame([(1, "en", "End of the day of the Day. x"), (2, "fr", "of the day"), (3, "en", "")], "doc_id int, lang string, text string")
    every, some = matching.ngram_rows(articles, ["doc_id", "lang"]), matching.anchored_rows(articles, phrases, ["doc_id", "lang"])
    listed = lambda df: sorted(map(repr, matching.match_ngrams(df, phrases).collect()))
    assert listed(every) == listed(some) and some.count() < every.count()


def test_ledger_states_join_no_windows(spark):
    """Events are folded by arithmetic: only what is planned explodes windows, once, and no exploded side is broadcast."""
    from quillspark.plans import queries as plans

    plan = lambda name: plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert [plan(n).count("Generate explode") for n in ("l02_ledger_fold", "c17_unfinished_work", "d27_run_summary")] == [0, 1, 1]
    log = spark.createDataFrame([("a", D(2025, 1, 5), 1, "failed"), ("a", D(2025, 1, 1), 2, "success"), ("a", D(2025, 1, 12), 3, "failed"), ("a", D(2025, 1, 13), 4, "failed"), ("b", D(2025, 1, 6), 5, "failed")], "query_id string, day date, ts int, status string")
    states = ledger.window_states(log, spark.createDataFrame([("a",)], "query_id string"), "2025-01-01", "2025-01-12", 5)
    assert {(r["query_id"], r["start_day"], r["status"], r["attempts"]) for r in states.collect()} == {("a", D(2025, 1, 1), "success", 2), ("a", D(2025, 1, 11), "failed", 1)}


def test_frequent_pairs_are_whole_whatever_the_buckets(spark, monkeypatch):
    """Against plain counts, with buckets that hide a frequent phrase among rare ones, ties and a language that is null; what is shuffled is counted by bucket."""
    from quillspark.plans import views

    rng = random.Random(5)
    rows = [(lang, f"p{min(int(rng.paretovariate(0.8)), 60)}") for lang in ("en", "fr", None) for _ in range(400)] + [("fr", f"x{i}") for i in range(300)] + [("de", "one")]
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    top = lambda lang: sorted(((-n, p) for (x, p), n in counts.items() if x == lang))[:8]
    for buckets, fullest in ((1 << 16, 64), (7, 1), (64, 2)):
        monkeypatch.setattr(views, "FULLEST", fullest)
        made = spark.createDataFrame(rows, "lang string, phrase string").withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)).cast("int"))
        got = [tuple(r) for r in views.Views(spark, "/root/testdata/sf0.001").frequent(made, 8).collect()]
        assert len(got) == len({g[:2] for g in got}) and all(counts[lang, p] == n for lang, p, n in got)
        for lang in ("en", "fr", "de", None):
            assert sorted((-n, p) for x, p, n in got if x == lang)[:8] == top(lang)


def test_texts_are_not_shuffled_for_their_urls(spark):
    """Whatever Spark thinks of the size of pages, whose html is no part of it."""
    from quillspark.plans import queries as plans

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.QUERIES["a16_ngram_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_pairs_are_counted_by_document_without_a_row_each(spark, monkeypatch):
    """Against plain counts: repeats within a text, white space of all kinds, marks, null texts and languages, texts over several slices; and the totals bound them."""
    from quillspark.operators import pairs

    monkeypatch.setattr(pairs, "TEXTS", 3)
    monkeypatch.setattr(pairs, "LANGUAGES", 1)
    texts = [("en", "a b  a b c1 d\x0be\n"), ("en", "a b, a"), (None, "a b"), ("zh", "气候 变化\tx"), ("en", None), ("de", ""), ("de", " é f g"), ("en", "verylongword" * 3 + " b"), ("en", "a b c"), ("de", "é f")]
    rows = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    counts = {}
    for lang, text in texts:
        ws = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
        for pair in {(a, b) for a, b in zip(ws, ws[1:], strict=False) if a.isalpha() and b.isalpha()}:
            counts[lang, " ".join(pair)] = counts.get((lang, " ".join(pair)), 0) + 1
    totals = pairs.bucket_totals(rows)
    assert sum(r["total"] for r in totals.collect()) == sum(counts.values())
    assert {(r["lang"], r["phrase"]): r["docs"] for r in pairs.pair_counts(rows, totals).collect()} == counts
    one = totals.where("lang = 'zh'").limit(1)
    assert [r["docs"] for r in pairs.pair_counts(rows, one).collect()] == [1]


def test_texts_are_searched_once_for_each_query(spark):
    """What a query makes of the matches reads them as a table."""
    from quillspark.plans import queries as plans

    for name in ("d06_mapping_stats", "d10_signal_counts", "a21_article_review"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "text#" not in plan


def test_contexts_are_made_of_anchors_alone(spark):
    """Anchors are sought before contexts are made, in texts and blocks that hold a phrase; capital sigmas at a cut are found."""
    phrases = spark.createDataFrame([("topic", "t", "of the", "en", "space"), ("topic", "u", "ας", None, "character")], "evidence_kind string, dimension_id string, phrase string, language string, segmentation string")
    articles = spark.createDataFrame([(1, "en", "End of\n the day OF"), (2, "fr", "of the day"), (3, "en", "of a the"), (4, "el", "α" * 12 + "Σ" + "α" * 20)], "doc_id int, lang string, text string")
    every, some = matching.ngram_rows(articles, ["doc_id", "lang"]), matching.anchored_rows(articles, phrases, ["doc_id", "lang"])
    listed = lambda df: sorted(map(repr, matching.match_ngrams(df, phrases).collect()))
    assert listed(every) == listed(some) and {r["doc_id"] for r in some.collect()} == {1, 4}
    assert "LeftSemi" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_live_articles_are_not_shuffled(spark, monkeypatch):
    from quillspark.plans import queries as plans
    from quillspark.plans import round_trips  # noqa: F401

    monkeypatch.setattr(type(spark.range(1)), "repartition", None)
    assert plans.QUERIES["j04_live_matches"](spark, "/root/testdata/sf0.001").count() == 2


def test_pages_of_events_are_dealt_by_their_number(spark, monkeypatch):
    """Not by the session's number of partitions, which doesn't grow with the events."""
    from quillspark.plans import queries as plans
    from quillspark.plans import round_trips

    seen, write = [], round_trips.documents
    monkeypatch.setattr(round_trips, "PAGES", 1)
    monkeypatch.setattr(round_trips, "documents", lambda *a: (seen.append(a[4]), write(*a))[1])
    assert plans.QUERIES["a10_event_catalogue"](spark, "/root/testdata/sf0.01").count() == 15_000 and seen == [2]
