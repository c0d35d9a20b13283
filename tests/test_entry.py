"""The registered queries, against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import queries as plans

SF = "/root/testdata/sf0.001"
SOME = ["a05_event_scan", "a21_article_review", "c02_longest_suffix", "c06_dense_panel", "c10_point_in_polygon", "d10_signal_counts", "d17_d19_coverage_summary", "d24_top_markets", "h02_field_merge", "i01_missing_cells", "j02_live_counts", "a09_fire_detections", "a09_foreign_days", "c14_event_windows", "c15_label_suggestions", "a10_event_catalogue", "a11_country_boundaries", "a13_country_shares", "a15_phrase_tables", "a26_serving_rows", "j01_ingest", "j04_live_matches", "c01_anchored_matches", "h02_collisions", "h04_refresh", "j02_late_rows"]


def shown(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = duck.sql(entry.oracle_sql()[name])
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    other = sorted(range(len(rows.columns)), key=lambda i: rows.columns[i])
    assert [got.columns[i] for i in order] == [rows.columns[i] for i in other]
    assert sorted(tuple(shown(r[i]) for i in order) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in other) for r in rows.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
