"""The summed event operators against rows made one by one, and the event view against its table."""

import hashlib
from datetime import date
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import events
from quillspark.plans import queries as plans
from quillspark.plans.views import BLOC, Views

SF = "/root/testdata/sf0.001"


def listed(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def fixture(spark):
    d = lambda n: date.fromordinal(date(2025, 3, 1).toordinal() + n)
    event = spark.createDataFrame(
        [(1, d(0), d(1), [1, 2]), (2, d(0), d(1), [3, 3]), (3, d(2), d(2), []), (4, d(-1), d(0), None), (5, d(0), d(1), [9]), (6, d(0), d(0), [1, None])],
        "record_id long, start_day date, end_day date, geography_ids array<long>",
    )
    rows = [(d(n), g, t, None if (n + (g or 0)) % 5 == 0 else 3 * n + 100 + (g or 7), None if n % 3 == 0 else n + 50) for n in range(-6, 7) for g in (1, 2, 3, None) for t in "ab" if (n, g) != (2, 1)]
    rows += [(d(0), 1, "a", 5, 6), (d(1), 3, "b", None, None)]
    return event, spark.createDataFrame(rows, "day date, geography long, topic_id string, matched_count long, political_count long")


def test_summed_events_equal_the_rows(spark, monkeypatch):
    event, attention = fixture(spark)
    rows = events.event_rows(event, attention, [2, 3], days=3).cache()
    for cells in (events.CELLS, 1):
        monkeypatch.setattr(events, "CELLS", cells)
        summed = events.scope_days(event, attention, [2, 3], days=3).cache()
        got = summed.groupBy("record_id", "scope").agg(F.sum("rows"), F.sum("matched_count"))
        assert listed(got) == listed(rows.groupBy("record_id", "scope").agg(F.count("*"), F.sum("matched_count")))
        series = events.daily_series(rows)
        assert listed(events.event_series(summed).select(series.columns)) == listed(series)
        means = events.phase_means(rows)
        assert listed(events.event_phase_means(summed).select(means.columns)) == listed(means)
        markets, totals, top = events.market_sums(event, attention, [2, 3], days=3), events.totals(rows), events.top_markets(rows, 2)
        assert listed(events.event_totals(summed, markets).select(totals.columns)) == listed(totals)
        assert listed(events.event_top_markets(markets, 2).select(top.columns)) == listed(top)
    assert {r["scope"] for r in rows.select("scope").distinct().collect()} == set(events.SCOPES)


def test_every_order_is_an_event(spark):
    v = Views(spark, SF)
    orders = v.table("orders")
    assert v.hazard_events.count() == orders.count() == v.hazard_events.select("record_id").distinct().count()
    first = v.hazard_events.orderBy("record_id").limit(20)
    rows = events.event_rows(first, v.panel, BLOC)
    top = events.top_markets(rows)
    assert listed(events.event_top_markets(events.market_sums(first, v.panel, BLOC)).select(top.columns)) == listed(top)


def test_exact_test_counts_every_split(spark):
    before, after = [3.0, 1.5, 4.0], [4.0, 6.25, 2.0]
    pairs = spark.createDataFrame([(1, "global", "t", before, after, True), (2, "global", "t", [1.0] * 3, [1.0] * 3, True), (3, "bloc", "t", before, [1.0], False)], "record_id int, scope string, topic_id string, before array<double>, after array<double>, testable boolean")
    got = {r["record_id"]: r for r in events.exact_test(pairs).collect()}
    pooled = before + after
    differences = [(sum(pooled) - sum(c)) / 3 - sum(c) / 3 for c in combinations(pooled, 3)]
    observed = sum(after) / 3 - sum(before) / 3
    assert set(got) == {1, 2} and got[1]["extreme"] == sum(x >= observed - 1e-12 for x in differences) and got[1]["permutations"] == 20
    assert got[2]["extreme"] == 20 and got[2]["p_value"] == 1.0


def shuffles(n, m, draws):
    """The first n places of each draw, in the order of their hashes."""
    return [sorted(range(n + m), key=lambda p: hashlib.sha256(f"{d}|{p}".encode()).hexdigest())[:n] for d in range(draws)]


def test_sampled_test_draws_splits(spark):
    """Against a brute-force run of the same draws, and within four standard errors of all splits; sizes may differ from pair to pair."""
    rng = np.random.default_rng(3)
    sizes = [(5, 4), (3, 9), (5, 4), (12, 13)]
    values = [(i, "bloc", "t", rng.integers(0, 40, b).astype(float).tolist(), rng.integers(0, 60, a).astype(float).tolist(), True) for i in range(16) for b, a in [sizes[i % 4]]]
    pairs = spark.createDataFrame(values, "record_id int, scope string, topic_id string, before array<double>, after array<double>, testable boolean")
    got = {r["record_id"]: r for r in events.sampled_test(pairs, draws=2000).collect()}
    drawn = {s: shuffles(*s, 2000) for s in set(sizes)}
    assert len(set(map(tuple, map(sorted, drawn[5, 4])))) == 126
    for i, _, _, before, after, _ in values:
        n, m, pooled, observed = len(before), len(after), before + after, sum(after) / len(after) - sum(before) / len(before)
        extreme = lambda chosen: (sum(pooled) - chosen) / m - chosen / n >= observed - 1e-12  # noqa: B023, E731
        brute = sum(extreme(sum(pooled[p] for p in s)) for s in drawn[n, m])
        assert got[i]["extreme"] == brute and got[i]["permutations"] == 2000 and got[i]["p_value"] == (brute + 1) / 2001
        if n + m < 13:
            exact = np.mean([extreme(sum(c)) for c in combinations(pooled, n)])
            assert abs(got[i]["p_value"] - exact) <= 4 * np.sqrt(exact * (1 - exact) / 2000) + 1e-3


def test_all_splits_are_counted_whatever_the_sizes(spark):
    """By halves and by listing, against every combination; no Python worker runs."""
    rng = np.random.default_rng(8)
    sizes = [(2, 2), (7, 7), (2, 9), (9, 2), (8, 9), (3, 19), (20, 3), (2, 30), (5, 5)]
    rows = [(i, "global", "t", (rng.integers(0, 9, b) / 4).tolist(), (rng.integers(1, 12, a) / 4).tolist(), True) for i, (b, a) in enumerate(sizes)]
    pairs = spark.createDataFrame(rows, "record_id int, scope string, topic_id string, before array<double>, after array<double>, testable boolean")
    out = events.exact_test(pairs)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["record_id"]: (r["extreme"], r["permutations"]) for r in out.collect()}
    for i, _, _, before, after, _ in rows:
        pooled, n, m = before + after, len(before), len(after)
        found = [(sum(pooled) - sum(c)) / m - sum(c) / n >= sum(after) / m - sum(before) / n - 1e-12 for c in combinations(pooled, n)]
        assert got[i] == (sum(found), len(found))


def test_pairs_of_windows_equal_those_of_the_series(spark):
    event, attention = fixture(spark)
    series = events.event_series(events.scope_days(event, attention, [2, 3], days=9))
    keep = lambda df: listed(df.where("size(before) + size(after) > 0").select("record_id", "scope", "topic_id", "before", "after", "testable"))
    for days in (2, 5):
        expected = keep(events.before_after(event, series, days))
        assert keep(events.event_before_after(event, attention, [2, 3], days)) == expected and expected


def test_the_test_fits_the_sizes(spark):
    """Exact up to 50,000 splits, else drawn; no test with fewer than two days on a side."""
    rng = np.random.default_rng(4)
    sizes = {1: (7, 7), 2: (9, 9), 3: (8, 11), 4: (14, 14), 5: (1, 7), 6: (2, 2)}
    rows = [(i, "global", "t", rng.integers(0, 9, b).astype(float).tolist(), rng.integers(1, 12, a).astype(float).tolist(), b == a == 7) for i, (b, a) in sizes.items()]
    pairs = spark.createDataFrame(rows, "record_id int, scope string, topic_id string, before array<double>, after array<double>, testable boolean")
    got = {r["record_id"]: r for r in events.increase_test(pairs).collect()}
    assert {i: (r["method"], r["permutations"]) for i, r in got.items()} == {1: ("exact", 3432), 2: ("exact", 48620), 3: ("monte_carlo", 10_000), 4: ("monte_carlo", 10_000), 6: ("exact", 6)}
    exact, drawn = events.exact_test(pairs.where("record_id = 1")).first(), events.sampled_test(pairs.where("record_id = 4").withColumn("testable", F.lit(True))).first()
    assert got[1]["p_value"] == exact["p_value"] and got[4]["p_value"] == drawn["p_value"] and got[4]["extreme"] == drawn["extreme"]
    with pytest.raises(Exception, match="use increase_test"):
        events.exact_test(pairs.where("record_id = 4").withColumn("testable", F.lit(True))).collect()


def test_window_totals_equal_the_rows(spark):
    event, attention = fixture(spark)
    rows = events.event_rows(event, attention, [2, 3], days=3)
    got = events.window_totals(event, attention, [2, 3], days=3)
    far = event.select(F.col("record_id") + 10, F.date_add("start_day", 400), F.date_add("end_day", 400), "geography_ids").union(event.select(F.col("record_id") + 20, F.date_sub("start_day", 400), F.date_sub("end_day", 400), "geography_ids"))
    assert events.window_totals(far.toDF(*event.columns), attention, [2, 3], days=3).isEmpty() and events.window_totals(event, attention.limit(0), [2, 3]).isEmpty()
    sparse = attention.where("day IN ('2025-02-25', '2025-03-02', '2025-03-06') AND coalesce(geography, 0) <> 2")
    for each in (attention, sparse):
        pairs = events.event_rows(event, each, [2, 3], days=2)
        assert listed(events.event_top_markets(events.market_sums(event, each, [2, 3], days=2), 3)) == listed(events.top_markets(pairs, 3).select("record_id", "scope", "geography", "matches", "rank"))
    known = rows.groupBy("record_id", "scope").agg(F.count("*").alias("rows"), F.sum(F.coalesce("matched_count", F.lit(0))).alias("matches"))
    keep = lambda df: listed(df.select("record_id", "scope", "rows", "matches"))
    assert keep(got) == keep(known)


def test_sampled_query_has_all_scopes_and_draws(spark, tmp_path):
    orders = Views(spark, SF).table("orders").limit(12).withColumn("o_orderdate", F.lit("1995-06-01").cast(Views(spark, SF).table("orders").schema["o_orderdate"].dataType))
    base = Views(spark, SF)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    base.table("customer").write.parquet(f"{tmp_path}/customer.parquet")
    base.table("supplier").write.parquet(f"{tmp_path}/supplier.parquet")
    line, days = base.table("lineitem").limit(1), F.explode(F.sequence(F.lit("1995-05-01").cast("date"), F.lit("1995-07-10").cast("date")))
    kind = line.schema["l_shipdate"].dataType
    made = line.withColumn("l_shipdate", days).withColumn("l_shipdate", F.col("l_shipdate").cast(kind)).drop("l_suppkey").crossJoin(base.table("supplier").select(F.col("s_suppkey").alias("l_suppkey")))
    made.select(line.columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.QUERIES["d26_sampled_test"](spark, str(tmp_path)).collect()
    assert {"global", "international"} <= {r["scope"] for r in got} and {r["permutations"] for r in got} == {10_000}


def test_contexts_of_every_word(spark):
    got, v = plans.QUERIES["b07_context"](spark, SF), Views(spark, SF)
    words = v.articles.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).first()[0]
    assert got.count() == words == got.select("doc_id", "pos").distinct().count()


def test_equal_windows_are_made_once(spark):
    """Results for all events are those of each event, made once for each first day, last day and markets (null ones too); equal pairs are tested once."""
    event, attention = fixture(spark)
    many = event.union(event.withColumn("record_id", F.col("record_id") + 10)).union(event.withColumn("record_id", F.col("record_id") + 20))
    asked = []

    def make(kinds):
        asked.append(kinds.count())
        return events.event_phase_means(events.scope_days(kinds, attention, [2, 3], days=3))

    got, expected = events.once_per_window(many, make), events.event_phase_means(events.scope_days(many, attention, [2, 3], days=3))
    assert asked == [event.count()] and got.columns == expected.columns and listed(got) == listed(expected)
    pairs = spark.createDataFrame([(i, "global", "t", [1.0, 2.0, 3.0], [2.0, 3.0, 5.0 + i % 2], True) for i in range(40)], "record_id int, scope string, topic_id string, before array<double>, after array<double>, testable boolean")
    tested = events.increase_test(pairs)
    means = events.exact_test(pairs).select("record_id", "extreme", "p_value")
    assert listed(tested.select("record_id", "extreme", "p_value")) == listed(means)
    assert "Aggregate" in tested._jdf.queryExecution().optimizedPlan().toString()


def test_series_of_all_events_are_made_once_a_set_of_markets(spark, monkeypatch):
    """Those of the rows, also of unknown, null and reversed days and markets; made for all sets at once, or once a window."""
    event, attention = fixture(spark)
    d = lambda n: date.fromordinal(date(2025, 3, 1).toordinal() + n)
    event = event.union(spark.createDataFrame([(7, d(4), d(-4), [2, 1]), (8, None, d(0), [1, 2]), (9, d(90), d(91), [1, 2]), (10, d(1), d(2), [1, 2])], event.schema))
    expected = events.daily_series(events.event_rows(event, attention, [2, 3], days=3))
    columns = ["record_id", "scope", "topic_id", "day", "value", "relative_day"]
    for cells in (events.CELLS, 1):
        monkeypatch.setattr(events, "CELLS", cells)
        got = events.series_of_windows(event, attention, [2, 3], days=3)
        assert got.columns == columns and listed(got) == listed(expected.select(columns))
    assert events.series_of_windows(event.where("false"), attention, [2, 3]).count() == events.series_of_windows(event, attention.where("false"), [2, 3]).count() == 0


def test_no_row_of_the_event_series_is_shuffled_or_sorted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.QUERIES["d21_event_series"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    made = plan.split("Exchange")[0]  # what stands over the last shuffle
    assert made.count("Generate") == 2 and "Sort" not in made
