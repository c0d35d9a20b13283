"""What a registered stream leaves behind."""

import json

import pytest

from quillspark.plans import queries as plans
from quillspark.streaming.attention import drained, without_repeats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j02_live_counts", "j03_live_without_repeats"])
def test_a_stream_goes_to_the_shared_folder(spark, name):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://").rstrip("/")
    tables = {t.name for t in spark.catalog.listTables()}
    got = plans.QUERIES[name](spark, SF)
    assert {t.name for t in spark.catalog.listTables()} == tables  # the memory sink leaves one
    assert got.inputFiles() and all(f.removeprefix("file://").startswith(f"{shared}/quillspark/live-") for f in got.inputFiles())
    top = got.inputFiles()[0].removeprefix("file://").split("/rows/")[0]
    with open(f"{top}/state/metadata") as f:
        assert json.load(f)["id"]


def test_batches_of_a_stream_come_together(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, 1_700_000_000 + i) for i in range(60)], "user_id long, s long").selectExpr("user_id", "timestamp_seconds(s) AS ts")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(without_repeats(read(), "user_id", "60 days"))
    assert sorted(r["user_id"] for r in got.collect()) == list(range(7))
    counts = drained(read().groupBy("user_id").count(), "complete")
    assert sum(r["count"] for r in counts.collect()) == 60 and counts.count() == 7
    empty = tmp_path / "empty"
    empty.mkdir()
    assert drained(spark.readStream.schema(rows.schema).parquet(str(empty))).count() == 0
