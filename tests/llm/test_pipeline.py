"""The pipeline's stages, each against a plain version over its own input."""

import re

import pytest

import corpus_pipeline
from quillspark.llm import simhash
from quillspark.llm.common import stored
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stored(stage(spark, docs, SF), "test-stage")
        out.append((name, {r["doc_id"]: r["text"] for r in docs.collect()}, got))
        docs = got
    return out


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(got.columns == columns for _, _, got in stages[:-1]) and [n for n, _, _ in stages] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]


def test_quality_stage_keeps_clean_documents(spark, stages):
    _, before, got = stages[0]
    kept = {r["doc_id"] for r in got.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(q == 0 for i, q in labels.items() if i in kept)
    assert all(i in kept for i, q in labels.items() if q == 1 and len(before[i].split()) >= 60)


def test_line_stage(stages):
    _, before, got = stages[1]
    holders: dict[str, set] = {}
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, text in before.items():
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = lambda x, i: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i
    expected = {i: "\n".join(x for x in text.split("\n") if not gone(x, i)) for i, text in before.items() if any(not gone(x, i) for x in text.split("\n"))}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == expected and all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_near_stage_keeps_one_of_each_group(stages):
    _, before, got = stages[2]
    ids, kept = sorted(before), {r["doc_id"] for r in got.collect()}
    sets = {i: set(simhash.shingle_set(before[i], 5).tolist()) for i in ids}
    for n, i in enumerate(ids):
        earlier = [j for j in ids[:n] if before[i] == before[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
        assert (i in kept) == (not earlier), i


def test_leaks_go_and_all_else_is_packed(spark, stages):
    _, before, got = stages[3]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tokens = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    grams = lambda t: {tuple(ws[k : k + 5]) for ws in [tokens(t)] for k in range(len(ws) - 4)}
    wanted = [grams(t) for t in items]
    leaked = {i for i, t in before.items() for g in [grams(t)] if any(len(q & g) >= 0.8 * len(q) for q in wanted if q)}
    kept = {r["doc_id"] for r in got.collect()}
    assert kept == set(before) - leaked
    assert {r["doc_id"] for r in stages[4][2].collect()} == kept


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4][2].count()
