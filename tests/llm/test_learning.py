"""Language identification, hard negatives and spelling variants, each against a plain version or held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives, language_id, spelling
from tests.llm.conftest import SF

# Hard negatives


def plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) by holding every anchor against every row."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (label, v) in best.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, k) for i, (k, w) in best.items() if i != a and len(w) == len(v))
        for less, p, k in [x for x in scored if x[2] == label][:5]:
            fit = [(m, i) for m, i, other in scored if other != label and -30 * less <= -100 * m <= -90 * less][:10]
            out += [(a, p, n, i, -less, -m) for n, (m, i) in enumerate(fit, 1)]
    return out


EMBEDDINGS = "vec_id long, label int, embedding array<float>"


def test_negatives_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    expected = plain_negatives([(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()])
    extra = table.withColumns({c: F.lit(c) for c in ("id", "v", "rank", "asks", "means", "dim")})
    assert Counter(map(tuple, hard_negatives.negatives(extra).collect())) == Counter(expected) and expected


@pytest.mark.parametrize("tile", [4, 512])
def test_negatives_of_odd_vectors(spark, monkeypatch, tile):
    """Nulls, infinities, ties, copies, repeated ids, other lengths, empty and huge vectors; small cells, so that several meet."""
    for name, n in (("ANCHORS", tile), ("ROWS", 2 * tile), ("TILE", tile)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 9))
    rows = [(i * 10, int(rng.integers(0, 3)), (centres[i % 3] + 0.3 * rng.normal(size=9)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(2001, 1, rows[3][2]), (2003, 2, rows[3][2]), (2003, 1, rows[4][2]), (100, 0, rows[5][2]), rows[0], rows[0]]
    rows += [(None, 1, rows[0][2]), (5001, None, rows[0][2]), (5002, 1, None), (5003, 1, [1.0, None] + [0.5] * 7), (5004, 1, [math.inf] * 9), (5005, 2, [math.nan] * 9)]
    rows += [(6000, 1, [1.0, 2.0]), (6001, 2, [0.5, 0.5]), (6002, 1, [1.0, 1.0]), (6100, 4, []), (6101, 4, []), (6102, 5, [])]
    rows += [(7100, 1, [3e6] * 8), (7101, 1, [3e6 + k for k in range(8)]), (7102, 2, [2e6] * 8), (7103, 2, [-2e6] * 8), (7104, 3, [2e6] * 8)]
    got = hard_negatives.negatives(spark.createDataFrame(rows, EMBEDDINGS).repartition(7)).collect()
    expected = plain_negatives(rows)
    assert Counter(map(tuple, got)) == Counter(expected) and {6000, 6100, 7100, 100} <= {r[0] for r in expected}


def test_negatives_of_nothing(spark):
    assert hard_negatives.negatives(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert hard_negatives.negatives(spark.createDataFrame([(1, 1, [1.0])], EMBEDDINGS)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6))
def test_bounds_hold(dim, seed):
    rng = np.random.default_rng(seed)
    a, b = np.floor(256 * rng.normal(size=(4, dim))), np.floor(256 * rng.normal(size=(6, dim)))
    (ma, da), (mb, db), at = hard_negatives.segments(a), hard_negatives.segments(b), 0
    for level in hard_negatives.LEVELS:
        k = slice(at, at + min(level, dim))
        at = k.stop
        assert (np.abs(a @ b.T - ma[:, k] @ mb[:, k].T) <= da[:, k] @ db[:, k].T + 1e-3).all()


# Spelling variants


def plain_groups(rows):
    counts = Counter()
    for i, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    by_cut = defaultdict(set)
    for w in words:
        for x in cut(w):
            by_cut[x].add(w)
    one_edit = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(a) == len(b) + 1 and b in cut(a) or len(b) == len(a) + 1 and a in cut(b)
    near = {w: {v for x in cut(w) for v in by_cut[x] | ({x} & words.keys()) if one_edit(w, v)} | {v for v in by_cut[w] if one_edit(w, v)} for w in words}
    form = {w: min((v for v in near[w] if words[v] >= 5 * n), key=lambda v: (-words[v], v), default=None) for w, n in words.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def repeated(pairs):
    """Documents of a null id, in which no run is changed, that hold each word so often."""
    return [(None, " ".join([w] * n)) for w, n in pairs]


LONG_WORD = "abcdefghijklmnopqrstuvwxyz" * 5
CHAIN = [("qbcdef", 5), ("qbcdeg", 25), ("qbcdgg", 125), ("qbcggg", 625), ("qbgggg", 3125), ("qbggggg", 20_000), ("ébgggg", 5), ("qbcdefg", 24), ("bcdefg", 7)]
VARIANTS = repeated([*CHAIN, (LONG_WORD, 30), (LONG_WORD[:70] + LONG_WORD[71:], 6), (LONG_WORD[:-1], 5), (LONG_WORD[1:], 5), ("x" + LONG_WORD, 5), (LONG_WORD[:3] + "zz" + LONG_WORD[5:], 5), ("aaaaaa", 5), ("aaaaaaa", 6), ("aaaaaab", 5), ("baaaaaa", 50), ("straße", 5), ("strasse", 9), ("a×b÷cd", 5), ("a×b÷ce", 5)])


@pytest.mark.parametrize("frequent", [2, 200])
def test_spelling(spark, docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    more = spark.createDataFrame(VARIANTS, "doc_id long, text string")
    got = [tuple(r) for r in spelling.groups(docs.select("doc_id", "text", "id", "kept").unionByName(more, allowMissingColumns=True)).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    expected = plain_groups([*rows, *VARIANTS])
    assert Counter(got) == Counter(expected)
    assert dict((r[0], r[5]) for r in expected)["qbcdef"] == "qbggggg" and sum(r[2] for r in expected) > 50


def test_spelling_of_nothing(none):
    assert spelling.groups(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=3, max_size=14), st.integers(0, 14), st.sampled_from("abcé"), st.sampled_from(["put", "cut", "change"]), st.sets(st.text("abcé", min_size=2, max_size=3), max_size=30), st.sampled_from([3, 48]))
def test_words_one_edit_apart_share_a_key(word, at, letter, kind, frequent, places):
    at = min(at, len(word) - (kind != "put"))
    other = word[:at] + (letter if kind != "cut" else "") + word[at + (kind != "put") :]
    held, spelling.PLACES = spelling.PLACES, places
    try:
        a, b = spelling.keys_of(word, frozenset(frequent)), spelling.keys_of(other, frozenset(frequent))
    finally:
        spelling.PLACES = held
    taken = lambda keys, t: {k for k, was in keys if was == t}
    assert taken(a, True) & taken(b, True) if len(word) == len(other) else (taken(a, False) & taken(b, True) if len(other) > len(word) else taken(a, True) & taken(b, False))


# Language identification


def test_languages_of_held_out_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = table.withColumns({"score": F.lit("x"), "held_out": F.lit(1), "found": F.lit(2), "id": F.lit(3)})
    got = {r["doc_id"]: r for r in language_id.predictions(extra).collect()}
    assert len(got) == table.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r["lang"], got[r["doc_id"]]) for r in table.collect() if got[r["doc_id"]]["held_out"]]
    right = [lang == r["lang_pred"] for lang, r in held]
    assert np.mean(right) >= 0.97 and all(0 <= r["score"] <= 1 for _, r in held)
    assert abs(np.mean([r["score"] for _, r in held]) - np.mean(right)) < 0.03  # the temperature makes scores honest


def test_held_out_languages_are_not_learnt(spark):
    """Wrong languages of held-out documents change nothing."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    wrong = table.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    one, two = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.predictions(x).collect()} for x in (table, wrong))
    assert one == two


def test_odd_texts_have_a_language(spark, docs, rows):
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    got = language_id.predictions(labelled).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all((by_id[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or ""))) for i, t in rows if i != 1005)
    assert by_id[None]["held_out"] is False and {r["lang_pred"] for r in got} == {"aa", "bb", "und"}


def test_languages_of_nothing(docs, none):
    none = none.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.predictions(none).count() == 0
    unlabelled = language_id.predictions(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}


def test_grams_of_pieces(monkeypatch):
    text = "Ein Satz, 12 Wörter!! und noch etwas mehr Text " * 300
    whole = language_id.grams(text)
    monkeypatch.setattr(language_id, "PIECE", 1000)
    assert all((a == b).all() for a, b in zip(whole, language_id.grams(text), strict=True))
    assert language_id.code_points("A,, b\n3c").tolist() == [ord(c) for c in " a b c "]


def test_temperature():
    rng = np.random.default_rng(3)
    logits = 2 * rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in language_id.softmax(logits)])
    assert abs(language_id.best_temperature(5 * logits, y) - 5) < 0.6
