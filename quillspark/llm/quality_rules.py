"""Quality rules by weak supervision.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0); the rules overlap, and none is beyond
doubt. Expectation-maximisation over the counts of vote patterns estimates, without labels, how often each rule casts each
vote on good and on bad documents, and every document gets a posterior probability of being good, in place of the demand that
it pass all rules: a bad vote of a rule that errs now and then is outvoted, several that agree are not. An abstention says nothing:
of a rule only the chances of its two votes count, among the documents that it votes on. The estimate starts from STRENGTH votes
of each rule as first_model has them, which steady it on few rows and weigh nothing on many. The pattern table has
at most 3 to the number of rules rows (59,049), whatever the corpus; it goes to the driver, where the estimate is fitted.
All that reads documents are DataFrame functions.

Cases: a null text has no words, an empty text neither; repeated rows are judged alike; an empty table gives an empty
result and leaves the starting parameters; very long texts cost a sort of their 3-word windows. Other columns pass
through; those of the names added are replaced.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BLANKS, stored, words

#: (name, good, bad): conditions on the counts; neither: abstain.
RULES = (
    ("symbols", "n_symbols <= 0.01 * n_words", "n_symbols > 0.1 * n_words"),
    ("letters", "n_odd <= 0.05 * word_chars", "n_odd > 0.1 * word_chars"),
    ("repeats", "n_repeat_words <= 0.03 * n_words", "n_repeat_words > 0.12 * n_words"),
    ("duplicate_lines", "n_dup_lines = 0", "n_dup_lines > 0.15 * n_text_lines"),
    ("capitals", "n_upper <= 0.03 * word_chars", "n_upper > 0.1 * word_chars"),
    ("marks", "n_marks <= 0.05 * n_words", "n_marks > 0.2 * n_words"),
    ("word_length", "word_chars BETWEEN 4.6 * n_words AND 5.6 * n_words", "word_chars < 4.25 * n_words OR word_chars > 7 * n_words"),
    ("variety", "n_unique >= 0.7 * n_words", "n_unique < 0.6 * n_words"),
    ("sentences", "n_ends BETWEEN 0.05 * n_words AND 0.13 * n_words", "n_ends < 0.03 * n_words OR n_ends > 0.2 * n_words"),
    ("short_words", "n_short BETWEEN 0.4 * n_words AND 0.6 * n_words", "n_short < 0.25 * n_words"),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words", "n_upper", "n_marks", "n_odd", "n_unique", "n_ends", "n_short")
VOTES = tuple(f"vote_{name}" for name, _, _ in RULES)


def windows(ws: Column) -> Column:
    """The hashes of all 3-word windows."""
    starts = F.sequence(F.lit(0), F.size(ws) - 3)
    return F.when(F.size(ws) >= 3, F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def covered(hashes: Column) -> Column:
    """Words that lie in a window found twice or more: hashes are sorted with their places, and equal ones meet."""
    one = F.element_at(
        F.transform(
            F.array(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))),
                            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                        )
                    )
                )
            ),
        ),
        1,
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), one).otherwise(F.lit(0)).cast("long")


def without(text: Column, pattern: str) -> Column:
    """How many code points of text match the one-character pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def among(text: Column, characters: str) -> Column:
    """How many code points of text are among the characters."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with FEATURES, the votes and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.drop(*FEATURES, *VOTES, "base_failed").withColumns({"__words": words(F.col(text_col)), "__lines": F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    rows = rows.withColumn("__windows", windows(F.col("__words")))
    rows = rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": among(text, "#*$%&|<>"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_text_lines": F.size("__lines").cast("long"),
            "n_repeat_words": covered(F.col("__windows")),
            "n_upper": without(text, r"\p{Lu}"),
            "n_marks": among(text, "!?"),
            "n_odd": without(text, r"[^\p{L}]") - F.length(text) + F.length(F.array_join("__words", "")),
            "n_unique": F.size(F.array_distinct("__words")).cast("long"),
            "n_ends": among(text, "."),
            "n_short": F.size(F.filter("__words", lambda w: F.length(w) <= 4)).cast("long"),
        }
    ).drop("__words", "__lines", "__windows")
    votes = {v: F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("tinyint") for v, (_, good, bad) in zip(VOTES, RULES, strict=True)}
    return rows.withColumns(votes | {"base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))})


Model = tuple[list[float], list[list[list[float]]]]  # shares of good and bad; for either and each rule the weights of votes -1, 0 and 1
#: Rows of the starting model that count as seen.
STRENGTH = 100
#: Rounds of the estimate at most; it settles long before (20 on the tables here).
ROUNDS = 1000


def first_model() -> Model:
    """Most documents are good; rules seldom call those bad."""
    return [0.9, 0.1], [[[bad, 1.0, 1 - bad] for _ in RULES] for bad in (0.04, 0.57)]


def posteriors(model: Model) -> Column:
    """The probability of being good, given the votes."""
    shares, chances = model

    def likelihood(z: int) -> Column:
        total = F.lit(log(shares[z]))
        for v, of in zip(VOTES, chances[z], strict=True):
            total += F.element_at(F.array(*(F.lit(log(p)) for p in of)), F.col(v).cast("int") + 2)
        return total

    return 1 / (1 + F.exp(likelihood(1) - likelihood(0)))


def estimate(voted: DataFrame, close: float = 1e-7) -> Model:
    """Expectation-maximisation over the vote patterns of all rows, until no chance moves by close; without rows the starting model.

    STRENGTH votes of the starting model count with those cast.
    """
    rows = voted.groupBy(*VOTES).agg(F.count("*").alias("n")).collect()  # a row per pattern
    if not rows:
        return first_model()
    first_shares, first = (np.array(x) for x in first_model())
    shares, chances = first_shares, first
    patterns, n = np.array([r[:-1] for r in rows], int) + 1, np.array([r[-1] for r in rows], float)
    cast = np.eye(3)[patterns]  # pattern, rule, vote
    cast[:, :, 1] = 0  # abstentions don't count
    for _ in range(ROUNDS):
        logs = np.log(shares) + np.einsum("pkv,zkv->pz", cast, np.log(chances))
        weights = np.exp(logs - logs.max(axis=1, keepdims=True))
        weights *= (n / weights.sum(axis=1))[:, None]
        total, before = weights.sum(axis=0), chances
        shares = (total + STRENGTH * first_shares) / (total.sum() + STRENGTH)
        chances = np.einsum("pz,pkv->zkv", weights, cast) + STRENGTH * first
        chances /= chances[:, :, [0, 2]].sum(axis=2, keepdims=True)
        chances[:, :, 1] = 1
        if np.abs(chances - before).max() < close:
            break
    return shares.tolist(), chances.tolist()


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """The columns keep of docs with the counts, votes, base_failed, posterior and kept.

    kept: not base_failed, and a posterior probability of being good of at least least. The counts are stored once, and
    read for the estimate and for the verdicts.
    """
    counted = stored(features(docs.select(*dict.fromkeys((*keep, text_col))), text_col).select(*keep, *FEATURES, *VOTES, "base_failed"), "quality-counts")
    model = estimate(counted)
    return counted.withColumn("posterior", posteriors(model)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
