"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and a path: it fits that host and its subdomains where the url's path starts with the rule's, and the
longest rule that fits decides. Urls that a rule decides are the labelled ones; trees are fitted on at most SAMPLE of
them (those with the smallest url hashes) over length, depth, digit ratio, entropy, parameter counts, label counts and
statistics of the host's suffix and of the path's first part, which are counted over all labelled urls. A labelled url sees them
through the hosts of other folds alone, so that no label explains itself, and every fourth one doesn't see them at all: the
trees so learn what a url looks like whose suffix was never labelled. The trees decide the urls no rule fits.

Cases: a null url, or one without ://, has an empty host and path, and is judged by the trees like any other; repeated urls
are judged alike; without labelled urls of both kinds the more common kind (of none: allow) is the verdict for all; an empty table
gives an empty result. Other columns pass through; host, path, rule, verdict and score replace columns of these names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, join_salted, stored

#: Labelled urls that the trees are fitted on, and suffixes or sections up to which their statistics are sent to every executor.
SAMPLE, BROADCAST_KEYS = 20_000, 10_000
FEATURES = ("f_length", "f_host_length", "f_path_length", "f_depth", "f_digit_ratio", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_longest_label", "f_suffix_rate", "f_suffix_count", "f_section_rate", "f_section_count")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(F.regexp_extract(url, pattern, n), F.lit("")) if n == 2 else ascii_lower(F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))) for n in (1, 2))


def fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)


def with_rules(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages with host, path, rule and rule_verdict."""
    host, path = split_url(F.col(url_col))
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    first = lambda what: F.coalesce(*(F.when(fits(r), F.lit(what(r))) for r in ordered), F.lit(None).cast("string"))
    return pages.withColumns({"host": host, "path": path}).withColumns({"rule": first(lambda r: r.text), "rule_verdict": first(lambda r: r.verdict)})


def count_of(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / F.lit(len(what))


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def lexical(judged: DataFrame, url_col: str = "url") -> DataFrame:
    """judged (with host and path) with the features but for the rates, suffix and section (the path's first part)."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return judged.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length(host).cast("double"),
            "f_path_length": F.length(path).cast("double"),
            "f_depth": count_of(path, "/"),
            "f_digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "f_entropy": entropy(url),
            "f_params": F.when(query == "", 0.0).otherwise(count_of(query, "&") + 1),
            "f_labels": F.size(labels).cast("double"),
            "f_hyphens": count_of(host, "-"),
            "f_longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "suffix": F.element_at(labels, -1),
            "section": F.coalesce(F.get(F.split(path, "/"), 1), F.lit("")),
        }
    )


FOLDS = 5


def with_rates(rows: DataFrame, key: str, url_col: str) -> tuple[DataFrame, float]:
    """rows (with rule_verdict and fold) with f_<key>_rate and f_<key>_count of their key, and the share of blocked urls among the labelled."""
    label = (F.col("rule_verdict") == "block").cast("double")
    each = rows.groupBy(key, "fold").agg(F.count("*").alias("__n"), F.count("rule_verdict").alias("n"), F.sum(label).alias("blocks"))
    folds = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "blocks"))))  # FOLDS entries at most
    rates = each.groupBy(key).agg(F.sum("__n").alias("__n"), F.sum("n").alias("n"), F.sum("blocks").alias("blocks"), folds.alias("folds")).where("n > 0")
    rates = stored(rates, f"{key}-rates")
    seen = rates.agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks"), F.count("*").alias("keys")).first()
    share = (seen["blocks"] or 0.0) / seen["n"] if seen["n"] else 0.0
    known = rows.join(F.broadcast(rates.drop("__n")), key, "left") if seen["keys"] <= BROADCAST_KEYS else join_salted(rows, rates, [key], [url_col], "left")
    labelled = F.col("rule_verdict").isNotNull()
    own = F.when(labelled, F.try_element_at("folds", F.col("fold")))
    unseen = labelled & (F.pmod(F.xxhash64(url_col, F.lit(key)), F.lit(4)) == 0)
    less = lambda c: F.when(unseen, 0).otherwise(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(own[c], F.lit(0)))
    features = {f"f_{key}_rate": (less("blocks") + 10 * share) / (less("n") + 10), f"f_{key}_count": F.log1p(less("n"))}
    return known.withColumns(features).drop("n", "blocks", "folds"), share


def featured(pages: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, float]:
    """pages with host, path, rule, rule_verdict, fold and FEATURES, and the share of blocked urls among the labelled."""
    rows = lexical(with_rules(pages, url_col, rules), url_col).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    rows, _ = with_rates(rows, "section", url_col)
    return with_rates(rows, "suffix", url_col)


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features")


def labelled_sample(known: DataFrame, url_col: str, sample: int) -> DataFrame:
    """label, fold and the features of at most so many labelled urls, those with the smallest hashes."""
    label = (F.col("rule_verdict") == "block").cast("double").alias("label")
    chosen = known.where("rule_verdict IS NOT NULL").select(label, "fold", *FEATURES, F.xxhash64(url_col).alias("h")).orderBy("h", *FEATURES).limit(sample).drop("h")
    rows = stored(chosen, "labelled-urls").repartition(4)
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    even = F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    return assembler().transform(rows.withColumn("weight", even))


def classifier(trees: int, depth: int) -> GBTClassifier:
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=64, seed=7, cacheNodeIds=False)


def verdicts(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, trees: int = 12, depth: int = 4) -> DataFrame:
    """pages with host, path, rule, verdict and score (the trees' probability of block; null where a rule decides)."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    known, share = featured(pages.select(*names), url_col, rules)
    if not 0 < share < 1:
        scored = known.withColumn("score", F.lit(share))
    else:
        model = classifier(trees, depth).fit(labelled_sample(known, url_col, sample))
        scored = model.transform(assembler().transform(known)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*names, "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))


def held_out(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, trees: int = 12, depth: int = 4) -> dict[str, float]:
    """How the trees judge labelled urls of hosts that they weren't fitted on (one fold): urls, accuracy, the share of the commoner
    label (what a constant would get), and how many free urls would be blocked."""
    known, _ = featured(pages.select(url_col), url_col, rules)
    labelled = labelled_sample(known, url_col, sample)
    model = classifier(trees, depth).fit(labelled.where("fold <> 0"))
    got = model.transform(labelled.where("fold = 0")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"), F.avg("label").alias("blocked")).first()
    free = model.transform(assembler().transform(known.where("rule_verdict IS NULL"))).agg(F.avg("prediction").alias("blocked")).first()
    return {"urls": got["n"], "accuracy": got["right"], "constant": max(got["blocked"], 1 - got["blocked"]), "free_blocked": free["blocked"]}
