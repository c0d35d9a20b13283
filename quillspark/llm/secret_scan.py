"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its content. A ledger on disk notes which blobs were
scanned under which version of which rule, what was found, and which paths held them; a scan reads only blobs that the ledger
lacks for some rule version, adds them, and joins the findings back to every row (path) that holds the blob. A run that ends
before its last write (that of what was scanned) is made again in full. DataFrame functions only.

Cases: a null text is an empty one; equal texts are one blob, scanned once; repeated rows each get the findings; an
empty table adds nothing. Other columns pass through; blob_id and findings replace columns of these names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import join_salted, new_path, stored


class Rule(NamedTuple):
    """A kind of secret; pattern has no group but the one whose length is judged, if any. version: a change of it rescans all."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: In the order in which kinds are listed. Runs of a class are greedy, so that the least lengths of the last two can stand in the pattern.
RULES = (
    Rule("assign", 1, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
FINDINGS = "array<struct<start:int,rank:int,kind:string,stop:int>>"
LEDGER = "blob_id string, kind string, version int, spans array<struct<start:int,stop:int>>"
SCANNED, PATHS = "blob_id string, rule string", "path_id string, blob_id string"


def pieces(text: Column, rule: Rule) -> Column:
    """For each match in turn: code points before it since the last match, its length, and the length that is judged; null if none."""
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    judged = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1)) if rule.group else whole
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.size(whole))
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(judged, F.length).alias("judged"))
    return F.when(text.rlike(rule.pattern), parts)


def voiced(rule: Rule) -> Column:
    """The rule and what it finds in text, if the blob needs it."""
    parts = F.when(F.array_contains("needs", rule.kind), pieces(F.col("text"), rule))
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), parts.alias("parts"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One LEDGER row for each blob (blob_id, text) and rule that needs it (column needs: kinds), spans in code points."""
    # outer: for explode Spark would scan twice, to filter on the number
    found = blobs.select("blob_id", F.explode_outer(F.filter(F.array(*(voiced(r) for r in rules)), lambda x: x["parts"].isNotNull())).alias("r"))
    one = found.select("blob_id", "r.*").where("kind IS NOT NULL").dropDuplicates(["blob_id", "kind"])  # rows that repeat an id and a text
    order = Window.partitionBy("blob_id", "kind").orderBy("pos")
    return (
        one.select("blob_id", "kind", "version", "least", F.posexplode("parts").alias("pos", "p"))
        .withColumn("stop", F.sum(F.col("p.gap") + F.col("p.size")).over(order).cast("int"))
        .where(F.col("p.judged") >= F.col("least"))
        .groupBy("blob_id", "kind", "version")
        .agg(F.array_sort(F.collect_set(F.struct((F.col("stop") - F.col("p.size")).alias("start"), "stop"))).alias("spans"))
    )


def read_ledger(spark: SparkSession, path: str, part: str = "findings", schema: str = LEDGER) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{part}")


def open_ledger(spark: SparkSession, path: str) -> None:
    """An empty ledger, unless there is one."""
    for part, schema in (("findings", LEDGER), ("scanned", SCANNED), ("paths", PATHS)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{part}")


def update_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the blobs of docs under the rule versions for which the ledger lacks them, and notes both.

    Every (path, blob) pair is noted too, once: a path whose text changed keeps all its versions.
    """
    spark = docs.sparkSession
    open_ledger(spark, path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.sha2(text, 256).alias("blob_id"), F.col(id_col).alias("row_id"), text.alias("text"))
    known = read_ledger(spark, path, "scanned", SCANNED).groupBy("blob_id").agg(F.collect_set("rule").alias("done"))
    kind_of = {r.kind: f"{r.kind}@{r.version}" for r in rules}
    needs = F.array_compact(F.array(*(F.when(~F.array_contains(F.coalesce("done", F.array().cast("array<string>")), v), F.lit(k)) for k, v in kind_of.items())))
    fresh = stored(
        rows.groupBy("blob_id").agg(F.min("row_id").alias("row_id"))
        .join(known, "blob_id", "left").select("blob_id", "row_id", needs.alias("needs")).where(F.size("needs") > 0),
        "fresh-blobs",
    )
    one = fresh.withColumnsRenamed({"blob_id": "b", "row_id": "r"})
    blobs = rows.join(one, (F.col("blob_id") == F.col("b")) & F.col("row_id").eqNullSafe(F.col("r"))).select("blob_id", "text", "needs")
    scan(blobs, rules).write.mode("append").parquet(f"{path}/findings")
    pairs = rows.select(F.col("row_id").cast("string").alias("path_id"), "blob_id").distinct()
    noted = read_ledger(spark, path, "paths", PATHS)
    stored(pairs.join(noted, pairs["path_id"].eqNullSafe(noted["path_id"]) & (pairs["blob_id"] == noted["blob_id"]), "left_anti"), "new-paths").write.mode("append").parquet(f"{path}/paths")
    rule = F.transform("needs", lambda k: F.element_at(F.create_map(*(F.lit(x) for kv in kind_of.items() for x in kv)), k))
    fresh.select("blob_id", F.explode(rule).alias("rule")).write.mode("append").parquet(f"{path}/scanned")


def blob_spans(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id and findings: the ledger's spans under the rules' versions, by start and then in the rules' order."""
    kinds = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}@{r.version}", i)))
    return (
        read_ledger(spark, path)
        .withColumn("rank", F.element_at(kinds, F.concat("kind", F.lit("@"), "version")))
        .where(F.col("rank").isNotNull())
        .select("blob_id", F.explode("spans").alias("s"), "rank", "kind")
        .groupBy("blob_id")
        .agg(F.array_sort(F.collect_set(F.struct("s.start", "rank", "kind", "s.stop"))).alias("findings"))
    )


def with_spans(paths: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """paths (blob_id) with findings, none where the blob has none."""
    counted = stored(spans.join(paths.groupBy("blob_id").agg(F.count("*").alias("__n")), "blob_id"), "blob-spans")
    found = join_salted(paths, counted, ["blob_id"], [by], "left")
    return found.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def history(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path_id, blob_id and findings of every version of every path that the ledger knows."""
    return with_spans(read_ledger(spark, path, "paths", PATHS), blob_spans(spark, path, rules), "path_id")


def findings(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with blob_id and findings (as blob_spans has them)."""
    paths = docs.withColumn("blob_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).drop("findings")
    return with_spans(paths, blob_spans(docs.sparkSession, path, rules), id_col)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document.

    A ledger of its own takes the table in two runs, a first half of the rows and then all of them: the second run scans
    those blobs alone that the first did not note.
    """
    ledger = new_path(docs.sparkSession, "blob-ledger")
    update_ledger(docs.where(F.xxhash64("doc_id") < 0), ledger)
    update_ledger(docs, ledger)
    out = findings(docs.select("doc_id", "text"), ledger)
    text = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    kinds = F.transform("findings", lambda x: x["kind"])
    count = {f"n_{r.kind}": F.size(F.filter(kinds, F.lit(r.kind).__eq__)).cast("long") for r in RULES}
    return out.withColumns(count | {"spans": text}).select("doc_id", *count, F.sha2("spans", 256).alias("base_sha256"), "spans", "blob_id")
