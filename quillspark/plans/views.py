"""The driver's tables in the shapes that the operators take, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators import pairs
from quillspark.operators.matching import BROADCAST_BYTES, match_texts, small
from quillspark.session import new_folder

#: What the phrase of each rank among a language's frequent word pairs stands for: (kind, dimension, has the language, segmentation).
RANKS = (
    ("topic", "topic_a", True, "space"), ("topic", "topic_b", True, "space"), ("political_signal", "political_actor", True, "space"), ("topic", "topic_a", True, "space"),
    ("political_signal", "government_action", True, "space"), ("political_signal", "party_politics", True, "space"), ("topic", "topic_b", False, "space"), ("topic", "topic_b", True, "character"),
)
DIMENSIONS = ", ".join(f"({n}, '{kind}', '{name}', {str(own).upper()}, '{mode}')" for n, (kind, name, own, mode) in enumerate(RANKS, 1))

START, END = "2024-01-01", "2024-01-28"
PANEL_START, PANEL_END = "1992-01-01", "1998-12-31"

#: name: (views it needs, SQL). @x is a table or view of the same list.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_articles": ((), """SELECT d.doc_id, DATE '2024-01-01' + CAST(d.doc_id % 28 AS INT) AS day, p.url,
        lower(regexp_extract(p.url, '^https?://([^/:?#]+)', 1)) AS host, d.lang, d.text
        FROM @documents d CROSS JOIN (SELECT count(*) AS n FROM @pages) c JOIN @pages p ON p.page_id = d.doc_id % c.n"""),
    "v_domains": ((), """SELECT upper(domain) AS domain, country FROM (
        SELECT DISTINCT reg AS domain, nk AS country FROM (SELECT host, reg, (length(reg) * 7 + ascii(substring(reg, 5, 1))) % 25 AS nk FROM (
          SELECT host, regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) AS reg FROM (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM @pages) h) r) k WHERE nk % 11 <> 5
        UNION ALL
        SELECT DISTINCT reg, (nk + 1) % 25 FROM (SELECT host, reg, (length(reg) * 7 + ascii(substring(reg, 5, 1))) % 25 AS nk FROM (
          SELECT host, regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) AS reg FROM (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM @pages) h) r) k WHERE nk % 9 = 4
        UNION ALL
        SELECT DISTINCT host, (nk + 3) % 25 FROM (SELECT host, reg, (length(reg) * 7 + ascii(substring(reg, 5, 1))) % 25 AS nk FROM (
          SELECT host, regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) AS reg FROM (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM @pages) h) r) k WHERE host <> reg) u"""),
    "v_panel": ((), """SELECT CAST(l.l_shipdate AS DATE) AS day, l.l_returnflag AS topic_id, CAST(s.s_nationkey AS BIGINT) AS geography, 'lines' AS source,
        count(*) AS matched_count, count(CASE WHEN l.l_linestatus = 'F' THEN 1 END) AS political_count, CAST(sum(l.l_quantity) AS DOUBLE) AS monitored_count
        FROM @lineitem l JOIN @supplier s ON s.s_suppkey = l.l_suppkey GROUP BY 1, 2, 3"""),
    "v_events": ((), """SELECT CAST(o.o_orderkey AS BIGINT) AS record_id,
        CASE o.o_orderkey % 3 WHEN 0 THEN 'wildfire' WHEN 1 THEN 'flood' ELSE 'tropical_cyclone' END AS hazard_type,
        CAST(o.o_orderdate AS DATE) AS start_day, CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 7 AS INT) AS end_day,
        CAST(c.c_nationkey AS BIGINT) AS nation_a, CAST((c.c_nationkey + 1) % 25 AS BIGINT) AS nation_b,
        CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Red' WHEN '2-HIGH' THEN 'Orange' ELSE 'Green' END AS alert_level,
        CAST(o.o_totalprice AS DOUBLE) / 100000 AS alert_score,
        CAST((o.o_orderkey * 37) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((o.o_orderkey * 53) % 1400 AS DOUBLE) / 10 - 60 AS lat
        FROM @orders o JOIN @customer c ON c.c_custkey = o.o_custkey"""),
    "v_hotspots": ((), """SELECT event_id, CAST(ts AS DATE) AS day, CAST((event_id * 37) % 3600 AS DOUBLE) / 10 - 180 AS longitude,
        CAST((event_id * 53) % 1400 AS DOUBLE) / 10 - 60 AS latitude, CAST(value AS DOUBLE) - 5 AS frp,
        CASE event_type WHEN 'error' THEN 'l' WHEN 'purchase' THEN 'h' ELSE 'n' END AS confidence, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS fire_type
        FROM @events"""),
    "v_bounds": ((), """SELECT CAST(n_nationkey AS BIGINT) AS area, CAST(-180 + 72 * (n_nationkey % 5) AS DOUBLE) AS west, CAST(-180 + 72 * (n_nationkey % 5) + 60 AS DOUBLE) AS east,
        CAST(-60 + 28 * ((n_nationkey - n_nationkey % 5) / 5) AS DOUBLE) AS south, CAST(-60 + 28 * ((n_nationkey - n_nationkey % 5) / 5) + 20 AS DOUBLE) AS north
        FROM @nation WHERE n_nationkey <> 24"""),
    # For DuckDB alone: the frequent pairs of words of letters, by language, as phrases; and what the operators make of the views.
    "v_ranked": ((), r"""SELECT lang, phrase, n FROM (SELECT lang, phrase, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, phrase) AS n FROM (
          SELECT DISTINCT doc_id, lang, ws[i] || ' ' || ws[i + 1] AS phrase FROM (SELECT doc_id, lang, ws, unnest(range(1, len(ws))) AS i
            FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM @documents))
          WHERE regexp_full_match(ws[i], '\p{L}+') AND regexp_full_match(ws[i + 1], '\p{L}+')) GROUP BY lang, phrase) WHERE n <= 8"""),
    "v_phrases": (("v_ranked",), f"""SELECT DISTINCT k.evidence_kind, k.dimension_id, r.phrase, CASE WHEN k.own THEN r.lang END AS language, k.segmentation
        FROM @v_ranked r JOIN (VALUES {DIMENSIONS}) k(n, evidence_kind, dimension_id, own, segmentation) ON k.n = r.n"""),
    # The ends of two words that white space parts: the run of letters and digits before it, and that after it.
    "v_places": (("v_articles",), r"""SELECT doc_id, i, regexp_extract(ws[i], '([\p{L}\p{N}]+)$', 1) || ' ' || regexp_extract(ws[i + 1], '^([\p{L}\p{N}]+)', 1) AS phrase
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM @v_articles))"""),
    "v_pairs": (("v_places",), "SELECT DISTINCT doc_id, phrase FROM @v_places"),
    "v_matches": (("v_articles", "v_phrases", "v_pairs"), """SELECT a.*, p.* FROM @v_articles a JOIN @v_pairs w ON w.doc_id = a.doc_id JOIN @v_phrases p ON p.phrase = w.phrase AND p.segmentation = 'space' AND (p.language IS NULL OR p.language = a.lang)
        UNION ALL SELECT a.*, p.* FROM @v_articles a JOIN @v_phrases p ON p.segmentation = 'character' AND (p.language IS NULL OR p.language = a.lang) AND contains(lower(a.text), replace(p.phrase, ' ', ''))"""),
    "v_map": (("v_domains",), "SELECT lower(domain) AS domain, min(country) AS country FROM @v_domains GROUP BY 1 HAVING count(DISTINCT country) = 1"),
    "v_urls": (("v_matches",), "SELECT dimension_id AS topic_id, day, url, host, min(lang) AS lang FROM @v_matches WHERE evidence_kind = 'topic' GROUP BY 1, 2, 3, 4"),
    "v_hosts": (("v_map",), """SELECT host, domain, country FROM (SELECT h.host, m.domain, m.country, row_number() OVER (PARTITION BY h.host ORDER BY length(m.domain) DESC, m.country) AS n
        FROM (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM @pages) h JOIN @v_map m ON h.host = m.domain OR h.host LIKE '%.' || m.domain) WHERE n = 1"""),
    "v_attributed": (("v_urls", "v_hosts"), "SELECT u.*, h.domain, h.country FROM @v_urls u JOIN @v_hosts h ON h.host = u.host"),
    "v_located": (("v_hotspots", "v_bounds"), """SELECT h.*, greatest(h.frp, 0) AS power, h.confidence = 'h' AS high, (SELECT min(b.area) FROM @v_bounds b WHERE h.longitude BETWEEN b.west AND b.east AND h.latitude BETWEEN b.south AND b.north) AS area
        FROM @v_hotspots h WHERE h.fire_type = 0 AND h.confidence <> 'l'"""),
    "v_event_rows": (("v_events", "v_panel"), """SELECT e.record_id, e.start_day, e.end_day, p.*, s.scope FROM @v_events e JOIN @v_panel p ON p.day BETWEEN e.start_day - 28 AND e.end_day + 28
        JOIN (VALUES ('affected'), ('bloc'), ('international'), ('global')) s(scope) ON s.scope = 'global' OR (s.scope = 'affected' AND p.geography IN (e.nation_a, e.nation_b))
        OR (s.scope = 'bloc' AND p.geography < 8) OR (s.scope = 'international' AND p.geography NOT IN (e.nation_a, e.nation_b))"""),
    "v_series": (("v_event_rows",), "SELECT record_id, scope, topic_id, day, start_day, end_day, sum(matched_count) AS value FROM @v_event_rows GROUP BY ALL"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")
BLOC = list(range(8))
#: Bytes of page ids and urls, as JSON, up to which they are sent to every executor.
PAGE_BYTES = 4 * BROADCAST_BYTES
#: Buckets of a language whose word pairs are counted at once.
FULLEST = 64
#: Folder and schema of the phrase catalogue of each session and folder of tables.
CATALOGUES: dict[tuple[str, str], tuple[str, StructType]] = {}


def duck(body: str) -> str:
    """DuckDB SQL of a body in which @v_x stands for a view: the views that it needs go before it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if f"@{name}" in text and name not in wanted:
                need(SQL[name][1])
                wanted.append(name)

    need(body)
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in wanted)
    if ctes:
        body = f"WITH {ctes}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
    return body.replace("@", "")


class Views:
    """The views as DataFrames, over the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str, **instead: DataFrame) -> DataFrame:
        text = SQL[name][1]
        used = {t: instead[t] if t in instead else self.table(t) for t in TABLES if f"@{t}" in text}
        for t in used:
            text = text.replace(f"@{t} ", "{" + t + "} ").replace(f"@{t})", "{" + t + "})").replace(f"@{t}", "{" + t + "}")
        return self.spark.sql(text, **used)

    @cached_property
    def articles(self) -> DataFrame:
        """A document with the url of its page. Up to PAGE_BYTES the urls go to the documents, so that no text is shuffled."""
        return self.view("v_articles", pages=small(self.table("pages").select("page_id", "url"), PAGE_BYTES))

    @cached_property
    def domains(self) -> DataFrame:
        return self.view("v_domains")

    @cached_property
    def phrases(self) -> DataFrame:
        """The phrase catalogue: made of the table documents, a few rows a language, and written as the dimension table it is, once for
        each session and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in CATALOGUES:
            rows, path = self.made_phrases(), new_folder(self.spark, "phrases")
            rows.coalesce(1).write.parquet(path)
            CATALOGUES[key] = path, rows.schema
        path, schema = CATALOGUES[key]
        return self.spark.read.schema(schema).parquet(path)

    def made_phrases(self) -> DataFrame:
        texts = self.table("documents").select("lang", F.lower("text").alias("text"))
        counted = self.most_frequent(pairs.bucket_totals(texts), lambda buckets: pairs.pair_counts(texts, buckets), len(RANKS))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("docs"), "phrase"))
        kinds = self.spark.sql(f"SELECT * FROM (VALUES {DIMENSIONS}) AS k(n, evidence_kind, dimension_id, own, segmentation)")
        ranked = counted.withColumn("n", rank).where(F.col("n") <= len(RANKS)).join(F.broadcast(kinds), "n")  # a row per rank
        return ranked.select("evidence_kind", "dimension_id", "phrase", F.when(F.col("own"), F.col("lang")).alias("language"), "segmentation").distinct()

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """df written to a new folder and read back."""
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def frequent(self, rows: DataFrame, n: int) -> DataFrame:
        """lang, phrase and docs, the number of rows (lang, phrase, bucket), of at least the n most frequent phrases of each language, ties included."""

        def of(buckets: DataFrame) -> DataFrame:  # at most BUCKETS numbers a language
            wanted = F.broadcast(buckets.select(F.col("lang").alias("__lang"), F.col("bucket").alias("__bucket")))
            met = rows.join(wanted, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("bucket") == F.col("__bucket")), "left_semi")
            return met.groupBy("lang", "phrase").agg(F.count("*").alias("docs"))

        return self.most_frequent(rows.groupBy("lang", "bucket").agg(F.count("*").alias("total")), of, n)

    def most_frequent(self, totals: DataFrame, of: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
        """lang, phrase and docs of at least the n most frequent phrases of each language, ties included. totals: lang, bucket and the
        total of its phrases; of: the phrases of such buckets.

        Half of all word pairs occur once, so that a table of all of them grows with the texts. Buckets are counted first: no phrase is
        more frequent than its bucket. The phrases of the fullest buckets are counted, and then those of every other bucket that holds
        as much as the n-th of these.
        """
        first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        totals = self.kept(totals, "pairs")
        fullest = self.kept(totals.withColumn("n", first(F.desc("total"), "bucket")).where(F.col("n") <= FULLEST).drop("n"), "pairs")
        counted = self.kept(of(fullest), "pairs")
        floors = counted.withColumn("n", first(F.desc("docs"), "phrase")).where(F.col("n") == n).select(F.col("lang").alias("__lang"), F.col("docs").alias("least"))
        others = totals.join(fullest.select("lang", "bucket"), totals["lang"].eqNullSafe(fullest["lang"]) & (totals["bucket"] == fullest["bucket"]), "left_anti")
        others = self.kept(others.join(F.broadcast(floors), F.col("lang").eqNullSafe(F.col("__lang")), "left").where("total >= coalesce(least, 0)").select("lang", "bucket"), "pairs")  # a row a language
        return counted if others.isEmpty() else counted.unionByName(of(others))

    @cached_property
    def matches(self) -> DataFrame:
        """The articles with each phrase that they hold and context_hash, that of their text: texts are searched once, whatever a query makes of it."""
        return self.kept(match_texts(self.articles.withColumn("context_hash", F.sha2("text", 256)), self.phrases), "matches")

    @cached_property
    def panel(self) -> DataFrame:
        return self.view("v_panel")

    @cached_property
    def hazard_events(self) -> DataFrame:
        return self.view("v_events").withColumn("geography_ids", F.array("nation_a", "nation_b"))

    @cached_property
    def hotspots(self) -> DataFrame:
        return self.view("v_hotspots")

    @cached_property
    def bounds(self) -> DataFrame:
        """With a place in the order of nations, and the rectangle as a polygon."""
        from quillspark.operators.hazards import rectangle

        polygon = F.array(F.array(rectangle(*(F.col(c) for c in ("west", "east", "south", "north")))))
        return self.view("v_bounds").withColumns({"place": F.col("area"), "polygons": polygon})
