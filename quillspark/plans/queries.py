"""One query per operator over the driver's tables, each with its equivalent in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.functions.web import host_of, suffixes, under
from quillspark.operators import attribution, events, hazards, ledger, matching, panel, quality, series, store
from quillspark.plans.views import BLOC, END, START, Views, duck
from quillspark.session import new_folder
from quillspark.sources import exports, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of Views under its name, with the SQL of its result."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = duck(oracle)
        return f

    return register


def trends(v: Views) -> DataFrame:
    return v.panel.withColumn("record_id", V.record_id("trend-v1", "topic_id", "geography", "day"))


TREND_ID = "sha256('trend-v1|' || topic_id || '|' || geography || '|' || day)"


def matches(v: Views) -> DataFrame:
    return v.matches.drop("context_hash")


def domain_map(v: Views) -> DataFrame:
    return attribution.unambiguous_domains(v.domains)


def attributed(v: Views) -> DataFrame:
    return attribution.attribute(matching.matched_urls(matches(v)), domain_map(v))


def countries(v: Views) -> DataFrame:
    return v.table("nation").select(F.col("n_nationkey").cast("long").alias("country"), F.col("n_name").alias("label"))


def topics(v: Views) -> DataFrame:
    return v.phrases.where("evidence_kind = 'topic'").select(F.col("dimension_id").alias("topic_id")).distinct()


def official(v: Views) -> DataFrame:
    """Of every country the first of its domains counts as official."""
    return domain_map(v).groupBy("country").agg(F.min("domain").alias("domain"))


OFFICIAL = "(SELECT country, min(domain) AS domain FROM @v_map GROUP BY 1)"


def located(v: Views) -> DataFrame:
    return hazards.locate(hazards.retained(v.hotspots), "event_id", v.bounds)


def scope_days(v: Views, of: DataFrame) -> DataFrame:
    return events.scope_days(of, v.panel, BLOC)


def market_sums(v: Views) -> DataFrame:
    return events.market_sums(v.hazard_events, v.panel, BLOC)


# Scans, sources, sinks


@query("SELECT day, topic_id, geography, matched_count FROM @v_panel WHERE day BETWEEN '1995-01-01' AND '1995-12-31' AND topic_id IN ('A', 'R') AND geography IN (1, 2, 3)")
def a01_trend_scan(v: Views) -> DataFrame:
    rows = store.scan(v.panel, "1995-01-01", "1995-12-31", any_of={"topic_id": ["A", "R"], "geography": [1, 2, 3]})
    return store.ordered(rows.select("day", "topic_id", "geography", "matched_count"), "day", "topic_id", "geography")


@query("SELECT doc_id, day, lang FROM @v_articles WHERE day BETWEEN '2024-01-03' AND '2024-01-09'")
def a02_record_scan(v: Views) -> DataFrame:
    return store.scan(v.articles, "2024-01-03", "2024-01-09").select("doc_id", "day", "lang")


@query("SELECT day, geography, CAST(sum(monitored_count) AS DOUBLE) AS country_count FROM @v_panel WHERE day >= '1997-01-01' AND geography IN (4, 5) GROUP BY 1, 2")
def a03_coverage_scan(v: Views) -> DataFrame:
    return store.scan(v.panel, "1997-01-01", any_of={"geography": [4, 5]}).groupBy("day", "geography").agg(F.sum("monitored_count").alias("country_count"))


@query("SELECT event_id, day, confidence FROM @v_hotspots WHERE day <= '2024-01-15' AND fire_type IN (0) AND confidence IN ('h', 'n')")
def a04_hazard_scan(v: Views) -> DataFrame:
    return store.scan(v.hotspots, None, "2024-01-15", any_of={"fire_type": [0], "confidence": ["h", "n"]}).select("event_id", "day", "confidence")


@query("SELECT record_id, hazard_type, start_day FROM @v_events WHERE start_day >= '1994-01-01' AND (nation_a IN (3, 7) OR nation_b IN (3, 7))")
def a05_event_scan(v: Views) -> DataFrame:
    return store.scan(v.hazard_events, "1994-01-01", day="start_day", overlap={"geography_ids": [3, 7]}).select("record_id", "hazard_type", "start_day")


@query("SELECT day, topic_id, country, url FROM @v_attributed WHERE day BETWEEN '2024-01-05' AND '2024-01-20' AND topic_id IN ('topic_a')")
def a06_matched_article_scan(v: Views) -> DataFrame:
    return store.scan(attributed(v), "2024-01-05", "2024-01-20", any_of={"topic_id": ["topic_a"]}).select("day", "topic_id", "country", "url")


@query("SELECT day, topic_id, geography, CAST(monitored_count AS DOUBLE) AS global_monitored_count, matched_count FROM @v_panel")
def a07_old_columns(v: Views) -> DataFrame:
    return store.upgraded(v.panel, store.TREND_RENAMES).select("day", "topic_id", "geography", "global_monitored_count", "matched_count")


WORD_ROWS = r"""SELECT doc_id, lang, CAST(i - 1 AS INT) AS pos, ws[i] AS ngram, array_to_string(ws[greatest(i - 5, 1):i - 1], ' ') AS pre, array_to_string(ws[i + 1:i + 5], ' ') AS post, 1 AS type
FROM (SELECT doc_id, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM @v_articles))"""
POINT_ROWS = r"""SELECT * FROM (SELECT doc_id, lang, CAST(i - 1 AS INT) AS pos, c AS ngram, coalesce(string_agg(c, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), '') AS pre,
coalesce(string_agg(c, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), '') AS post, 2 AS type
FROM (SELECT doc_id, lang, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT doc_id, lang, regexp_extract_all(text, '(?s).') AS cs FROM @v_articles))) WHERE NOT regexp_full_match(ngram, '\s')"""


@query(f"SELECT doc_id, pos, ngram, pre, post, type FROM ({WORD_ROWS} UNION ALL {POINT_ROWS})")
def a16_ngram_rows(v: Views) -> DataFrame:
    return matching.ngram_rows(v.articles, ["doc_id"]).select("doc_id", "pos", "ngram", "pre", "post", "type")


EVIDENCE_SQL = """SELECT t.topic_id, t.day, t.url, m.evidence_kind AS kind, m.dimension_id AS dimension, m.phrase, m.language
FROM (SELECT DISTINCT day, url, dimension_id AS topic_id FROM @v_matches WHERE evidence_kind = 'topic') t
JOIN (SELECT DISTINCT day, url, evidence_kind, dimension_id, phrase, language FROM @v_matches) m ON m.day = t.day AND m.url = t.url AND (m.evidence_kind <> 'topic' OR m.dimension_id = t.topic_id)"""


def evidence_matches(v: Views) -> DataFrame:
    """The context of a match is its article's text, of which the hash is enough."""
    return matching.one_per_evidence(v.matches, "context_hash")


SIGNALS = """SELECT day, url, host, bool_or(dimension_id = 'political_actor') AS political_actor, bool_or(dimension_id = 'government_action') AS government_action, bool_or(dimension_id = 'party_politics') AS party_politics FROM @v_matches GROUP BY 1, 2, 3"""

FLAGGED = f"""SELECT u.topic_id, u.day, u.url, u.country, s.political_actor, s.government_action, s.party_politics, EXISTS (SELECT 1 FROM {OFFICIAL} o WHERE o.country = u.country AND (u.host = o.domain OR u.host LIKE '%.' || o.domain)) AS official
FROM @v_attributed u JOIN ({SIGNALS}) s ON s.day = u.day AND s.url = u.url"""

LISTED_SQL = f"""SELECT topic_id, day, url, count(*) AS total, '[' || string_agg('{{"dimension":"' || dimension || '","kind":"' || kind || '"' || coalesce(',"language":"' || language || '"', '') || ',"phrase":"' || phrase || '"}}', ',' ORDER BY kind, dimension, phrase, coalesce(language, '')) || ']' AS evidence,
 coalesce(string_agg(DISTINCT phrase, ' | ' ORDER BY phrase) FILTER (WHERE kind = 'political_signal' AND dimension = 'government_action'), '') AS g, coalesce(string_agg(DISTINCT phrase, ' | ' ORDER BY phrase) FILTER (WHERE kind = 'political_signal' AND dimension = 'party_politics'), '') AS p,
 coalesce(string_agg(DISTINCT phrase, ' | ' ORDER BY phrase) FILTER (WHERE kind = 'political_signal' AND dimension = 'political_actor'), '') AS a, coalesce(string_agg(DISTINCT phrase, ' | ' ORDER BY phrase) FILTER (WHERE kind = 'topic'), '') AS topic_phrases FROM ({EVIDENCE_SQL}) GROUP BY 1, 2, 3"""


@query(f"""SELECT sha256('article-v1|' || u.topic_id || '|' || u.day || '|' || u.url) AS record_id, strftime(u.day, '%Y-%m-%d') AS date, 'articles' AS source, u.topic_id, CAST(u.country AS VARCHAR) AS geography, u.url, u.domain,
strftime(u.day, '%Y-%m-%dT06:30:00') AS published_at, CAST(NULL AS VARCHAR) AS outlet_name, CAST(NULL AS VARCHAR) AS outlet_logo, CAST(NULL AS VARCHAR) AS outlet_twitter, md5(u.url) AS title, CAST(NULL AS VARCHAR) AS image_url, CAST(NULL AS VARCHAR) AS description,
u.lang AS language, CAST(NULL AS VARCHAR) AS author, s.political_actor OR s.government_action OR s.party_politics OR s.official AS political, s.political_actor, s.government_action, s.party_politics, s.official AS official_source, e.topic_phrases AS matched_topic_phrases,
concat_ws(' | ', nullif(e.g, ''), nullif(e.p, ''), nullif(e.a, '')) AS matched_political_phrases, e.total AS match_evidence_total, false AS match_evidence_truncated, e.evidence AS match_evidence_json, '' AS collected_at, '{{"host":"' || u.host || '","lang":"' || u.lang || '"}}' AS metadata_json
FROM @v_attributed u JOIN ({FLAGGED}) s ON s.topic_id = u.topic_id AND s.day = u.day AND s.url = u.url JOIN ({LISTED_SQL}) e ON e.topic_id = u.topic_id AND e.day = u.day AND e.url = u.url""")
def a21_article_review(v: Views) -> DataFrame:
    found = evidence_matches(v)
    flags = matching.article_signals(found).drop("topics", "host")
    lists = matching.evidence_lists(found, most=None)
    rows = attribution.flag_official(attributed(v), official(v)).withColumnRenamed("official", "official_source").join(flags, ["day", "url"]).join(lists, ["topic_id", "day", "url"])
    rows = rows.withColumns(
        {
            "record_id": V.record_id("article-v1", "topic_id", "day", "url"), "date": F.col("day"), "source": F.lit("articles"), "geography": F.col("country").cast("string"), "title": F.md5("url"), "language": F.col("lang"),
            "published_at": F.col("day").cast("timestamp") + F.expr("INTERVAL 390 MINUTES"), "collected_at": F.lit(None).cast("timestamp"), "metadata": F.create_map(F.lit("lang"), "lang", F.lit("host"), "host"),
        }
    )
    return exports.review_rows(rows)


@query("""SELECT c.n_nationkey::BIGINT AS country, count(m.domain) AS mapped_domain_count, coalesce(array_to_string(list_sort(list(m.domain) FILTER (WHERE m.domain IS NOT NULL))[1:5], '|'), '') AS examples, count(m.domain) > 0 AS mapping_supported
FROM nation c LEFT JOIN @v_map m ON m.country = c.n_nationkey GROUP BY 1""")
def a22_mapping_audit_export(v: Views) -> DataFrame:
    audit = attribution.mapping_audit(countries(v), domain_map(v), countries(v))
    return audit.select("country", "mapped_domain_count", "examples", "mapping_supported")


SERVED = f"""SELECT {TREND_ID} AS record_id, day AS observation_date, source, topic_id, topic_id || '-all' AS query_id, geography, CAST(NULL AS VARCHAR) AS language, matched_count, matched_count / nullif(monitored_count, 0) AS country_attention_share, CAST(NULL AS DOUBLE) AS attention_index,
political_count + CASE WHEN geography % 2 = 1 THEN 1 ELSE 0 END AS political_count, political_count // 2 AS political_actor_count, political_count // 3 AS government_action_count, political_count // 5 AS party_politics_count, political_count // 7 AS official_source_count, CASE WHEN geography % 2 = 1 THEN 2 ELSE 1 END AS collected_at FROM @v_panel"""


def collected(v: Views) -> DataFrame:
    """Trends as they are served: those of odd markets were collected twice, the second time with one political article more."""
    part = lambda n: F.floor(F.col("political_count") / n)
    first = trends(v).withColumns(
        {
            "query_id": F.concat("topic_id", F.lit("-all")), "language": F.lit(None).cast("string"), "country_attention_share": V.ratio(F.col("matched_count"), F.col("monitored_count")), "attention_index": F.lit(None).cast("double"),
            "political_actor_count": part(2), "government_action_count": part(3), "party_politics_count": part(5), "official_source_count": part(7), "collected_at": F.lit(1),
        }
    )
    return first.unionByName(first.where("geography % 2 = 1").withColumns({"political_count": F.col("political_count") + 1, "collected_at": F.lit(2)}))


@query(f"SELECT * FROM ({SERVED}) WHERE topic_id IN ('A', 'N') AND observation_date >= '1996-01-01'")
def a26_serving_rows(v: Views) -> DataFrame:
    return exports.serving_rows(collected(v), ["A", "N"], "collected_at", "1996-01-01")


@query(f"SELECT observation_date, source, topic_id, geography, matched_count, country_attention_share, attention_index, political_count, political_actor_count, government_action_count, party_politics_count, official_source_count FROM ({SERVED}) WHERE observation_date BETWEEN '1995-03-01' AND '1996-03-31' AND topic_id IN ('A', 'R') AND geography NOT IN (0, 1) ORDER BY observation_date, topic_id, geography LIMIT 1000 OFFSET 50")
def a27_serving_window(v: Views) -> DataFrame:
    served = exports.serving_rows(collected(v), ["A", "R"], "collected_at")
    return exports.serving_window(served, "1995-03-01", "1996-03-31", ["A", "R"], exclude=[0, 1], offset=50)


# Projections, filters, scalar functions


@query("SELECT topic_id, geography, count(*) AS cells FROM @v_panel WHERE day <= '1996-06-30' AND topic_id IN ('A', 'N') GROUP BY 1, 2")
def b01_b02_range_and_membership(v: Views) -> DataFrame:
    return v.panel.where(V.in_range(F.col("day"), None, "1996-06-30") & F.col("topic_id").isin("A", "N")).groupBy("topic_id", "geography").agg(F.count("*").alias("cells"))


@query("SELECT a.lang, p.phrase, count(*) AS pairs FROM @v_articles a, @v_phrases p WHERE p.language IS NULL OR p.language = a.lang GROUP BY 1, 2")
def b03_language_predicate(v: Views) -> DataFrame:
    by_language = v.articles.groupBy("lang").agg(F.count("*").alias("n"))
    pairs = by_language.join(F.broadcast(v.phrases), T.speaks(F.col("lang"), F.col("language")))
    return pairs.groupBy("lang", "phrase").agg(F.sum("n").alias("pairs"))


@query("SELECT doc_id, evidence_kind, dimension_id, phrase FROM @v_matches")
def b04_phrase_matches(v: Views) -> DataFrame:
    return matches(v).select("doc_id", "evidence_kind", "dimension_id", "phrase")


ANCHORS = """SELECT *, unnest(CASE WHEN segmentation = 'character' THEN [u] ELSE [u, upper(u[1]) || u[2:]] END) AS anchor
FROM (SELECT *, CASE WHEN segmentation = 'character' THEN replace(phrase, ' ', '')[(length(replace(phrase, ' ', '')) - 1) // 2 + 1] ELSE string_split(phrase, ' ')[1] END AS u FROM @v_phrases)"""


@query(f"SELECT evidence_kind, dimension_id, phrase, language, anchor FROM ({ANCHORS})")
def b05_anchors(v: Views) -> DataFrame:
    return matching.with_patterns(v.phrases).select("evidence_kind", "dimension_id", "phrase", "language", F.explode("anchors").alias("anchor"))


@query("SELECT lower(trim(n_name)) AS key, count(*) AS spellings FROM (SELECT n_name FROM nation UNION ALL SELECT ' \"' || lower(n_name) || '\" ' FROM nation) GROUP BY 1 HAVING trim(key, '\" ') = key".replace("lower(trim(n_name))", "lower(trim(trim(n_name), '\"'))"))
def b06_phrase_normalisation(v: Views) -> DataFrame:
    names = v.table("nation").select(F.col("n_name").alias("phrase"), F.col("n_nationkey").alias("place"))
    both = names.unionByName(names.select(F.concat(F.lit(' "'), F.lower("phrase"), F.lit('" ')).alias("phrase"), (F.col("place") + 100).alias("place")))
    counted = both.withColumn("spelling", F.lit(1))
    kept = T.distinct_phrases(counted.drop("spelling").withColumnRenamed("place", "seq"), [], "seq")
    return kept.select(F.lower("phrase").alias("key"), (F.floor((F.col("seq") - F.col("place")) / 100) + 1).cast("long").alias("spellings"))


@query(r"""SELECT doc_id, CAST(i - 1 AS INT) AS pos, md5(array_to_string(ws[greatest(i - 5, 1):i - 1], ' ') || ' ' || ws[i] || ' ' || array_to_string(ws[i + 1:i + 5], ' ')) AS context_md5
FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM @v_articles))""")
def b07_context(v: Views) -> DataFrame:
    ngrams = matching.ngram_rows(v.articles, ["doc_id"], types=(1,))
    return ngrams.select("doc_id", "pos", F.md5(T.context(F.col("pre"), F.col("ngram"), F.col("post"), F.lit("space"))).alias("context_md5"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def b08_host(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", host_of(F.col("url")).alias("host"))


@query("SELECT h.host, m.domain FROM (SELECT DISTINCT host FROM @v_articles) h JOIN @v_map m ON h.host = m.domain OR h.host LIKE '%.' || m.domain")
def b09_suffix_matches(v: Views) -> DataFrame:
    hosts = v.articles.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    return hosts.join(domain_map(v), "domain").where(under(F.col("host"), F.col("domain"))).select("host", "domain")


NAMED = "SELECT e.*, CASE e.hazard_type WHEN 'flood' THEN 'Flood in ' || n.n_name WHEN 'wildfire' THEN 'Forest fire in ' || n.n_name ELSE 'Storm ' || e.record_id END AS name, r.n_name AS map_country FROM @v_events e JOIN nation n ON n.n_nationkey = e.nation_a JOIN nation r ON r.n_nationkey = e.nation_b"
SHOWN = "CASE hazard_type WHEN 'flood' THEN 'Flood in ' || map_country WHEN 'wildfire' THEN 'Wildfire in ' || map_country ELSE name END"


def named_events(v: Views) -> DataFrame:
    names = countries(v)
    first = names.select(F.col("country").alias("nation_a"), F.col("label").alias("country_a"))
    second = names.select(F.col("country").alias("nation_b"), F.col("label").alias("map_country"))
    rows = v.hazard_events.join(F.broadcast(first), "nation_a").join(F.broadcast(second), "nation_b")  # 25 nations
    flood, fire = F.concat(F.lit("Flood in "), "country_a"), F.concat(F.lit("Forest fire in "), "country_a")
    hazard = F.col("hazard_type")
    rows = rows.withColumn("name", F.when(hazard == "flood", flood).when(hazard == "wildfire", fire).otherwise(F.concat(F.lit("Storm "), F.col("record_id").cast("string"))))
    return rows.withColumn("display_name", events.display_name(F.col("name"), hazard, F.col("map_country")))


@query(f"SELECT record_id, alert_level FROM ({NAMED}) WHERE (contains(lower(name), 'ion_1') OR contains(lower({SHOWN}), 'ion_1') OR contains(lower(map_country), 'ion_1')) AND hazard_type IN ('flood', 'wildfire') AND alert_level IN ('Red', 'Orange') AND start_day BETWEEN '1993-01-01' AND '1997-12-31'")
def b10_event_search(v: Views) -> DataFrame:
    found = events.search(named_events(v), " ION_1 ", ["name", "display_name", "map_country"])
    return store.scan(found, "1993-01-01", "1997-12-31", day="start_day", any_of={"hazard_type": ["flood", "wildfire"], "alert_level": ["Red", "Orange"]}).select("record_id", "alert_level")


@query(f"SELECT record_id, {SHOWN} AS display_name, CASE alert_level WHEN 'Red' THEN 3 WHEN 'Orange' THEN 2 ELSE 1 END AS alert_rank FROM ({NAMED})")
def b11_b12_display_name_and_rank(v: Views) -> DataFrame:
    return named_events(v).select("record_id", "display_name", V.alert_rank(F.col("alert_level")).alias("alert_rank"))


@query(f"SELECT {TREND_ID} AS record_id, topic_id, geography, day FROM @v_panel")
def b13_record_ids(v: Views) -> DataFrame:
    return trends(v).select("record_id", "topic_id", "geography", "day")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS compact, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain FROM events")
def b14_times(v: Views) -> DataFrame:
    e = v.table("events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("a"), F.date_format("ts", "yyyyMMddHHmmss").alias("b"))
    shown = lambda c: F.date_format(V.utc_time(F.col(c)), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", shown("a").alias("compact"), shown("b").alias("plain"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 0 AND 100 THEN CAST(l_quantity AS DOUBLE) / 100 END AS share, CASE WHEN l_extendedprice >= 0 AND l_extendedprice = floor(l_extendedprice) THEN CAST(l_extendedprice AS BIGINT) END AS whole FROM lineitem")
def b15_b16_percent_and_whole(v: Views) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return v.table("lineitem").select("l_orderkey", "l_linenumber", V.share_of_percent(text("l_quantity")).alias("share"), V.whole_number(text("l_extendedprice")).alias("whole"))


@query(r"SELECT n_nationkey, regexp_replace(lower(n_name), '[^\p{L}\p{N}]', '', 'g') AS key FROM nation")
def b17_label_key(v: Views) -> DataFrame:
    return v.table("nation").select("n_nationkey", T.label_key(F.concat("n_name", F.lit(" Volume Intensity"))).alias("key"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'G' || n_nationkey WHEN n_name = 'NATION_7' OR n_nationkey = 7 THEN 'N07' ELSE 'N' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') END AS code FROM nation")
def b18_code_resolution(v: Views) -> DataFrame:
    """Every fifth country has a code of its own, one has an alias, and the others are known by name, whatever its case."""
    nations, code = v.table("nation"), lambda n: F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), n, "0"))
    known = nations.select(F.lower("n_name").alias("label"), code(3).alias("code"))
    aliases = nations.where("n_nationkey = 7").select(F.col("n_name").alias("label"), code(2).alias("code"))
    given = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("G"), F.col("n_nationkey").cast("string")))
    return attribution.country_codes(nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), given.alias("code")), known, aliases).select("id", "code")


@query("SELECT day, topic_id, geography, matched_count / nullif(monitored_count, 0) AS share, political_count / nullif(political_count, 0) AS odd FROM @v_panel")
def b19_safe_ratio(v: Views) -> DataFrame:
    return v.panel.select("day", "topic_id", "geography", V.ratio(F.col("matched_count"), F.col("monitored_count")).alias("share"), V.ratio(F.col("political_count"), F.col("political_count")).alias("odd"))


@query("SELECT day, topic_id, geography, CASE WHEN matched_count = 0 THEN 0.0 ELSE political_count / matched_count END AS political_share, political_count > 0 AS political FROM @v_panel")
def b20_political_share(v: Views) -> DataFrame:
    return v.panel.select("day", "topic_id", "geography", V.political_share(F.col("political_count"), F.col("matched_count")).alias("political_share"), (F.col("political_count") > 0).alias("political"))




@query(f"SELECT day, url, array_to_string(list_filter([CASE WHEN political_actor THEN 'political_actor' END, CASE WHEN government_action THEN 'government_action' END, CASE WHEN party_politics THEN 'party_politics' END], lambda x: x IS NOT NULL), ',') AS signals FROM ({SIGNALS})")
def b21_flag_names(v: Views) -> DataFrame:
    flags = ("political_actor", "government_action", "party_politics")
    return matching.article_signals(matches(v)).select("day", "url", T.set_flags(**{f: F.col(f) for f in flags}).alias("signals"))


@query("SELECT e.record_id, p.day, p.day - e.start_day AS relative_day, CASE WHEN p.day < e.start_day THEN 'before' WHEN p.day > e.end_day THEN 'after' ELSE 'during' END AS period FROM @v_events e JOIN (SELECT DISTINCT day FROM @v_panel) p ON p.day BETWEEN e.start_day - 28 AND e.end_day + 28")
def b22_relative_day(v: Views) -> DataFrame:
    days = v.hazard_events.select("record_id", "start_day", "end_day", F.explode(F.sequence(F.date_sub("start_day", 28), F.date_add("end_day", 28))).alias("day"))
    days = days.join(v.panel.select("day").distinct(), "day")
    return days.select("record_id", "day", V.relative_day(F.col("day"), F.col("start_day")).alias("relative_day"), V.period(F.col("day"), F.col("start_day"), F.col("end_day")).alias("period"))


@query(f"SELECT topic_id, day, url, string_agg(DISTINCT phrase, ' | ' ORDER BY phrase) AS phrases FROM ({EVIDENCE_SQL}) WHERE kind = 'topic' GROUP BY 1, 2, 3")
def b23_phrase_list(v: Views) -> DataFrame:
    found = evidence_matches(v).where("evidence_kind = 'topic'")
    return matching.evidence_lists(found).select("topic_id", "day", "url", matching.phrases_joined().alias("phrases"))


@query("SELECT c_custkey, nullif(trim(c_mktsegment), '') AS segment, CAST(c_acctbal AS DOUBLE) AS balance FROM customer")
def b24_optional_values(v: Views) -> DataFrame:
    return v.table("customer").select("c_custkey", T.optional_text(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("segment"), T.optional_number(F.col("c_acctbal").cast("string")).alias("balance"))


@query("SELECT event_id, greatest(frp, 0) AS power, confidence = 'h' AS high FROM @v_hotspots WHERE fire_type = 0 AND confidence <> 'l'")
def b25_detection_filters(v: Views) -> DataFrame:
    return hazards.retained(v.hotspots).select("event_id", "power", "high")


@query("SELECT record_id, CASE WHEN record_id % 100 = 0 THEN hazard_type || ' ' || record_id ELSE 'Event ' || record_id END AS name FROM @v_events")
def b26_name_fallback(v: Views) -> DataFrame:
    given = F.when(F.col("record_id") % 100 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Event "), F.col("record_id").cast("string")))
    return v.hazard_events.select("record_id", F.coalesce(T.optional_text(given), F.concat_ws(" ", "hazard_type", F.col("record_id").cast("string"))).alias("name"))


@query("SELECT evidence_kind, dimension_id, string_agg('\"' || phrase || '\"', ' OR ' ORDER BY coalesce(language, '') || '|' || phrase || '|' || segmentation) AS expression FROM @v_phrases GROUP BY 1, 2")
def b27_topic_expression(v: Views) -> DataFrame:
    return T.any_of(v.phrases.withColumn("seq", F.concat_ws("|", F.coalesce("language", F.lit("")), "phrase", "segmentation")), ["evidence_kind", "dimension_id"], "seq")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN n_name ELSE array_to_string(list_transform(string_split(replace(lower(n_name), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS label FROM nation")
def b28_display_label(v: Views) -> DataFrame:
    return v.table("nation").select("n_nationkey", T.display_label(F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")), F.when(F.col("n_nationkey") < 10, F.col("n_name"))).alias("label"))


@query("SELECT record_id, CAST(start_day - 14 AS DATE) AS first_day, CAST(end_day + 14 AS DATE) AS last_day FROM @v_events")
def b29_event_window(v: Views) -> DataFrame:
    return v.hazard_events.select("record_id", F.date_sub("start_day", 14).alias("first_day"), F.date_add("end_day", 14).alias("last_day"))


@query("SELECT dimension_id, phrase, language FROM @v_phrases")
def b30_parallel_lists(v: Views) -> DataFrame:
    packed = v.phrases.groupBy("dimension_id").agg(F.array_sort(F.collect_list(F.struct("language", "phrase"))).alias("x"))
    lists = packed.select("dimension_id", F.col("x.phrase").alias("p"), F.col("x.language").alias("l"))
    return lists.select("dimension_id", F.inline(F.arrays_zip(F.col("p").alias("phrase"), F.col("l").alias("language"))))


@query("SELECT day, url, count(DISTINCT phrase) AS phrases, count(*) AS total, count(*) > 2 AS truncated FROM @v_matches GROUP BY 1, 2")
def b31_array_size(v: Views) -> DataFrame:
    lists = matches(v).groupBy("day", "url").agg(F.collect_list("phrase").alias("ps"))
    return lists.select("day", "url", F.size(F.array_distinct("ps")).cast("long").alias("phrases"), F.size("ps").cast("long").alias("total"), (F.size("ps") > 2).alias("truncated"))


@query("SELECT p.dimension_id AS topic_id, l.language, CAST(g.n_nationkey AS VARCHAR) AS geography FROM (SELECT DISTINCT dimension_id FROM @v_phrases WHERE evidence_kind = 'topic') p, (SELECT DISTINCT language FROM @v_phrases WHERE language IS NOT NULL) l, nation g WHERE g.n_regionkey = 1")
def b32_query_expansion(v: Views) -> DataFrame:
    from quillspark.sources.files import expanded_queries

    languages = v.phrases.agg(F.collect_set("language").alias("topic_languages"))
    places = v.table("nation").where("n_regionkey = 1").agg(F.collect_set(F.col("n_nationkey").cast("string")).alias("topic_geographies"))
    none = F.lit(None).cast("array<string>")
    rows = topics(v).crossJoin(languages).crossJoin(places).withColumns({"query_id": F.lit("q"), "topic_terms": none, "query_terms": none, "query_languages": none, "query_geographies": none})
    return expanded_queries(rows).select("topic_id", "language", "geography")


# Joins


@query(rf"""SELECT n.doc_id, p.evidence_kind, p.dimension_id, p.phrase, n.type, n.pos FROM ({WORD_ROWS}) n
JOIN ({ANCHORS}) p ON p.anchor = n.ngram AND p.segmentation = 'space' AND (p.language IS NULL OR p.language = n.lang)
WHERE EXISTS (SELECT 1 FROM @v_places w WHERE w.doc_id = n.doc_id AND w.phrase = p.phrase AND w.i BETWEEN n.pos - 4 AND n.pos + 5)
UNION ALL SELECT n.doc_id, p.evidence_kind, p.dimension_id, p.phrase, n.type, n.pos FROM ({POINT_ROWS}) n
JOIN ({ANCHORS}) p ON p.anchor = n.ngram AND p.segmentation = 'character' AND (p.language IS NULL OR p.language = n.lang) AND contains(lower(n.pre || n.ngram || n.post), replace(p.phrase, ' ', ''))""")
def c01_anchored_matches(v: Views) -> DataFrame:
    ngrams = matching.anchored_rows(v.articles, v.phrases, ["doc_id", "lang"])
    return matching.match_ngrams(ngrams, v.phrases).select("doc_id", "evidence_kind", "dimension_id", "phrase", "type", "pos")


@query("SELECT topic_id, day, url, host, domain, country FROM @v_attributed")
def c02_longest_suffix(v: Views) -> DataFrame:
    return attributed(v).select("topic_id", "day", "url", "host", "domain", "country")


@query(f"SELECT u.topic_id, u.day, u.url, u.country, EXISTS (SELECT 1 FROM {OFFICIAL} o WHERE o.country = u.country AND (u.host = o.domain OR u.host LIKE '%.' || o.domain)) AS official FROM @v_attributed u")
def c03_official_source(v: Views) -> DataFrame:
    return attribution.flag_official(attributed(v), official(v)).select("topic_id", "day", "url", "country", "official")


@query("SELECT u.topic_id, u.day, u.url, coalesce(c.title, '') AS title, coalesce(c.domain, u.host) AS domain FROM @v_urls u LEFT JOIN (SELECT url, max_by(title, page_id) AS title, max_by(domain, page_id) AS domain FROM (SELECT url, page_id, md5(html) AS title, CASE WHEN page_id % 3 > 0 THEN 'outlet' || page_id % 7 END AS domain FROM pages) GROUP BY 1) c ON c.url = u.url")
def c04_newest_catalogue(v: Views) -> DataFrame:
    outlet = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("outlet"), (F.col("page_id") % 7).cast("string")))
    catalogue = v.table("pages").select("url", F.col("page_id").alias("date"), F.md5("html").alias("title"), outlet.alias("domain"), F.lit(None).cast("string").alias("lang"))
    rows = attribution.newest_catalogue(matching.matched_urls(matches(v)), catalogue)
    return rows.select("topic_id", "day", "url", F.coalesce("title", F.lit("")).alias("title"), "domain")


@query(f"SELECT topic_id, day, url, kind, dimension, phrase, language FROM ({EVIDENCE_SQL})")
def c05_evidence(v: Views) -> DataFrame:
    lists = matching.evidence_lists(evidence_matches(v), most=None)
    return lists.select("topic_id", "day", "url", F.inline("evidence"))


SPINE = f"SELECT t.topic_id, c.n_nationkey::BIGINT AS country, CAST(d AS DATE) AS day FROM (SELECT DISTINCT dimension_id AS topic_id FROM @v_phrases WHERE evidence_kind = 'topic') t, nation c, generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) g(d)"


@query(f"SELECT s.topic_id, s.country, s.day, coalesce(m.matched_count, 0) AS matched_count FROM ({SPINE}) s LEFT JOIN (SELECT topic_id, day, country, count(DISTINCT url) AS matched_count FROM @v_attributed GROUP BY 1, 2, 3) m USING (topic_id, country, day)")
def c06_dense_panel(v: Views) -> DataFrame:
    spine = panel.spine(topics(v), countries(v).select("country"), START, END)
    out = panel.dense(spine, panel.url_counts(attributed(v)), ["topic_id", "day", "country"], {"matched_count": 0})
    return out.select("topic_id", "country", "day", "matched_count")


@query("SELECT u.topic_id, u.day, u.url, n.n_name AS label FROM @v_attributed u JOIN nation n ON n.n_nationkey = u.country WHERE n.n_regionkey IN (1, 3)")
def c07_requested_countries(v: Views) -> DataFrame:
    wanted = v.table("nation").where("n_regionkey IN (1, 3)").select(F.col("n_nationkey").cast("long").alias("country"), F.col("n_name").alias("label"))
    return attributed(v).join(F.broadcast(wanted), "country").select("topic_id", "day", "url", "label")  # of 25 nations


@query("""SELECT p.day, p.topic_id, p.geography, coalesce(c.n, p.monitored_count) AS monitored_count, p.matched_count / nullif(coalesce(c.n, p.monitored_count), 0) AS country_share
FROM @v_panel p LEFT JOIN (SELECT day, geography, CAST(sum(monitored_count) AS DOUBLE) AS n FROM @v_panel WHERE geography < 20 GROUP BY 1, 2) c ON c.day = p.day AND c.geography = p.geography""")
def c08_coverage_join(v: Views) -> DataFrame:
    with_language = v.panel.withColumn("language", F.lit(None).cast("string"))
    cover = with_language.where("geography < 20").groupBy("source", "geography", "language", "day").agg(F.sum("monitored_count").alias("country_count")).withColumn("global_count", F.lit(None).cast("double"))
    return panel.with_coverage(with_language, cover).select("day", "topic_id", "geography", "monitored_count", "country_share")


BOTH = "(SELECT 'left' AS source, day, topic_id, geography, matched_count FROM @v_panel UNION ALL SELECT 'right', day, topic_id, geography, political_count FROM @v_panel WHERE day >= '1993-06-01')"


def two_sources(v: Views) -> DataFrame:
    a = v.panel.select(F.lit("left").alias("source"), "day", "topic_id", "geography", "matched_count")
    b = v.panel.where("day >= '1993-06-01'").select(F.lit("right").alias("source"), "day", "topic_id", "geography", F.col("political_count").alias("matched_count"))
    return a.unionByName(b).withColumns({"country_share": F.lit(None).cast("double"), "attention_index": F.lit(None).cast("double")})


@query(f"""SELECT a.topic_id, a.geography, count(*) AS paired_days, round(covar_pop(a.matched_count, b.matched_count) / nullif(stddev_pop(a.matched_count) * stddev_pop(b.matched_count), 0), 6) AS correlation,
round(avg(a.matched_count), 9) AS left_mean, round(avg(b.matched_count), 9) AS right_mean, count(*) FILTER (WHERE a.matched_count = 0) AS left_zero_days, count(*) FILTER (WHERE b.matched_count = 0) AS right_zero_days
FROM (SELECT * FROM {BOTH} WHERE source = 'left') a JOIN (SELECT * FROM {BOTH} WHERE source = 'right') b USING (topic_id, geography, day) GROUP BY 1, 2""")
def c09_d16_source_comparison(v: Views) -> DataFrame:
    out = series.compare_sources(two_sources(v), "left", "right", "matched_count", "matched_count")
    return out.select("topic_id", "geography", "paired_days", F.round("correlation", 6).alias("correlation"), F.round("left_mean", 9).alias("left_mean"), F.round("right_mean", 9).alias("right_mean"), "left_zero_days", "right_zero_days")


@query("SELECT event_id, area FROM @v_located")
def c10_point_in_polygon(v: Views) -> DataFrame:
    return located(v).select("event_id", "area")


@query("SELECT e.record_id, n.n_name AS country FROM @v_events e LEFT JOIN @v_bounds b ON e.lon BETWEEN b.west AND b.east AND e.lat BETWEEN b.south AND b.north LEFT JOIN nation n ON n.n_nationkey = b.area")
def c11_event_country(v: Views) -> DataFrame:
    points = v.hazard_events.select("record_id", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    found = hazards.locate(points, "record_id", v.bounds)
    return found.join(F.broadcast(countries(v)), F.col("area") == F.col("country"), "left").select("record_id", F.col("label").alias("country"))  # 25 nations


@query("SELECT e.record_id, CASE WHEN b.area = e.nation_a OR b.area = e.nation_b THEN b.area END AS region FROM @v_events e LEFT JOIN @v_bounds b ON e.lon BETWEEN b.west AND b.east AND e.lat BETWEEN b.south AND b.north")
def c12_event_region(v: Views) -> DataFrame:
    points = v.hazard_events.select("record_id", "geography_ids", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    found = hazards.locate(points, "record_id", v.bounds, size=2.0)
    return found.select("record_id", F.when(F.array_contains("geography_ids", F.col("area")), F.col("area")).alias("region"))


@query("SELECT record_id, array_to_string(list_sort(list_filter([nation_a, nation_b], lambda x: x < 20)), ',') AS geography_ids, array_to_string(list_sort(list_filter([nation_a, nation_b], lambda x: x >= 20)), ',') AS unmatched FROM @v_events")
def c13_affected_countries(v: Views) -> DataFrame:
    codes = countries(v).where("country < 20").select(F.col("country").alias("code"), "country")
    out = hazards.affected(v.hazard_events.select("record_id", F.col("geography_ids").alias("codes")), codes)
    return out.select("record_id", F.array_join("geography_ids", ",").alias("geography_ids"), F.array_join("unmatched", ",").alias("unmatched"))


@query("SELECT record_id, scope, count(*) AS rows, sum(matched_count)::BIGINT AS matches FROM @v_event_rows GROUP BY 1, 2")
def c14_event_windows(v: Views) -> DataFrame:
    return events.window_totals(v.hazard_events, v.panel, BLOC)


@query("SELECT label, string_agg(other, '|' ORDER BY n) AS suggestions FROM (SELECT a.n_name AS label, b.n_name AS other, row_number() OVER (PARTITION BY a.n_name ORDER BY levenshtein(a.n_name, b.n_name), b.n_name) AS n FROM nation a, nation b WHERE b.n_nationkey % 2 = 0) WHERE n <= 3 GROUP BY 1")
def c15_label_suggestions(v: Views) -> DataFrame:
    out = attribution.suggestions(countries(v), countries(v).where("country % 2 = 0"))
    return out.select("label", F.array_join("suggestions", "|").alias("suggestions"))


DAYS = "(SELECT area, day, count(*) AS detections, sum(power) AS power_sum, max(power) AS power_max, count(*) FILTER (WHERE high) AS high_confidence FROM @v_located WHERE area IS NOT NULL GROUP BY 1, 2)"


@query(f"SELECT d.day, n.n_nationkey::BIGINT AS area, CASE WHEN n.n_nationkey <> 24 THEN coalesce(x.detections, 0) END AS detections, CASE WHEN n.n_nationkey <> 24 THEN round(coalesce(x.power_sum, 0), 6) END AS power_sum FROM (SELECT DISTINCT day FROM @v_hotspots) d CROSS JOIN nation n LEFT JOIN {DAYS} x ON x.day = d.day AND x.area = n.n_nationkey")
def c16_hazard_spine(v: Views) -> DataFrame:
    areas = countries(v).select(F.col("country").alias("area"), (F.col("country") != 24).alias("supported"))
    out = hazards.hazard_panel(v.hotspots.select("day").distinct(), areas, hazards.country_days(located(v)))
    return out.select("day", "area", "detections", F.round("power_sum", 6).alias("power_sum"))


WINDOWS = "SELECT c_custkey AS query_id, CAST(d AS DATE) AS start_day, least(DATE '1996-12-31', CAST(d AS DATE) + 30) AS end_day, sha256('window-v1|' || c_custkey || '|' || CAST(d AS DATE) || '|' || least(DATE '1996-12-31', CAST(d AS DATE) + 30)) AS window_id FROM customer, generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 31 DAY) g(d)"
STATES = "SELECT w.window_id, max_by(CASE o.o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'pending' END, o.o_orderkey) AS status, count(*) AS attempts FROM w JOIN orders o ON o.o_custkey = w.query_id AND o.o_orderdate BETWEEN w.start_day AND w.end_day GROUP BY 1"


YEAR = ("1996-01-01", "1996-12-31", 31)
WINDOW = ("query_id", "start_day")


def ledger_queries(v: Views) -> DataFrame:
    return v.table("customer").select(F.col("c_custkey").alias("query_id"))


def planned(v: Views) -> DataFrame:
    return ledger.windows(ledger_queries(v), *YEAR)


def window_states(v: Views) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    attempts = v.table("orders").select(F.col("o_custkey").alias("query_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("ts"), status.alias("status"))
    return ledger.window_states(attempts, ledger_queries(v), *YEAR)


@query(f"WITH w AS ({WINDOWS}), s AS ({STATES}) SELECT w.window_id, coalesce(s.status, 'pending') AS status FROM w LEFT JOIN s USING (window_id) WHERE coalesce(s.status, 'pending') <> 'success'")
def c17_unfinished_work(v: Views) -> DataFrame:
    left = ledger.unfinished(planned(v).select(*WINDOW), window_states(v), WINDOW)
    return ledger.with_window_id(left, ["query_id"], *YEAR[1:]).select("window_id", "status")


@query("SELECT u.topic_id, u.day, u.country, count(DISTINCT u.url) AS matched_count, any_value(m.n) AS monitored_count FROM @v_attributed u JOIN (SELECT a.day, h.country, count(DISTINCT a.url) AS n FROM @v_articles a JOIN @v_hosts h ON h.host = a.host GROUP BY 1, 2) m ON m.day = u.day AND m.country = u.country GROUP BY 1, 2, 3")
def c18_d05_denominator(v: Views) -> DataFrame:
    monitored = panel.monitored_counts(attribution.attribute(v.articles.select("day", "url", "host"), domain_map(v)))
    return panel.url_counts(attributed(v)).join(monitored, ["day", "country"], "left").select("topic_id", "day", "country", "matched_count", "monitored_count")


# Aggregations


@query("SELECT day, lang, host, count(*) AS articles FROM @v_articles GROUP BY 1, 2, 3")
def d01_daily_counts(v: Views) -> DataFrame:
    records = v.articles.withColumns({"record_id": V.record_id("article", "doc_id"), "arrival": F.col("doc_id")})
    return series.daily_counts(records, ["lang", "host"])


@query("SELECT topic_id, day, country, count(DISTINCT url) AS matched_count FROM @v_attributed GROUP BY 1, 2, 3")
def d02_distinct_urls(v: Views) -> DataFrame:
    return panel.url_counts(attributed(v))


@query("SELECT topic_id, day, url, host, lang FROM @v_urls")
def d03_matched_urls(v: Views) -> DataFrame:
    return matching.matched_urls(matches(v))


@query("""SELECT topic_id, day, country, '[' || string_agg('{"language":"' || lang || '","count":' || n || '}', ',' ORDER BY lang) || ']' AS language_counts_json FROM (SELECT topic_id, day, country, lang, count(DISTINCT url) AS n FROM @v_attributed GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def d04_language_breakdown(v: Views) -> DataFrame:
    return panel.language_breakdown(attributed(v))


@query("SELECT u.topic_id, count(DISTINCT u.url) AS total_matched_urls, count(DISTINCT a.url) AS attributed_matched_urls, count(DISTINCT a.url) / count(DISTINCT u.url) AS attribution_rate FROM @v_urls u LEFT JOIN @v_attributed a ON a.topic_id = u.topic_id AND a.url = u.url GROUP BY 1")
def d06_mapping_stats(v: Views) -> DataFrame:
    return panel.mapping_stats(matching.matched_urls(matches(v)), attributed(v))


@query("SELECT domain, country FROM @v_map")
def d07_unambiguous_domains(v: Views) -> DataFrame:
    return domain_map(v)


@query("SELECT n.n_nationkey::BIGINT AS country, count(m.domain) AS mapped_domain_count FROM nation n LEFT JOIN @v_map m ON m.country = n.n_nationkey GROUP BY 1")
def d08_mapped_domain_count(v: Views) -> DataFrame:
    return attribution.mapped_counts(countries(v).select("country"), domain_map(v))


@query("SELECT day, url, host, coalesce(string_agg(DISTINCT dimension_id, ',' ORDER BY dimension_id) FILTER (WHERE evidence_kind = 'topic'), '') AS topics, bool_or(dimension_id = 'political_actor') AS political_actor, bool_or(dimension_id = 'government_action') AS government_action, bool_or(dimension_id = 'party_politics') AS party_politics FROM @v_matches GROUP BY 1, 2, 3")
def d09_article_signals(v: Views) -> DataFrame:
    return matching.article_signals(matches(v)).withColumn("topics", F.array_join("topics", ","))




@query(f"""SELECT topic_id, day, country, count(*) AS matched_count, count(*) FILTER (WHERE political_actor OR government_action OR party_politics OR official) AS political_count, count(*) FILTER (WHERE political_actor) AS political_actor_count,
count(*) FILTER (WHERE government_action) AS government_action_count, count(*) FILTER (WHERE party_politics) AS party_politics_count, count(*) FILTER (WHERE official) AS official_count, count(*) FILTER (WHERE political_actor OR government_action OR party_politics OR official) / count(*) AS political_share FROM ({FLAGGED}) GROUP BY 1, 2, 3""")
def d10_signal_counts(v: Views) -> DataFrame:
    flags = matching.article_signals(matches(v)).drop("topics", "host")
    return panel.signal_counts(attribution.flag_official(attributed(v), official(v)).join(flags, ["day", "url"]))


@query(f"SELECT topic_id, day, url, count(*) AS evidence_total, count(*) > 2 AS truncated, array_to_string(list(phrase ORDER BY kind, dimension, phrase, language)[1:2], ',') AS first_phrases FROM ({EVIDENCE_SQL}) GROUP BY 1, 2, 3")
def d11_evidence_list(v: Views) -> DataFrame:
    lists = matching.evidence_lists(evidence_matches(v), most=2)
    return lists.select("topic_id", "day", "url", "evidence_total", "truncated", F.array_join("evidence.phrase", ",").alias("first_phrases"))


@query("""SELECT n.n_nationkey::BIGINT AS country, n.n_name AS label, count(m.domain) AS mapped_domain_count, any_value(s.suggestions) AS suggestions FROM nation n LEFT JOIN @v_map m ON m.country = n.n_nationkey
JOIN (SELECT label, string_agg(other, '|' ORDER BY k) AS suggestions FROM (SELECT a.n_name AS label, b.n_name AS other, row_number() OVER (PARTITION BY a.n_name ORDER BY levenshtein(a.n_name, b.n_name), b.n_name) AS k FROM nation a, nation b) WHERE k <= 3 GROUP BY 1) s ON s.label = n.n_name GROUP BY 1, 2""")
def d12_country_audit(v: Views) -> DataFrame:
    return attribution.mapping_audit(countries(v), domain_map(v), countries(v)).select("country", "label", "mapped_domain_count", "suggestions")


@query("SELECT topic_id, day, country, url FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, day, country ORDER BY sha256(url), url) AS n FROM @v_attributed) WHERE n <= 2")
def d13_article_sample(v: Views) -> DataFrame:
    return matching.sample_per_group(attributed(v), ["topic_id", "day", "country"], 2).select("topic_id", "day", "country", "url")


@query(f"SELECT area, day, detections, round(power_sum, 6) AS power_sum, power_max, round(power_sum / detections, 6) AS power_mean, high_confidence FROM {DAYS}")
def d14_fire_country_days(v: Views) -> DataFrame:
    out = hazards.country_days(located(v))
    return out.withColumns({"power_sum": F.round("power_sum", 6), "power_mean": F.round("power_mean", 6)})


@query("SELECT CASE WHEN fire_type <> 0 THEN 'non_vegetation' WHEN confidence = 'l' THEN 'low_confidence' ELSE 'retained' END AS fate, count(*) AS rows FROM @v_hotspots GROUP BY 1")
def d15_row_fates(v: Views) -> DataFrame:
    return v.hotspots.groupBy(hazards.row_fate(F.col("fire_type"), F.col("confidence")).alias("fate")).agg(F.count("*").alias("rows"))


@query("SELECT source, topic_id, count(*) AS rows, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days, count(DISTINCT geography) AS geographies FROM @v_panel GROUP BY GROUPING SETS ((source), (topic_id), ())")
def d17_d19_coverage_summary(v: Views) -> DataFrame:
    return series.coverage_summary(v.panel)


@query("SELECT topic_id, geography, min(day) AS start_day, max(day) AS end_day, count(*) AS days FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY topic_id, geography ORDER BY day) AS INT) AS g FROM (SELECT DISTINCT topic_id, geography, day FROM @v_panel)) GROUP BY topic_id, geography, g")
def d18_e05_islands(v: Views) -> DataFrame:
    return series.islands(v.panel, ["topic_id", "geography"])


@query("SELECT hazard_type, alert_level, count(*) AS events, count(DISTINCT nation_a) AS countries FROM @v_events GROUP BY 1, 2")
def d20_event_counts(v: Views) -> DataFrame:
    return v.hazard_events.groupBy("hazard_type", "alert_level").agg(F.count("*").alias("events"), F.count_distinct("nation_a").alias("countries"))


@query("SELECT record_id, scope, topic_id, day, value::BIGINT AS value, day - start_day AS relative_day FROM @v_series")
def d21_event_series(v: Views) -> DataFrame:
    return events.series_of_windows(v.hazard_events, v.kept(v.panel, "panel"), BLOC)


@query("SELECT record_id, scope, topic_id, period, round(avg(m), 6) AS mean_matched, round(avg(p), 6) AS mean_political, count(*) AS days FROM (SELECT record_id, scope, topic_id, day, CASE WHEN day < start_day THEN 'before' WHEN day > end_day THEN 'after' ELSE 'during' END AS period, sum(matched_count) AS m, sum(political_count) AS p FROM @v_event_rows GROUP BY ALL) GROUP BY 1, 2, 3, 4")
def d22_phase_means(v: Views) -> DataFrame:
    means = lambda e: events.event_phase_means(scope_days(v, e)).withColumns({c: F.round(c, 6) for c in ("mean_matched", "mean_political")})
    return events.once_per_window(v.hazard_events, means)


@query("SELECT record_id, scope, sum(matched_count)::BIGINT AS matches, sum(political_count)::BIGINT AS political, count(DISTINCT day) AS observed_days, count(DISTINCT geography) AS markets, round(100 * sum(political_count) / sum(matched_count), 6) AS political_percent FROM @v_event_rows GROUP BY 1, 2")
def d23_event_totals(v: Views) -> DataFrame:
    totals = lambda e: events.event_totals(scope_days(v, e), events.market_sums(e, v.panel, BLOC)).withColumn("political_percent", F.round("political_percent", 6))
    return events.once_per_window(v.hazard_events, totals)


@query("SELECT record_id, scope, geography, matches::BIGINT AS matches, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY record_id, scope ORDER BY matches DESC, geography) AS n FROM (SELECT record_id, scope, geography, sum(matched_count) AS matches FROM @v_event_rows GROUP BY 1, 2, 3)) WHERE n <= 8")
def d24_top_markets(v: Views) -> DataFrame:
    return events.event_top_markets(market_sums(v))


PAIRS = "SELECT record_id, scope, topic_id, list(value::DOUBLE ORDER BY day) FILTER (WHERE day BETWEEN start_day - 7 AND start_day - 1) AS before, list(value::DOUBLE ORDER BY day) FILTER (WHERE day BETWEEN end_day + 1 AND end_day + 7) AS after FROM @v_series GROUP BY 1, 2, 3"


@query(f"SELECT record_id, scope, topic_id, len(coalesce(before, [])) AS before_days, len(coalesce(after, [])) AS after_days, len(coalesce(before, [])) = 7 AND len(coalesce(after, [])) = 7 AS testable FROM ({PAIRS}) WHERE len(coalesce(before, [])) + len(coalesce(after, [])) > 0")
def d25_before_after(v: Views) -> DataFrame:
    sides = lambda e: events.event_before_after(e, v.panel, BLOC).select("record_id", "scope", "topic_id", F.size("before").cast("long").alias("before_days"), F.size("after").cast("long").alias("after_days"), "testable")
    return events.once_per_window(v.hazard_events, sides)


@query(f"""WITH m AS (SELECT i AS id FROM range(16384) r(i) WHERE bit_count(i) = 7),
p AS (SELECT record_id, scope, topic_id, before || after AS pooled, list_sum(before) / 7 AS before_mean, list_sum(after) / 7 AS after_mean, list_sum(before) + list_sum(after) AS total FROM ({PAIRS}) WHERE len(before) = 7 AND len(after) = 7)
SELECT record_id, scope, topic_id, round(after_mean - before_mean, 9) AS difference, count(*) FILTER (WHERE (total - c) / 7 - c / 7 >= after_mean - before_mean - 1e-12) AS extreme, count(*) AS permutations, 'exact' AS method
FROM (SELECT p.*, list_sum(list_transform(range(14), lambda i: CASE WHEN (m.id >> i) & 1 = 1 THEN pooled[i + 1] ELSE 0 END)) AS c FROM p, m) GROUP BY record_id, scope, topic_id, before_mean, after_mean""")
def d26_permutation_test(v: Views) -> DataFrame:
    test = lambda e: events.increase_test(events.event_before_after(e, v.panel, BLOC).where("testable"))
    out = events.once_per_window(v.hazard_events, test)
    return out.select("record_id", "scope", "topic_id", F.round("difference", 9).alias("difference"), "extreme", "permutations", "method")


LONG_PAIRS = PAIRS.replace("start_day - 7", "start_day - 14").replace("end_day + 7", "end_day + 14")


@query(f"""WITH o AS (SELECT d, p, row_number() OVER (PARTITION BY d ORDER BY sha256(d || '|' || p)) AS n FROM range(10000) a(d), range(28) b(p)),
draws AS (SELECT d, CAST(list(CASE WHEN n <= 14 THEN 1.0 ELSE 0.0 END ORDER BY p) AS DOUBLE[28]) AS chosen FROM o GROUP BY d),
p AS (SELECT record_id, scope, topic_id, CAST(before || after AS DOUBLE[28]) AS pooled, list_sum(before) / 14 AS before_mean, list_sum(after) / 14 AS after_mean, list_sum(before) + list_sum(after) AS total FROM ({LONG_PAIRS}) WHERE len(before) = 14 AND len(after) = 14)
SELECT record_id, scope, topic_id, round(after_mean - before_mean, 9) AS difference, count(*) FILTER (WHERE (total - c) / 14 - c / 14 >= after_mean - before_mean - 1e-12) AS extreme, count(*) AS permutations, 'monte_carlo' AS method
FROM (SELECT p.*, array_inner_product(p.pooled, draws.chosen) AS c FROM p, draws) GROUP BY record_id, scope, topic_id, before_mean, after_mean""")
def d26_sampled_test(v: Views) -> DataFrame:
    """14 days on a side have 40 million splits: the test draws."""
    test = lambda e: events.increase_test(events.event_before_after(e, v.panel, BLOC, days=14).where("testable"))
    out = events.once_per_window(v.hazard_events, test)
    return out.select("record_id", "scope", "topic_id", F.round("difference", 9).alias("difference"), "extreme", "permutations", "method")


@query(f"WITH w AS ({WINDOWS}), s AS ({STATES}) SELECT query_id % 10 AS run_id, count(*) AS windows, count(*) FILTER (WHERE st = 'success') AS success, count(*) FILTER (WHERE st = 'failed') AS failed, count(*) FILTER (WHERE st = 'pending') AS pending, bool_and(st = 'success') AS complete, count(DISTINCT query_id) AS queries FROM (SELECT w.query_id, coalesce(s.status, 'pending') AS st FROM w LEFT JOIN s USING (window_id)) GROUP BY 1")
def d27_run_summary(v: Views) -> DataFrame:
    rows = planned(v).select(*WINDOW).join(window_states(v), list(WINDOW), "left").withColumns({"status": F.coalesce("status", F.lit("pending")), "run_id": F.col("query_id") % 10})
    return ledger.run_summary(rows, ["run_id"]).drop("split")


@query("SELECT CAST(floor(lon / 10) AS BIGINT) AS cell_lon, CAST(floor(lat / 10) AS BIGINT) AS cell_lat, count(*) AS events, min(record_id) AS anchor FROM @v_events GROUP BY 1, 2")
def d28_e06_map_clusters(v: Views) -> DataFrame:
    return hazards.clusters(v.hazard_events, 10.0)


# Windows, sorts, sets


@query("SELECT day, url, evidence_kind, dimension_id, phrase, language, min(sha256(text)) AS context FROM @v_matches GROUP BY 1, 2, 3, 4, 5, 6")
def e01_one_per_evidence(v: Views) -> DataFrame:
    return evidence_matches(v).select("day", "url", "evidence_kind", "dimension_id", "phrase", "language", F.col("context_hash").alias("context"))


@query("SELECT host, domain, country FROM @v_hosts")
def e02_longest_match(v: Views) -> DataFrame:
    return attribution.attribute(v.table("pages").select(host_of(F.col("url")).alias("host")).distinct(), domain_map(v))


@query("""SELECT topic_id, geography, count(*) AS days, median(gap) AS median_gap, CASE WHEN count(*) = 1 THEN 'single_point' WHEN median(gap) = 1 THEN 'daily' WHEN median(gap) BETWEEN 6 AND 8 THEN 'weekly' WHEN median(gap) BETWEEN 27 AND 32 THEN 'monthly' ELSE 'irregular' END AS resolution
FROM (SELECT *, day - lag(day) OVER (PARTITION BY topic_id, geography ORDER BY day) AS gap FROM (SELECT DISTINCT topic_id, geography, day FROM @v_panel)) GROUP BY 1, 2""")
def e03_resolution(v: Views) -> DataFrame:
    return series.spacing(v.panel, ["topic_id", "geography"])


@query("SELECT o_custkey, max(o_orderkey) AS last_order, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def e04_last_per_key(v: Views) -> DataFrame:
    rows = v.table("orders").select("o_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"))
    return series.last_per_key(rows, ["o_custkey"], "last_order")


@query("SELECT day, topic_id, geography, matched_count FROM @v_panel ORDER BY 1, 2, 3")
def f01_ordered_output(v: Views) -> DataFrame:
    return store.ordered(v.panel, "day", "topic_id", "geography").select("day", "topic_id", "geography", "matched_count")


@query("SELECT record_id, alert_level, alert_score FROM @v_events ORDER BY CASE alert_level WHEN 'Red' THEN 3 WHEN 'Orange' THEN 2 ELSE 1 END DESC, alert_score DESC, record_id LIMIT 4")
def f02_priority_events(v: Views) -> DataFrame:
    return events.priority(v.hazard_events).select("record_id", "alert_level", "alert_score")


@query("SELECT country, domain FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY domain) AS n FROM @v_map) WHERE n <= 5")
def f03_top_per_group(v: Views) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("country").orderBy("domain"))  # Spark keeps five a country and task before the shuffle
    return domain_map(v).withColumn("n", rank).where("n <= 5").select("country", "domain")


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS seen FROM events")
def f04_newest_first(v: Views) -> DataFrame:
    e = v.table("events").select("event_id", F.when(F.col("event_type") != "view", F.col("ts").cast("timestamp")).alias("published_at"), F.to_date("ts").alias("day"))
    seen = F.coalesce("published_at", F.col("day").cast("timestamp"))
    return e.orderBy(seen.desc(), "event_id").select("event_id", F.date_format(seen, "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query(f"SELECT domain, country, 'official' AS origin FROM {OFFICIAL} UNION ALL SELECT domain, country, 'mapped' FROM @v_map")
def g01_union_all(v: Views) -> DataFrame:
    tagged = lambda df, name: df.select("domain", "country", F.lit(name).alias("origin"))
    return tagged(official(v), "official").unionByName(tagged(domain_map(v), "mapped"))


@query("SELECT DISTINCT dimension_id, lang FROM @v_matches")
def g02_distinct(v: Views) -> DataFrame:
    return matches(v).select("dimension_id", "lang").distinct()


@query("SELECT day FROM @v_panel WHERE topic_id = 'A' INTERSECT SELECT day FROM @v_panel WHERE topic_id = 'N'")
def g03_intersection(v: Views) -> DataFrame:
    return v.panel.where("topic_id = 'A'").select("day").intersect(v.panel.where("topic_id = 'N'").select("day"))


@query("SELECT day FROM @v_panel WHERE topic_id = 'N' EXCEPT SELECT day FROM @v_panel WHERE topic_id = 'A'")
def g04_difference(v: Views) -> DataFrame:
    return store.unknown_ids(v.panel.where("topic_id = 'N'"), v.panel.where("topic_id = 'A'"), "day")


@query("SELECT record_id, nation_a < 5 OR nation_b < 5 AS overlaps FROM @v_events")
def g05_overlap(v: Views) -> DataFrame:
    return v.hazard_events.select("record_id", F.arrays_overlap("geography_ids", F.array(*(F.lit(i).cast("long") for i in range(5)))).alias("overlaps"))


# Upserts and merges: batch 1 is all rows, batch 2 those of odd markets with other measures


@query(f"SELECT {TREND_ID} AS record_id, CASE WHEN geography % 2 = 1 THEN matched_count + 100 ELSE matched_count END AS matched_count FROM @v_panel")
def h01_upsert(v: Views) -> DataFrame:
    old = trends(v).select("record_id", "geography", "matched_count")
    new = old.where("geography % 2 = 1").withColumn("matched_count", F.col("matched_count") + 100)
    return store.upsert(old, new).select("record_id", "matched_count")


@query(f"SELECT {TREND_ID} AS record_id, topic_id, CASE WHEN geography % 2 = 1 THEN matched_count + 5 ELSE matched_count END AS matched_count, CAST(monitored_count AS DOUBLE) AS monitored_count, CASE WHEN geography % 2 = 1 THEN 2 ELSE 1 END AS collected_at, CASE WHEN geography % 2 = 1 THEN 'a=1,b=2,c=3' ELSE 'a=1,b=1' END AS meta, true AS identity_ok FROM @v_panel")
def h02_field_merge(v: Views) -> DataFrame:
    m = lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    old = trends(v).select("record_id", "topic_id", "geography", "matched_count", "monitored_count", F.lit(1).alias("collected_at"), m("a", 1, "b", 1).alias("meta"))
    new = old.where("geography % 2 = 1").withColumns({"matched_count": F.col("matched_count") + 5, "monitored_count": F.lit(None).cast("double"), "collected_at": F.lit(2), "meta": m("b", 2, "c", 3)})
    out = store.merge_fields(old, new, ["topic_id"], ["matched_count", "monitored_count"], "collected_at", ["meta"]).drop("was")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumn("meta", shown)


@query("SELECT record_id, CASE WHEN record_id % 100 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN record_id % 100 = 0 THEN 'new' WHEN record_id % 150 = 0 THEN 'new' ELSE 'old' END AS origin FROM @v_events")
def h03_versioned_upsert(v: Views) -> DataFrame:
    old = v.hazard_events.select("record_id", F.lit(1).alias("version"), F.lit(1).alias("seq"), F.lit("old").alias("origin"))
    newer = old.where("record_id % 100 = 0").withColumns({"version": F.lit(2), "origin": F.lit("new")})
    same = old.where("record_id % 150 = 0 AND record_id % 100 <> 0").withColumn("origin", F.lit("new"))
    later = same.withColumns({"seq": F.lit(2), "origin": F.lit("later")})
    return store.upsert_versions(old, newer.unionByName(same).unionByName(later)).drop("seq")


@query("SELECT DISTINCT source, topic_id FROM @v_panel WHERE geography = 3 AND day >= '1998-01-01'")
def h04_affected_partitions(v: Views) -> DataFrame:
    return store.affected_partitions(v.panel, v.panel.where("geography = 3 AND day >= '1998-01-01'").select("source", "geography", "day").distinct())


@query("SELECT o_orderpriority AS source, max(o_orderkey) AS run_id, max_by(CAST(o_orderdate AS DATE), o_orderkey) AS requested_start, CAST(max_by(CAST(o_orderdate AS DATE), o_orderkey) + 30 AS DATE) AS requested_end FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def h05_latest_range(v: Views) -> DataFrame:
    day = F.to_date("o_orderdate")
    runs = v.table("orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("run_id"), day.alias("requested_start"), F.date_add(day, 30).alias("requested_end"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("error"))
    return store.latest_range(runs)


# Checks


PANEL_DAYS = "(SELECT DISTINCT day FROM @v_panel)"


@query(f"SELECT t.topic_id, g.n_nationkey::BIGINT AS geography, d.day, 'missing' AS problem FROM (SELECT DISTINCT topic_id FROM @v_panel) t, nation g, {PANEL_DAYS} d WHERE NOT EXISTS (SELECT 1 FROM @v_panel p WHERE p.topic_id = t.topic_id AND p.geography = g.n_nationkey AND p.day = d.day)")
def i01_missing_cells(v: Views) -> DataFrame:
    spine = v.panel.select("topic_id").distinct().crossJoin(countries(v).select(F.col("country").alias("geography"))).crossJoin(v.panel.select("day").distinct())
    return quality.missing_cells(spine, v.panel, ["topic_id", "geography", "day"])


@query("SELECT l_orderkey, l_returnflag, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def i02_duplicate_keys(v: Views) -> DataFrame:
    return quality.duplicates(v.table("lineitem"), ["l_orderkey", "l_returnflag"])


@query("SELECT s.topic_id, s.geography, CAST(d AS DATE) AS day FROM (SELECT DISTINCT topic_id, geography FROM @v_panel) s, generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY) g(d) WHERE NOT EXISTS (SELECT 1 FROM @v_panel p WHERE p.topic_id = s.topic_id AND p.geography = s.geography AND p.day = CAST(d AS DATE))")
def i03_missing_days(v: Views) -> DataFrame:
    return quality.missing_days(v.panel, ["topic_id", "geography"], "1995-01-01", "1995-12-31")


@query("SELECT DISTINCT host FROM @v_articles WHERE host NOT IN (SELECT domain FROM @v_map)")
def i04_unexpected_labels(v: Views) -> DataFrame:
    return quality.unexpected(v.articles, domain_map(v).select(F.col("domain").alias("host")), "host")


@query("SELECT doc_id, host FROM @v_articles WHERE host IN (SELECT domain FROM @v_map)")
def i04_rows_of_known_labels(v: Views) -> DataFrame:
    return quality.of_known_labels(v.articles, domain_map(v).select(F.col("domain").alias("host")), "host", explicit=False).select("doc_id", "host")


@query("SELECT record_id, rule FROM (SELECT record_id, unnest(list_filter([CASE WHEN alert_score > 3 THEN 'score' END, CASE WHEN end_day - start_day > 5 THEN 'span' END, CASE WHEN lat > 70 THEN 'latitude' END], lambda x: x IS NOT NULL)) AS rule FROM @v_events)")
def i05_domain_checks(v: Views) -> DataFrame:
    rules = {"score": F.col("alert_score") <= 3, "span": F.datediff("end_day", "start_day") <= 5, "latitude": F.col("lat") <= 70}
    return quality.broken(v.hazard_events, "record_id", rules)


@query("SELECT 'phrases' AS \"table\", phrase AS key, count(*) AS rows FROM @v_phrases GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'domains', lower(domain), count(*) FROM @v_domains GROUP BY 2 HAVING count(*) > 1")
def i06_dimension_checks(v: Views) -> DataFrame:
    return quality.dimension_problems({"phrases": (v.phrases, ["phrase"]), "domains": (v.domains.withColumn("domain", F.lower("domain")), ["domain"])})


MARKED = "(lower(domain) || CASE WHEN country % 11 = 0 THEN '/x' ELSE '' END)"


@query(f"""SELECT 'missing signal' AS problem, s AS key FROM (VALUES ('political_actor'), ('government_action'), ('party_politics'), ('public_reaction')) t(s) WHERE s NOT IN (SELECT dimension_id FROM @v_phrases WHERE evidence_kind = 'political_signal')
UNION ALL SELECT DISTINCT 'not a bare host', country || '|' || {MARKED} FROM @v_domains WHERE country % 11 = 0 UNION ALL SELECT 'repeated domain', country || '|' || {MARKED} FROM @v_domains GROUP BY country, {MARKED} HAVING count(*) > 1""")
def i06_political_problems(v: Views) -> DataFrame:
    signals = v.phrases.where("evidence_kind = 'political_signal'").select(F.col("dimension_id").alias("signal")).distinct()
    official = v.domains.select("country", F.concat("domain", F.when(F.col("country") % 11 == 0, "/x").otherwise("")).alias("domain"))
    return quality.political_problems(signals, official, ["political_actor", "government_action", "party_politics", "public_reaction"])


@query(f"SELECT domain, country FROM {OFFICIAL} WHERE country NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def i07_foreign_official_domains(v: Views) -> DataFrame:
    selected = v.table("nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("country"))
    return quality.foreign_domains(official(v), selected)


@query("SELECT record_id, scope, count(*) AS coverage_days, count(*) FILTER (WHERE day < start_day) AS pre_days, count(*) FILTER (WHERE day > end_day) AS post_days, count(*) FILTER (WHERE day < start_day) >= 7 AND count(*) FILTER (WHERE day > end_day) >= 7 AS enough FROM (SELECT DISTINCT record_id, scope, day, start_day, end_day FROM @v_series) GROUP BY 1, 2")
def i08_window_sufficiency(v: Views) -> DataFrame:
    return events.once_per_window(v.hazard_events, lambda e: events.coverage(events.event_series(scope_days(v, e))))


@query(WINDOWS)
def l01_windows(v: Views) -> DataFrame:
    return planned(v)


@query(f"WITH w AS ({WINDOWS}) {STATES}")
def l02_ledger_fold(v: Views) -> DataFrame:
    return ledger.with_window_id(window_states(v), ["query_id"], *YEAR[1:]).select("window_id", "status", "attempts")


def live_query(v: Views, build, schema_of: DataFrame, columns: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming plan over the table's file to its end, and returns what it wrote."""
    from quillspark.streaming.attention import drained

    return drained(build(v.spark.readStream.schema(schema_of.schema).parquet(f"{v.sf_dir}/{columns}*")), mode)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS articles FROM events GROUP BY 1, 2")
def j02_live_counts(v: Views) -> DataFrame:
    from quillspark.streaming.attention import live_counts

    return live_query(v, lambda s: live_counts(s, ["event_type"]), v.table("events"), "events.parquet")


@query("SELECT DISTINCT user_id FROM events")
def j03_live_without_repeats(v: Views) -> DataFrame:
    from quillspark.streaming.attention import without_repeats

    return live_query(v, lambda s: without_repeats(s.select("user_id", "ts"), "user_id", "60 days"), v.table("events"), "events.parquet", "append").select("user_id")
