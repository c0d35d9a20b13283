"""Phrase matches in texts and n-gram contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.values import let

#: Bytes of a table, as JSON, up to which it is sent to every executor.
BROADCAST_BYTES = 32 << 20
EVIDENCE = ["day", "url", "evidence_kind", "dimension_id", "phrase", "language", "segmentation"]
#: Words around a word, and code points around a code point, in a row of n-grams.
WORDS, CHARACTERS = 5, 12
#: Code points of a text that are cut into n-grams at once.
BLOCK = 64
#: Phrases up to which a text is searched for each.
FEW = 64


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint when it has at most so many bytes; else as it is, for a join by shuffling."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def units_in_context(units: Column, width: int, between: str, kind: int, wanted: list[str] | None = None) -> Column:
    """An array of (pos, ngram, pre, post, type) for the units of a text (or those wanted), with so many units before and after. Units are
    taken one by one (beyond the ends they are null and left out), as a slice would walk over the whole text for each of them."""

    def rows(us: Column) -> Column:
        def row(i: Column) -> Column:
            pre, post = (F.concat_ws(between, *(F.get(us, i + k) for k in ks)) for ks in (range(-width, 0), range(1, width + 1)))
            return F.struct(i.alias("pos"), F.get(us, i).alias("ngram"), pre.alias("pre"), post.alias("post"), F.lit(kind).alias("type"))

        places = F.sequence(F.size(us) - 1, F.lit(0))
        return F.when(F.size(us) > 0, F.transform(places if wanted is None else F.filter(places, lambda i: F.get(us, i).isin(wanted)), row))

    return let(units, rows)


def point_rows(texts: DataFrame, text: str, keep: list[str], before: int, after: int, of: Column | None = None) -> DataFrame:
    """keep, pos, whole and at for each code point of a text: it is the one at place `at` of whole, which has at least so many code points
    before and after it where the text has them. Texts are cut into blocks first, so that a row stays small. of: a condition on keep and whole."""
    size = max(BLOCK, before, after)

    def cut(bs: Column) -> Column:
        side = lambda k: F.coalesce(F.get(bs, k), F.lit(""))
        return F.transform(bs, lambda b, k: F.struct((k * size).alias("start"), F.right(side(k - 1), F.lit(before)).alias("pre"), b.alias("own"), F.left(side(k + 1), F.lit(after)).alias("post")))

    blocks = texts.select(*keep, F.inline(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), cut)))
    wholes = blocks.select(*keep, "start", F.length("pre").alias("pre"), F.length("own").alias("own"), F.concat("pre", "own", "post").alias("whole"))
    rows = (wholes if of is None else wholes.where(of)).withColumn("i", F.explode(F.sequence(F.col("own") - 1, F.lit(0))))
    return rows.select(*keep, (F.col("start") + F.col("i")).alias("pos"), "whole", (F.col("pre") + F.col("i") + 1).alias("at"))


def ngram_rows(articles: DataFrame, keep: list[str], width: int = WORDS, characters: int = CHARACTERS, types: tuple[int, ...] = (1, 2), only: DataFrame | None = None, holding: dict[int, list[tuple]] | None = None) -> DataFrame:
    """keep, pos, ngram, pre, post and type: a row of type 1 for each word of text with the words around it, and one of type 2 for each code
    point that isn't white space with the code points around it, for scripts that part words by nothing.

    only: a table (ngram, type) of the units to make rows of; up to FEW of a type are sought before rows are made.
    holding: by type (phrase, languages), of which a text must hold one in its language; rows whose surroundings hold none may go.
    Places run from the end (within blocks, for code points): Parquet files of rows in that order are smaller.
    """
    found = []
    for kind in types:
        listed = None if only is None else [r[0] for r in only.where(F.col("type") == kind).select("ngram").distinct().orderBy("ngram").limit(FEW + 1).collect()]
        few = listed is not None and len(listed) <= FEW
        wanted = lambda rows: rows if listed is None else rows.where(F.col("ngram").isin(listed)) if few else rows.join(small(only), ["ngram", "type"], "left_semi")  # noqa: B023, E731
        holds = None if holding is None else lambda c: holds_any(F.replace(F.lower(c), F.lit("ς"), F.lit("σ")), F.col("lang"), holding.get(kind, []))  # noqa: B023, E731
        if kind == 1:
            texts = articles if holds is None else articles.where(holds(F.regexp_replace("text", r"\s+", " ")))
            rows = texts.select(*keep, F.inline(units_in_context(words_of(F.col("text")), width, " ", 1, listed if few else None)))
            found.append(rows if few else wanted(rows))
            continue
        texts = articles if holds is None else articles.where(holds(F.col("text")))
        points = point_rows(texts, "text", keep, characters, characters, None if holds is None else holds(F.col("whole")))
        points = points.withColumns({"ngram": F.substr("whole", F.col("at"), F.lit(1)), "type": F.lit(2)})
        points = wanted(points.where(~F.rlike("ngram", F.lit(r"^\s$"))))
        first = F.greatest(F.col("at") - characters, F.lit(1))
        pre, post = F.substr("whole", first, F.col("at") - first), F.substr("whole", F.col("at") + 1, F.lit(characters))
        found.append(points.select(*keep, "pos", "ngram", pre.alias("pre"), post.alias("post"), "type"))
    columns = [*keep, "pos", "ngram", "pre", "post", "type"]
    return found[0].select(*columns) if len(found) == 1 else found[0].select(*columns).unionByName(found[1].select(*columns))


def holds_any(text: Column, lang: Column, wanted: list[tuple]) -> Column:
    """Whether a text holds one of a few (phrase, languages) of its language."""
    out = F.lit(False)
    for phrase, languages in wanted:
        out = out | (spoken_by(lang, languages) & F.contains(text, F.lit(phrase)))
    return out


def with_patterns(phrases: DataFrame) -> DataFrame:
    """phrases (evidence_kind, dimension_id, phrase, language, segmentation) with pattern, type and anchors."""
    segmentation = F.coalesce("segmentation", F.lit("space"))
    return phrases.withColumns(
        {
            "segmentation": segmentation,
            "pattern": T.phrase_pattern(F.col("phrase"), segmentation),
            "anchors": T.anchors(F.col("phrase"), segmentation),
            "type": F.when(segmentation == "character", 2).otherwise(1),
        }
    )


def runs(text: Column) -> Column:
    """The maximal runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def keyed(phrases: DataFrame) -> DataFrame:
    """phrases with key, the token that a text must hold, and size, the number of units in it.

    A phrase of the space mode that begins and ends with a letter or digit is its runs with what stands between them (r); any
    other one of that mode is its code points between edges (e), and one of the character mode its code points anywhere (g).
    """
    spaced, joined = F.lower(T.squeezed(F.col("phrase"))), F.lower(F.replace("phrase", F.lit(" "), F.lit("")))
    segmentation = F.coalesce("segmentation", F.lit("space"))
    kind = F.when(segmentation == "character", "g").when(F.rlike(spaced, F.lit(r"^[\p{L}\p{N}](.*[\p{L}\p{N}])?$")), "r").otherwise("e")
    rows = phrases.withColumns({"segmentation": segmentation, "kind": kind, "token": F.when(kind == "g", joined).otherwise(spaced)}).where("token <> ''")
    return rows.withColumns({"key": F.concat("kind", "token"), "size": F.when(F.col("kind") == "r", F.size(runs(F.col("token")))).otherwise(F.length("token"))}).drop("token")


def run_tokens(text: Column, sizes: list[int]) -> Column:
    """The distinct tokens of kind r of a text (lower-cased, white space squeezed), of so many runs each."""

    none = F.array().cast("array<string>")
    found = lambda group: F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*"), F.lit(group))

    def of(both: Column) -> Column:  # the runs, each with what follows it and bare
        whole, bare = both["whole"], both["bare"]

        def token(n: int):
            return lambda i: F.concat(F.lit("r"), *(F.get(whole, i + k) for k in range(n - 1)), F.get(bare, i + n - 1))

        return F.concat(*(F.coalesce(F.when(F.size(bare) >= n, F.transform(F.sequence(F.lit(0), F.size(bare) - n), token(n))), none) for n in sizes))

    return F.array_distinct(let(F.struct(found(0).alias("whole"), found(1).alias("bare")), of)) if sizes else none


def spoken(rows: DataFrame, *keys: str) -> list[tuple]:
    """The distinct keys of rows (keys, language), each with its languages, None for any; FEW + 1 of them at most."""
    every = rows.groupBy(*keys).agg(F.bool_or(F.col("language").isNull()).alias("__any"), F.array_sort(F.collect_set("language")).alias("__languages"))
    return [(*(r[k] for k in keys), None if r["__any"] else r["__languages"]) for r in every.orderBy(*keys).limit(FEW + 1).collect()]


def spoken_by(lang: Column, languages: list[str] | None) -> Column:
    return F.lit(True) if languages is None else lang.isin(languages)


def few_tokens(text: Column, lang: Column, wanted: list[tuple]) -> Column:
    """Those of a few (kind, key, languages) that a text of the language holds. A pattern begins with its text, which is sought fast."""

    def held(kind: str, key: str) -> Column:
        literal, unit = "\\Q" + key[1:].replace("\\E", "\\E\\\\E\\Q") + "\\E", r"[\p{L}\p{N}]"
        found = F.contains(text, F.lit(key[1:]))
        return found if kind == "g" else found & F.rlike(text, F.lit(f"{literal}(?<!{unit}{literal})(?!{unit})"))

    return F.array_compact(F.array(*(F.when(spoken_by(lang, languages) & held(kind, key), F.lit(key)) for kind, key, languages in wanted)))


def point_tokens(texts: DataFrame, text: str, keep: list[str], sizes: list[tuple[str, int]]) -> DataFrame:
    """keep and key: the tokens of kinds g and e of the kinds and sizes given, for each place of a text."""
    padded = texts.withColumn(text, F.concat(F.lit(" "), text, F.lit(" ")))  # its ends are edges
    rows = point_rows(padded, text, keep, 0, max(n for _, n in sizes) + 2)
    edge = lambda place: ~F.rlike(F.substr("whole", place, F.lit(1)), F.lit(r"^[\p{L}\p{N}]$"))

    def token(kind: str, n: int) -> Column:
        text = F.substr("whole", F.col("at") + int(kind == "e"), F.lit(n))
        fits = (F.length(text) == n) & (edge(F.col("at")) & edge(F.col("at") + n + 1) if kind == "e" else F.lit(True))
        return F.when(fits, F.concat(F.lit(kind), text))

    return rows.select(*keep, F.explode(F.array(*(token(k, n) for k, n in sizes))).alias("key")).where("key IS NOT NULL")


def match_texts(articles: DataFrame, phrases: DataFrame) -> DataFrame:
    """articles (without their text) joined with each phrase of their language (or of any) that their text holds; rows that repeat an
    article in all columns and its text count once.

    One pass over the texts for all topics and signals. Up to FEW phrases are sought one by one, those of a text's language alone. Of
    more, a text's tokens of the sizes that the catalogue has are joined with it by equality, however large it is. A catalogue over
    BROADCAST_BYTES is shuffled by token, and adaptive execution splits a token that many texts hold. A token's row carries the other
    columns of its article, not the text. More than FEW phrases of the character mode (or that begin or end with a mark) take another
    pass, over the code points.
    """
    known, held = keyed(phrases), [c for c in articles.columns if c != "text"]
    texts = articles.withColumns({"text": F.lower(F.regexp_replace("text", r"\s+", " ")), "__text": F.md5("text")})
    few = spoken(known, "kind", "key")
    if len(few) <= FEW:
        found = texts.select(*held, "__text", F.explode(few_tokens(F.col("text"), F.col("lang"), few)).alias("key")) if few else texts.select(*held, "__text", F.lit("").alias("key")).where("false")
    else:
        found = many_tokens(texts, known, held)
    hits = found.join(small(known.drop("kind", "size")), "key").where(T.speaks(F.col("lang"), F.col("language")))
    return hits.distinct().drop("key", "__text")


def many_tokens(texts: DataFrame, known: DataFrame, held: list[str]) -> DataFrame:
    """held, __text and key: the tokens of texts of the kinds and sizes of a large catalogue."""
    sizes = [(r["kind"], r["size"]) for r in known.select("kind", "size").distinct().orderBy("kind", "size").collect()]  # as many as lengths of phrases
    loose = spoken(known.where("kind <> 'r'"), "kind", "key")
    tokens = run_tokens(F.col("text"), [n for k, n in sizes if k == "r"])
    if loose and len(loose) <= FEW:
        tokens = F.concat(tokens, few_tokens(F.col("text"), F.col("lang"), loose))
    found = texts.select(*held, "__text", F.explode(tokens).alias("key"))
    if len(loose) > FEW:
        found = found.unionByName(point_tokens(texts, "text", [*held, "__text"], [(k, n) for k, n in sizes if k != "r"]))
    return found


def anchored_rows(articles: DataFrame, phrases: DataFrame, keep: list[str], width: int = WORDS, characters: int = CHARACTERS) -> DataFrame:
    """ngram_rows of the units that are a phrase's anchor, for match_ngrams: of the types that the catalogue has. Of up to FEW phrases
    a text must hold one: what its words or code points in order don't hold, no context holds. Both sigmas count as one there, as where
    a context is cut decides which of them a capital one becomes."""
    known = with_patterns(phrases)
    anchors = known.select("type", F.explode("anchors").alias("ngram")).distinct()
    types = tuple(r[0] for r in anchors.select("type").distinct().orderBy("type").collect())  # two at most
    sought = F.when(F.col("type") == 2, F.replace("phrase", F.lit(" "), F.lit(""))).otherwise(T.squeezed(F.col("phrase")))
    few = spoken(known.withColumn("sought", F.replace(F.lower(sought), F.lit("ς"), F.lit("σ"))), "type", "sought")
    holding = {kind: [(text, languages) for t, text, languages in few if t == kind] for kind in types} if len(few) <= FEW else None
    return ngram_rows(articles, keep, width, characters, types or (1,), anchors, holding)


def match_ngrams(ngrams: DataFrame, phrases: DataFrame) -> DataFrame:
    """ngrams joined with the phrases whose anchor they are, that speak their language and match their context; with context."""
    known = small(with_patterns(phrases).withColumn("anchor", F.explode("anchors")).drop("anchors").withColumnRenamed("type", "p_type"))
    hit = ngrams.join(known, (F.col("ngram") == F.col("anchor")) & (F.col("type") == F.col("p_type")))
    shown = T.context(F.col("pre"), F.col("ngram"), F.col("post"), F.lit("space"))
    judged = T.context(F.col("pre"), F.col("ngram"), F.col("post"), F.col("segmentation"))
    return hit.where(T.speaks(F.col("lang"), F.col("language")) & F.rlike(F.lower(judged), F.col("pattern"))).withColumn("context", shown).drop("anchor", "p_type", "pattern")


def one_per_evidence(matches: DataFrame, *order: Column | str) -> DataFrame:
    """One row for each EVIDENCE key: the first in the order given, else that whose context hashes lowest."""
    first = F.row_number().over(Window.partitionBy(*EVIDENCE).orderBy(*(order or (F.sha2("context", 256), "context"))))
    return matches.withColumn("__n", first).where("__n = 1").drop("__n")


def article_signals(matches: DataFrame) -> DataFrame:
    """day, url, host, topics (sorted) and a flag for each signal."""
    signal = lambda name: F.bool_or((F.col("evidence_kind") == "political_signal") & (F.col("dimension_id") == name)).alias(name)
    topics = F.array_sort(F.collect_set(F.when(F.col("evidence_kind") == "topic", F.col("dimension_id"))))
    return matches.groupBy("day", "url", "host").agg(topics.alias("topics"), signal("political_actor"), signal("government_action"), signal("party_politics"))


def matched_urls(matches: DataFrame) -> DataFrame:
    """topic_id, day, url, host and the smallest language of each topic's matched urls."""
    topics = matches.where("evidence_kind = 'topic'")
    return topics.groupBy(F.col("dimension_id").alias("topic_id"), "day", "url", "host").agg(F.min("lang").alias("lang"))


def evidence_lists(matches: DataFrame, most: int | None = 100) -> DataFrame:
    """topic_id, day, url, evidence (the first `most` or, for None, all, by kind, dimension, phrase and language), evidence_total and truncated.

    Political evidence goes to every topic of its url, topic evidence to its own topic.
    """
    topics = matches.where("evidence_kind = 'topic'").select("day", "url", F.col("dimension_id").alias("topic_id")).distinct()
    rows = topics.join(matches, ["day", "url"]).where((F.col("evidence_kind") != "topic") | (F.col("dimension_id") == F.col("topic_id")))
    item = F.struct(F.col("evidence_kind").alias("kind"), F.col("dimension_id").alias("dimension"), "phrase", "language")
    lists = rows.groupBy("topic_id", "day", "url").agg(F.array_sort(F.collect_list(item)).alias("all"))
    shown, cut = (F.col("all"), F.lit(False)) if most is None else (F.slice("all", 1, most), F.size("all") > most)
    return lists.select("topic_id", "day", "url", shown.alias("evidence"), F.size("all").cast("long").alias("evidence_total"), cut.alias("truncated"))


def phrases_joined(evidence: str = "evidence") -> F.Column:
    """The phrases of a list of evidence, each once, in first-seen order."""
    return F.array_join(F.array_distinct(F.transform(evidence, lambda x: x["phrase"])), " | ")


def sample_per_group(rows: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """All rows (None) or the first n of each group by the hash of their url."""
    if n is None:
        return rows
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.sha2("url", 256), "url"))
    return rows.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")
