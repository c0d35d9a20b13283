"""Phrases, patterns and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = r"[^\p{L}\p{N}]"
#: Characters with a meaning in patterns.
SPECIAL = r"([\\.^$|?*+()\[\]{}\-&#~])"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, r"\\$1")


def phrase_pattern(phrase: Column, segmentation: Column) -> Column:
    """What a lower-cased context must match. Space mode: units joined by white space between edges; character mode: containment."""
    spaced = F.concat(F.lit(f"(^|{EDGE})"), F.replace(escaped(F.lower(squeezed(phrase))), F.lit(" "), F.lit(r"\s+")), F.lit(f"({EDGE}|$)"))
    return F.when(segmentation == "character", escaped(F.lower(F.replace(phrase, F.lit(" "), F.lit(""))))).otherwise(spaced)


def phrase_units(phrase: Column, segmentation: Column) -> Column:
    return F.when(segmentation == "character", F.split(F.replace(phrase, F.lit(" "), F.lit("")), "")).otherwise(F.split(squeezed(phrase), " "))


def anchors(phrase: Column, segmentation: Column) -> Column:
    """The forms of the phrase's middle unit by which contexts are looked up: lower and capitalised, of a lone word also before . and ,"""
    units = phrase_units(phrase, segmentation)
    middle = F.lower(F.element_at(units, F.floor((F.size(units) - 1) / 2).cast("int") + 1))
    cased = F.array_distinct(F.array(middle, F.concat(F.upper(F.substring(middle, 1, 1)), F.substring(middle, 2, 1_000_000))))
    marked = F.flatten(F.transform(cased, lambda x: F.array(x, F.concat(x, F.lit(".")), F.concat(x, F.lit(",")))))
    return F.when(segmentation == "character", F.array(middle)).when(F.size(units) == 1, marked).otherwise(cased)


def context(pre: Column, ngram: Column, post: Column, segmentation: Column) -> Column:
    """pre, ngram and post as one text; nulls are empty, character mode has no spaces between."""
    parts = [F.coalesce(x, F.lit("")) for x in (pre, ngram, post)]
    return F.when(segmentation == "character", F.concat(*parts)).otherwise(F.concat_ws(" ", *parts))


def speaks(language: Column, wanted: Column) -> Column:
    """A null wanted language means any."""
    return wanted.isNull() | (wanted == language)


def literal_phrase(text: Column) -> Column:
    """Trimmed, outer quotes off, null when blank."""
    bare = F.trim(F.regexp_replace(F.trim(text), '^"(.*)"$', "$1"))
    return F.when(bare != "", bare)


def distinct_phrases(phrases: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of phrases equal but for case (and in keys) the last one's columns at the first one's place; blank ones go."""
    named = phrases.withColumn("phrase", literal_phrase(F.col("phrase"))).where("phrase IS NOT NULL")
    group = Window.partitionBy(*keys, F.lower("phrase"))
    placed = named.withColumns({"place": F.min(order).over(group), "__last": F.row_number().over(group.orderBy(F.desc(order)))})
    return placed.where("__last = 1").drop("__last")


def any_of(phrases: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One expression per group: quoted phrases joined by OR, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit('"'), "phrase", F.lit('"')).alias("q"))))
    return phrases.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["q"]), " OR ").alias("expression"))


def label_key(label: Column) -> Column:
    """Letters and digits alone, lower-cased, without a trailing series name."""
    return F.regexp_replace(F.lower(F.regexp_replace(label, r"(?i)\s*volume intensity\s*$", "")), r"[^\p{L}\p{N}]", "")


def display_label(id_: Column, label: Column) -> Column:
    return F.coalesce(label, F.initcap(F.replace(id_, F.lit("_"), F.lit(" "))))


def optional_text(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def optional_number(text: Column) -> Column:
    """Blank is null; what is no number fails."""
    return optional_text(text).cast("double")


def set_flags(**flags: Column) -> Column:
    """Names of the set flags, in the order given, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))), ",")
