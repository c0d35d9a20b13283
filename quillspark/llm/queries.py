"""The queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

from quillspark.llm import decontamination, hard_negatives, language_id, line_dedup, packing, quality_rules, secret_scan, sharding, simhash, spelling, suffix_dedup, url_filter, warc
from quillspark.llm.common import new_path, table


def op1_line_dedup(spark, sf_dir):
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"), new_path(spark, "slot-map"))


def op5_decontamination(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark, sf_dir):
    return url_filter.verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_simhash_vptree(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op11_language_id(spark, sf_dir):
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.negatives(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc_revisits, op3_quality_rules, op4_sharding, op5_decontamination, op6_url_filter, op7_simhash_vptree, op8_suffix_dedup, op9_packing, op10_secret_scan, op11_language_id, op12_hard_negatives, op13_spelling_variants)}
ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE, "op5_decontamination": decontamination.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
