"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm import byte_pairs, fingerprints, html_text, jaccard_join, katz_lm, lexical_search, license_scan, line_templates, quality_rules, repeats, source_mix, token_files, vector_codes
from symdex.llm.common import documents, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_findings(documents(spark, sf_dir), license_scan.TEMPLATES)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(documents(spark, sf_dir), length=200)


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(documents(spark, sf_dir), words=4, percent=85)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_mix.mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, cap=2)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(documents(spark, sf_dir), "byte_bpe_50k.json")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.scores(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(documents(spark, sf_dir), "byte_bpe_50k.json", end_id=2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings")).drop("label")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_repeats": op2_repeats,
    "op3_line_templates": op3_line_templates,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_source_mix": op5_source_mix,
    "op6_byte_pairs": op6_byte_pairs,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality_rules": op8_quality_rules,
    "op9_katz_lm": op9_katz_lm,
    "op10_token_files": op10_token_files,
    "op11_vector_codes": op11_vector_codes,
    "op12_html_text": op12_html_text,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op5_source_mix": source_mix.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
