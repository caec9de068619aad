"""From raw documents to token ids: quality rules, line dedup, near-copy join, source mix, byte-pair encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet in the shared folder and read again as the next one's ``docs``.  All
stages but the last return the columns of ``documents``.

* ``quality_rules`` drops the documents that the base check or a certified cutoff rejects.
* ``line_dedup`` drops the lines of recurring templates; every document stays.
* ``near_copies`` keeps the document of each group (five-word shingles, 80 percent) that has the least doc_id.
* ``source_mix`` repeats or leaves out documents so that sources reach their targets.
* ``encoding`` returns doc_id, ids and what they decode to, a row for each copy in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symdex.llm import byte_pairs, jaccard_join, line_templates, quality_rules, source_mix
from symdex.llm.common import documents, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.without_recurring_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_pairs.encode_and_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("source_mix", mixing),
    ("encoding", encoding),
]

#: The last stage encodes with a tokenizer's merges, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
