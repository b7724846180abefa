"""A corpus cleaning pipeline: each stage works on all that the one before kept.

Toxic documents go, later near-repeated lines go, one document of each group of near copies stays, documents that hold
a benchmark item go, and the rest is mixed to the sources' target weights. Every stage but the last returns the
columns of ``documents``; stages are written as tables in the shared folder and read again. Rows with a null doc_id or
text are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradus.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from gradus.llm.common import scratch, staged


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; learned from all labelled rows, within its bound."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later lines that nearly repeat an earlier one, and without documents that end blank by it."""
    return line_dedup.drop_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return ngram_join.keep_one_each(docs, k=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, numbered by ``copy``."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_copies", near_copies), ("decontaminate", leaks), ("mix", mixed)]

#: The classifier can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = staged(stage(spark, docs, sf_dir))
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
