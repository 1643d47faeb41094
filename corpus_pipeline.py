"""The training-data pipeline: documents in, a weighted corpus without toxic texts, copies, leaks and personal data out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import common, decontaminate, mixing, pii, simhash, toxicity

#: Wanted token shares by quality, after the toxic documents are gone.
MIX_WEIGHTS = {"q1t0": 0.85, "q0t0": 0.15}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    common.small_batches(spark)
    return toxicity.drop_toxic(docs, common.read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, stays of each group of near copies (five-word shingles, similarity 0.8)."""
    common.small_batches(spark)
    return simhash.drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    common.small_batches(spark)
    return decontaminate.drop_contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, are replaced by their kind."""
    return pii.sanitised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the rate and the number of copies that bring its domain to the wanted share."""
    return mixing.mixed(docs, mixing.domain_of(common.read_table(spark, sf_dir, "labels")), MIX_WEIGHTS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("decontamination", leaks),
    ("personal_data", personal_data),
    ("mixing", mixture),
]

#: SQL cannot express a trained network; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialised(stage(spark, docs, sf_dir), name)
    return docs
