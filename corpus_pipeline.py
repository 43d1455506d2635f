"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing. Part of the llm subpackage.

Each stage is one of the numbered operators over all that the stage before it kept; ``run`` writes every stage's result
as Parquet in the shared folder and reads it again. All stages but the last return the columns of ``documents``; the
last returns packed pieces with their ids. Nulls, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import exact_dedup, mixing, packing, repetition, simhash
from loomline.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules (operator 2)."""
    return repetition.keep_unrepetitive(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (operator 1)."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more (operator 7)."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares (operator 4)."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed windows of token ids (operator 5)."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # stages 3 to 5 can't be stated in SQL; tests/llm holds the pipeline against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
