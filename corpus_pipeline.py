"""A training-corpus pipeline: each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvtrail.llm import jaccard, packing, quality_net, suffix_dedup, toxicity
from kvtrail.llm.storage import written

#: No SQL can express the classifiers, so there is none for the whole.
ORACLE_SQL: str | None = None


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts."""
    return quality_net.keep_good(docs, quality_net.fit(*_tables(spark, sf_dir)))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine doesn't call toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(*_tables(spark, sf_dir)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur more than once."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of all documents."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
