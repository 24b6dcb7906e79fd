"""From raw documents to tokens: five stages, each one operator of ``tidemark.llm``.

A stage takes (spark, docs, sf_dir), with the columns of ``documents``, and
returns what it keeps in the same columns; the last adds its tokens.  Each
result is written as Parquet in the cluster's shared folder and read again, so
a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, factors, neardup, ngrams
from tidemark.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 2000  # documents that a Python worker gets at once; Spark's own 10,000 are tens of MB on either side


def modest(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has a size of its own."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, ROWS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text doesn't reject."""
    modest(spark)
    return ngrams.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(docs.columns)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    modest(spark)
    return neardup.drop_near_duplicates(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has; a document stays even if nothing of it does."""
    modest(spark)
    left = factors.remove_repeated_words(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    modest(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the digests of ids and decoded text."""
    modest(spark)
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("near_dedup", no_near_duplicates),
    ("substring_dedup", no_repeated_passages),
    ("decontamination", no_benchmark_items),
    ("bpe_encoding", tokens),
]

#: SQL cannot train the model or merge byte pairs; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
