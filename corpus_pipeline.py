"""The corpus pipeline: STAGES by name, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from losslens.llm import line_dedup, near_copies as copies, packing, quality, toxicity
from losslens.llm.common import bound_batches
from losslens.llm.queries import RANKS, SPECIALS, pattern, vocabulary
from losslens.sources.saved import delete, fresh, scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go; short ones stay unless they repeat themselves, as their histograms mean nothing."""
    return quality.drop_low_quality(docs, least_words=1)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 documents go from every document."""
    bound_batches(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (op7's SimHash blocks, then bands for what lies further apart; 5-word Jaccard of 0.8 or more) stays."""
    bound_batches(spark)
    return copies.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    bound_batches(spark)
    return packing.pack_documents(docs, vocabulary(RANKS), pattern(), SPECIALS)


STAGES = [("toxicity", toxic), ("quality rules", quality_rules), ("line dedup", repeated_lines), ("near-dedup", near_copies), ("packing", pack)]

#: Learned verdicts, fingerprints and token ids have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage on what the one before it wrote; what a stage saved for itself, and its input once used, is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = fresh(spark, "stage")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
