"""A training corpus from ``documents``: good, unrepeated, mixed to weight and packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areashare.llm import line_dedup, mixing, packing, quality, simhash
from areashare.llm.queries import table, tokenizer_path, trusted
from areashare.sources.storage import own_folder, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like those labelled as good."""
    return quality.keep_good(docs, trusted(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand in an earlier place."""
    kept = line_dedup.line_dedup(docs)
    n_chars = F.when(F.col("n_lines_removed") > 0, F.length("text").cast("bigint"))
    return kept.withColumn("n_chars", F.coalesce(n_chars, "n_chars")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights."""
    return mixing.mix(docs, short=mixing.SHORT).where("sampled").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]
# Fingerprints, token ids and the packing plan are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    own_folder(spark)
    folder = f"{shared_folder(spark)}/areashare/pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
