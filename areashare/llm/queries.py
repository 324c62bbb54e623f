"""The training-data operators as queries over the whole test tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areashare.llm import (
    exact_dedup,
    filter_audit,
    html_text,
    hyperminhash,
    line_dedup,
    mixing,
    packing,
    periodicity,
    quality,
    secrets,
    simhash,
    token_files,
    toxicity,
)
from areashare.sources.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


@functools.lru_cache(maxsize=1)
def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return found.withColumnRenamed("digest", "text_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", "n_lines_removed")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), short=mixing.SHORT)
    return mixed.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/areashare/tokens/{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.token_digests(token_files.read_token_files(spark, path))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.minhash_groups(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodicity.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodicity.planted)
    return periodicity.run_digests(found)


def build_queries() -> dict[str, Query]:
    found = (
        op1_exact_dedup,
        op2_best_fit_packing,
        op3_line_dedup,
        op4_secret_scan,
        op5_toxicity,
        op6_html_text,
        op7_quality_rules,
        op8_simhash,
        op9_mixing,
        op10_token_files,
        op11_minhash,
        op12_filter_audit,
        op13_periodic_runs,
    )
    return {query.__name__: query for query in found}
