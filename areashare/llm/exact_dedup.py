"""Exact deduplication on keyed state that a stream builds up and keeps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areashare.sources.storage import scratch_table, shared_folder

WHITE_SPACE = " \t\n\x0b\x0c\r"
# Copies that one row of the byte comparison's smaller side serves.
SHARE = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank() -> Column:
    """Orders equal texts: the greatest stays, and says where its content is."""
    return F.struct(
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        F.bitwise_not(F.col("doc_id").cast("bigint")).alias("flipped_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def update_state(spark: SparkSession, path: str, state_dir: str, digest=sha256) -> DataFrame:
    """Take the files of a Parquet table that are new since the last call into the state,
    and return the state: digest, n, best (length, id and place of the row that stays).

    The state is a streaming aggregate in RocksDB, one entry per digest, never expired. Its
    checkpoint in ``state_dir`` knows the files already read, so lost executors or a stopped
    call cost only the unfinished batch.
    """
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.compression.codec", "zstd")
    # A small store is not to hold disk space ahead of its needs.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    schema = spark.read.parquet(path).schema
    # Files of any age count. As a pattern, the path may be one file as well as a folder.
    folder, _, name = path.rstrip("/").rpartition("/")
    files = f"{folder}/{{{name}}}"
    new = session.readStream.schema(schema).option("maxFileAge", "36500d").parquet(files)
    keyed = new.select(digest(normalised(F.col("text"))).alias("digest"), _rank().alias("rank"))
    state = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.max("rank").alias("best"))
    (
        state.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", state_dir)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    # The aggregate's buffers: the count, then the greatest rank.
    kept = session.read.format("statestore").load(state_dir)
    n, best = kept.schema["value"].dataType.names
    return scratch_table(
        kept.select("key.digest", F.col(f"value.{n}").alias("n"), F.col(f"value.{best}").alias("best")),
        "dedup-state",
    )


def exact_dedup(
    spark: SparkSession, path: str, state_dir: str | None = None, digest=sha256
) -> DataFrame:
    """Every row of the Parquet table at ``path`` with the row that stays for its text.

    Columns: doc_id, keep_id, group_size, kept, digest. Texts are equal when identical without ASCII
    white space; null counts as empty. Of equal texts the one with the most code points stays, then the
    smallest doc_id; a null doc_id loses to any other. Of repeated rows exactly one is kept. An
    empty table gives an empty result; other columns are not read. ``state_dir`` keeps the state for
    later files; by default each call has a folder of its own.

    A digest alone decides nothing: rows that hit an entry are compared byte by byte with the text
    that entry points to. Should texts with one digest differ, their rows are grouped by the
    texts themselves. The table must not change during the call.
    """
    folder = state_dir or f"{shared_folder(spark)}/areashare/dedup/{uuid.uuid4().hex}"
    state = update_state(spark, path, folder, digest)
    rows = spark.read.parquet(path).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        normalised(F.col("text")).alias("content"),
        _rank().alias("rank"),
    )
    rows = rows.withColumn("digest", digest(F.col("content")))
    found = scratch_table(
        rows.join(state, "digest").select(
            "doc_id",
            "digest",
            "n",
            "best",
            "rank",
            (F.col("rank") == F.col("best")).alias("kept"),
            F.when(F.col("n") > 1, F.col("content")).alias("content"),
        ),
        "dedup-hits",
    )
    shares = F.ceil(F.col("n") / SHARE).cast("int")
    hits = found.where("n > 1")
    entries = hits.where("kept").select(
        "digest",
        F.col("content").alias("entry"),
        F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"),
    )
    differing = (
        hits.where("NOT kept")
        .withColumn("share", F.pmod(F.xxhash64("rank"), shares).cast("int"))
        .join(entries, ["digest", "share"])
        .where(F.col("content") != F.col("entry"))
        .select("digest")
        .distinct()
    )
    result = found.select("doc_id", "digest", "n", "best", "kept")
    if not differing.isEmpty():
        result = _by_text(found, scratch_table(differing, "dedup-collisions"))
    return result.select(
        "doc_id",
        F.bitwise_not("best.flipped_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        "digest",
    )


def _by_text(found: DataFrame, differing: DataFrame) -> DataFrame:
    """``found`` with the rows of colliding digests grouped by their texts."""
    columns = ["doc_id", "digest", "n", "best", "kept"]
    mixed = found.join(differing, "digest", "left_semi")
    groups = mixed.groupBy("digest", "content").agg(
        F.count("*").alias("n"), F.max("rank").alias("best")
    )
    sorted_out = mixed.drop("n", "best", "kept").join(groups, ["digest", "content"])
    sorted_out = sorted_out.withColumn("kept", F.col("rank") == F.col("best"))
    alone = found.join(differing, "digest", "left_anti")
    return alone.select(columns).unionByName(sorted_out.select(columns))
