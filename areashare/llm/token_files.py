"""Token ids in ORC files: written in document order, read stripe by stripe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areashare.llm.tokens import as_bytes, encoder, ids_crc32, slices

END_ID = 1
IDS = "shard int, nth bigint, doc_id bigint, shard_start bigint, ids array<int>"
# Integer run lengths are what ORC does with integers; the rest is asked for.
ORC_OPTIONS = {
    "compression": "lz4",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nth, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for begin, end in slices(texts):
                ids, ends = encoder(tokenizer).encode(texts[begin:end], end_id)
                n = end - begin
                bounds = np.concatenate([[0], ends])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, shard), pa.int32()),
                        pa.array(np.arange(nth, nth + n), pa.int64()),
                        batch.column(0).slice(begin, n),
                        pa.array(total + bounds[:-1], pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))
                        ),
                    ],
                    names=["shard", "nth", "doc_id", "shard_start", "ids"],
                )
                nth, total = nth + n, total + len(ids)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, closed by ``end_id``, in ascending ``doc_id``.

    Each task takes a range of ids and writes one file, its shard; files follow each
    other in the order of their shard numbers. A row holds its shard, its place there
    (row and first id) and its ids. Rows of one ``doc_id`` are ordered by their text's hash, a null
    ``doc_id`` comes first, null texts count as empty, other columns are not read. An empty table
    gives a table without rows.
    """
    text = docs.select(F.col("doc_id").cast("bigint"), "text")
    order = ["doc_id", F.xxhash64("text")]
    ordered = text.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ordered.mapInArrow(_encode(tokenizer, end_id), IDS)
    rows.write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of such files, with ``start``: the ids of all rows before.

    Files are split by stripes. A filter on ``doc_id`` reaches the scan, where stripe statistics,
    row indexes and Bloom filters skip what cannot match.
    """
    rows = spark.read.schema(IDS).orc(path)
    totals = rows.groupBy("shard").agg(F.sum(F.size("ids").cast("bigint")).alias("n_ids"))
    # One row per file, of which there are as many as the writer had tasks.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"))
    return rows.join(F.broadcast(starts), "shard").select(
        "doc_id",
        (F.col("file_start") + F.col("shard_start")).alias("start"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ids, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        crc = [ids_crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(rows: DataFrame) -> DataFrame:
    """Per row of ``read_token_files`` its place, its number of ids and their crc32."""
    return rows.mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
