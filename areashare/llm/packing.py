"""Best-fit packing of documents into sequences, planned on a histogram of lengths."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areashare.llm.tokens import encoder, ids_crc32, map_texts, parts
from areashare.sources.storage import scratch_table

END_ID = 1
CAPACITY = 4096
# Ranks within a length take the low bits of a slot's key.
RANK_BITS = 44

PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
    " shard bigint, nth bigint"
)
PACKED = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
    " sequence_id bigint, offset bigint"
)


@dataclass
class Plan:
    """Runs of equally long pieces: ranks from ``rank`` on fill sequences from ``sequence`` on,
    ``per`` pieces to a sequence, the first of them at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given by length and rank among that length."""
        keys = (self.length << RANK_BITS) | self.rank
        run = np.searchsorted(keys, (length << RANK_BITS) | rank, side="right") - 1
        nth = rank - self.rank[run]
        per = self.per[run]
        return self.sequence[run] + nth // per, self.offset[run] + nth % per * length


def plan_best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: longest pieces first, each into the fullest
    sequence with room for it.

    Sequences with the same room are held as ranges of numbers, so the work follows
    the number of distinct lengths, at most ``capacity``, and not that of pieces.
    """
    rooms: list[int] = []  # sorted
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    n_sequences = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(at)
            else:
                room = capacity
                first, n = n_sequences, -(-left // (capacity // length))
                n_sequences += n
            per = room // length
            full = min(n, left // per)
            some = left - full * per if full < n and left - full * per < per else 0
            if full:
                runs.append((length, rank, first, per, capacity - room))
                add(room - per * length, first, full)
            if some:
                runs.append((length, rank + full * per, first + full, some, capacity - room))
                add(room - some * length, first + full, 1)
            used = full + (some > 0)
            add(room, first + used, n - used)
            rank += full * per + some
            left -= full * per + some
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*columns, n_sequences=n_sequences)


def _cut(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part, texts in parts(batch, batch.column(1)):
                ids, ends = encoder(tokenizer).encode(texts, end_id)
                size = np.diff(ends, prepend=0)
                n_pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n_pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = nth * capacity
                length = np.minimum(size[doc] - start, capacity)
                at = (ends - size)[doc] + start
                crc = [ids_crc32(ids[a : a + n]) for a, n in zip(at, length)]
                # The rank of a piece among those of its length in this shard.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - first + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc)),
                        pa.array(nth, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(doc), shard), pa.int64()),
                        pa.array(rank, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "shard", "nth"],
                )

    return run


def _place(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.slots(
                batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def best_fit_packing(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents with the sequence and the place they take in it.

    A document is the ids of its whole text and ``end_id``; null counts as empty, so every row
    gives a piece. Documents of over ``capacity`` ids are cut into pieces of ``capacity``. Repeated
    rows are packed as often as they occur, a null ``doc_id`` stays null, other columns are not
    read. An empty table gives an empty one.

    Tokenizing writes one row per piece and its rank among equally long ones of its
    task. From there on only counts travel: pieces per length and task, then per length, at
    most ``capacity`` rows, on which the driver plans. Pieces look their slot up by
    their rank within their length.
    """
    text = docs.select(F.col("doc_id").cast("bigint"), "text")
    pieces = scratch_table(map_texts(text, _cut(tokenizer, capacity, end_id), PIECES), "pieces")
    counts = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = counts.select(
        "shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    plan = plan_best_fit({row.length: row.n for row in histogram.collect()}, capacity)
    ranked = pieces.join(ranks, ["shard", "length"]).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.col("nth")).alias("rank"),
    )
    return ranked.mapInArrow(_place(plan), PACKED)
