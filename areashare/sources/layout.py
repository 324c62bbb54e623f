"""Copies of the facts that later reads can prune, or join without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Small enough that a file holds several row groups with statistics of their own.
ROW_GROUP_BYTES = 32 << 20


def write_clustered(
    facts: DataFrame,
    path: str,
    by: Sequence[str] = ("month", "bnf_code"),
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """All rows, in order of ``by`` over all files and within them.

    A filter on the first of ``by``, or on both, then reads the row groups that hold its range alone. Rows alike in ``by`` are
    spread by a hash of all their columns, so that a value with a third of all rows fills several files; only rows
    alike in everything stay together. ``files`` fixes the number of tasks that write; without it adaptive execution
    decides.
    """
    order = [F.col(name) for name in by]
    ranges = [*order, F.xxhash64(*facts.columns)]
    spread = facts.repartitionByRange(files, *ranges) if files else facts.repartitionByRange(*ranges)
    spread.sortWithinPartitions(*order).write.option("parquet.block.size", row_group_bytes).parquet(path)


def cell_sums(facts: DataFrame, by: Sequence[str] = ("month", "pct", "bnf_code"), value: str = "items") -> DataFrame:
    """One row per combination of ``by`` with the sum of ``value``, NULL if there is nothing but NULL.

    A measure over these is the same as over the facts. They are combined before the shuffle, so that an area
    has as many rows as it has periods and codes, however many facts it holds.
    """
    return facts.groupBy(*by).agg(F.sum(value).alias(value))


def write_bucketed(
    table: DataFrame,
    name: str,
    path: str,
    key: str,
    buckets: int,
    within: Sequence[str] = (),
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """A catalog table ``name`` at ``path``, one file per bucket of ``key``, in order of ``within`` inside it.

    Two tables with as many buckets, each by its side of a join, meet without a shuffle, and sums by ``key`` and
    others need none. One task reads a bucket, so write down sums (``cell_sums``) or other tables whose rows
    per key are bounded, not facts of which one area may hold a third.
    """
    writer = table.repartition(buckets, key).write.bucketBy(buckets, key)
    if within:
        writer = writer.sortBy(*within)
    writer.option("path", path).option("parquet.block.size", row_group_bytes).format("parquet").saveAsTable(name)
