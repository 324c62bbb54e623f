"""Compare snapshots by digests first: only rows of buckets that differ are compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashare.operators.snapshot import _compared, snapshot_diff

# Buckets of key hashes. A digest table has at most so many rows, whatever it stands for.
BUCKETS = 4096
DIGEST = ("n", "a", "b", "c", "d")


def _hashed(columns: Sequence[str], seed: int) -> Column:
    """64 bits of values; a NULL is told apart from its neighbours being shifted."""
    parts = [F.lit(seed)]
    for name in columns:
        value = F.col(f"`{name}`")
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(_hashed(keys, 0), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Per bucket of keys how many rows it has and a digest of them, as a bag, in 128 bits.

    Rows are added up, so their order and their tasks do not matter and repeated rows count. The sums
    of 32 bits each cannot overflow below two billion rows a bucket. One row per task and bucket is
    shuffled. Columns count by name.
    """
    names = sorted(df.columns)
    both = df.select(bucket_of(keys, buckets).alias("bucket"), _hashed(names, 1).alias("x"), _hashed(names, 2).alias("y"))
    halves = {}
    for name, (hashed, shift) in zip(DIGEST[1:], (("x", 0), ("x", 32), ("y", 0), ("y", 32))):
        halves[name] = F.sum(F.shiftright(hashed, shift).bitwiseAND(F.lit((1 << 32) - 1)))
    return both.groupBy("bucket").agg(F.count("*").alias("n"), *[s.alias(c) for c, s in halves.items()])


def differing_buckets(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Buckets whose digests differ or that one side lacks."""
    one = F.lit(1)
    sides = current.select("bucket", *DIGEST, one.alias("side")).unionByName(
        saved.select("bucket", *DIGEST, (-one).alias("side"))
    )
    # Equal digests of both sides cancel.
    unmatched = sides.groupBy("bucket", *DIGEST).agg(F.sum("side").alias("side")).where("side != 0")
    return unmatched.select("bucket").distinct()


def digest_diff(
    current: DataFrame,
    saved: DataFrame,
    keys: Sequence[str],
    *,
    ignore_columns: Sequence[str] = (),
    ignore_where: Column | str | None = None,
    buckets: int = BUCKETS,
    saved_digests: DataFrame | None = None,
) -> DataFrame:
    """What ``snapshot_diff`` finds, with only the rows of differing buckets shuffled.

    First the digests of both sides are compared, ``buckets`` rows at most. Equal tables move nothing else; one
    changed row moves the rows of its bucket. ``saved_digests`` may be what ``bucket_digests`` gave for
    the same keys, buckets and rows when the table was saved: then the saved table itself is read only if something
    differs.
    """
    if dict(_compared(current, ignore_columns, None).dtypes) != dict(_compared(saved, ignore_columns, None).dtypes):
        raise ValueError(f"columns differ: {current.dtypes} and {saved.dtypes}")
    sides = [_compared(df, ignore_columns, ignore_where) for df in (current, saved)]
    digests = [bucket_digests(df, keys, buckets) for df in sides]
    if saved_digests is not None:
        digests[1] = saved_digests
    found = sorted(row[0] for row in differing_buckets(*digests).collect())
    inside = bucket_of(keys, buckets).isin(found) if found else F.lit(False)
    return snapshot_diff(*[df.where(inside) for df in sides], keys=keys)
