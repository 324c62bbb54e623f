"""Checks on a key that a join relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself, or an error when a key repeats: a join would multiply sums."""
    repeated = duplicate_keys(df, *keys).count()
    if repeated:
        raise ValueError(f"{repeated} repeated keys in {', '.join(keys)}")
    return df
