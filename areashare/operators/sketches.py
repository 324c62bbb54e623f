"""Approximate percentiles from quantile sketches that are kept and merged over periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashare.functions.scalars import missing_to_null
from areashare.operators.bands import ALL_BANDS

# Values that a sketch keeps per level. A full sketch is some 20 kB, whatever it has seen.
K = 800


def rank_bound(k: int = K) -> float:
    """How far, as a share of all values, the rank of a percentile may be off.

    Fixed values: the published error of such sketches, met in 99 % of all cases. Twice that is
    missed about once in a million.
    """
    return 2 * 2.296 / k**0.9021


def percentile_sketches(
    df: DataFrame,
    period: str = "month",
    value: str = "perc_doacs",
    by: Sequence[str] = (),
    k: int = K,
) -> DataFrame:
    """One row per period (and ``by``): how many values it has and their sketch.

    Missing values and rows without a period do not count. Each task sketches what it reads, so a
    period with a third of all rows travels as one sketch per task. The rows are meant to be
    written and kept beside the measure.
    """
    present = df.select(period, *by, missing_to_null(F.col(value).cast("double")).alias("__value"))
    present = present.where(F.col(period).isNotNull() & F.col("__value").isNotNull())
    sketched = present.groupBy(period, *by).agg(F.kll_sketch_agg_double("__value", k).alias("sketch"))
    return sketched.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def merged_sketches(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Sketches of wider groups, such as years or all areas, without a look at the values."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def sketch_bands(
    sketches: DataFrame, points: Sequence[int] = ALL_BANDS, value: str = "perc_doacs"
) -> DataFrame:
    """One row per sketch and percentile, with the other columns of ``sketches``.

    The value is one of the values seen, not one between two of them; its rank is within ``rank_bound``.
    """
    points = sorted(set(points))
    if not points or not all(isinstance(p, int) and 0 <= p <= 100 for p in points):
        raise ValueError(f"percentiles must be whole numbers from 0 to 100: {points}")
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p / 100) for p in points]))
    pairs = F.arrays_zip(F.array(*map(F.lit, points)).alias("percentile"), found.alias("value"))
    kept = [c for c in sketches.columns if c != "sketch"]
    rows = sketches.select(*kept, F.explode(pairs).alias("__band"))
    return rows.select(*kept, F.col("__band.percentile"), F.col("__band.value").alias(value))


def rank_errors(df: DataFrame, bands: DataFrame, period: str = "month", value: str = "perc_doacs") -> DataFrame:
    """(period, percentile, n, error): how far off the ranks of ``bands`` are in the values themselves.

    A value may stand for all ranks from the values below it to those up to it; the error is 0 if the
    percentile is among them.
    """
    present = df.select(F.col(period).alias("__period"), missing_to_null(F.col(value).cast("double")).alias("v"))
    wanted = bands.groupBy(F.col(period).alias("__period")).agg(
        F.collect_list(F.struct("percentile", F.col(value).alias("at"))).alias("bands")
    )
    rows = present.where("v IS NOT NULL").join(wanted, "__period").select("__period", "v", F.explode("bands").alias("b"))
    counts = rows.groupBy("__period", "b.percentile").agg(
        F.count("*").alias("n"),
        F.sum((F.col("v") < F.col("b.at")).cast("bigint")).alias("below"),
        F.sum((F.col("v") <= F.col("b.at")).cast("bigint")).alias("upto"),
    )
    share = F.col("percentile") / 100
    error = F.greatest(F.col("below") / F.col("n") - share, share - F.col("upto") / F.col("n"), F.lit(0.0))
    return counts.select(F.col("__period").alias(period), "percentile", "n", error.alias("error"))
