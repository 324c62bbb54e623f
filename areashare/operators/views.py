"""Views on a measure table: coarser totals, latest period, area layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areashare.functions.scalars import missing_to_null, period_label, scale_clamp


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in ascending key order; for the output edge, not for reuse."""
    return df.orderBy(*keys)


def national_rollup(
    measure: DataFrame, period: str = "month", values: Sequence[str] = ("doacs",)
) -> DataFrame:
    """Totals per period over all areas.

    Ratios do not add up, so only ``values`` are summed. Rows without a period
    drop out and a period with nothing but missing values totals 0.
    """
    totals = [F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]
    return measure.where(F.col(period).isNotNull()).groupBy(period).agg(*totals)


def latest_period(measure: DataFrame, period: str = "month") -> DataFrame:
    """One row: the last period, NULL when there are no rows."""
    return measure.agg(F.max(period).alias(period))


def latest_period_rows(measure: DataFrame, period: str = "month") -> DataFrame:
    """Rows of the last period.

    ``measure`` is read twice, so hand in a written table. Its scan gets the
    last period as a filter and skips row groups of the others.
    """
    return measure.where(F.col(period) == latest_period(measure, period).scalar())


def latest_label(measure: DataFrame, period: str = "month") -> DataFrame:
    """One row: the last period and its caption."""
    return latest_period(measure, period).withColumn("label", period_label(F.col(period)))


def panel(flag: Column, inside: str = "london", outside: str = "rest") -> Column:
    """Name of the map panel an area belongs to."""
    return F.when(flag, inside).otherwise(outside)


def area_layer(
    areas: DataFrame,
    measure: DataFrame,
    vmin: float = 0,
    vmax: float = 100,
    *,
    period: str = "month",
    area: str = "pct",
    value: str = "perc_doacs",
    area_code: str = "code",
    split: str | None = "is_london",
) -> DataFrame:
    """Every area with its value in the last period, ready to be drawn.

    Areas without a value stay, with NULL. ``shade`` is the value on the scale
    vmin to vmax as 0 to 1. ``split`` names a boolean column that moves areas to
    a panel of their own.
    """
    latest = latest_period_rows(measure, period).select(
        F.col(area).alias("__area"), missing_to_null(F.col(value)).alias(value)
    )
    if split is not None:
        areas = areas.withColumn("panel", panel(F.col(split))).drop(split)
    return (
        areas.join(latest, F.col(area_code) == F.col("__area"), "left")
        .drop("__area")
        .withColumn("shade", scale_clamp(F.col(value), vmin, vmax))
    )


def write_panels(layer: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per panel."""
    layer.write.mode(mode).partitionBy("panel").parquet(path)


def replace_panels(layer: DataFrame, path: str) -> None:
    """Rewrite the panels that ``layer`` holds, and leave the folders of all others as they are."""
    layer.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("panel").parquet(path)


def read_panels(spark: SparkSession, path: str, *panels: str) -> DataFrame:
    """The layer as written; of some panels only, their folders alone are read."""
    layer = spark.read.parquet(path).withColumn("panel", F.col("panel").cast("string"))
    return layer.where(F.col("panel").isin(*panels)) if panels else layer
