"""Percentiles of a value across areas, per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashare.functions.scalars import missing_to_null
from areashare.sources.storage import scratch_table

DECILES = tuple(range(10, 100, 10))
OUTER = (*range(1, 10), *range(91, 100))
ALL_BANDS = tuple(sorted((*DECILES, *OUTER)))

# Distinct values per slice: what has to be ranked around each wanted position. A
# period of a billion values has some 15,000 slices, whose sizes are added up.
SLICE_ROWS = 65_536

# p is the period, v a value, n how often it occurs, slice the run of the sorted
# values that it is in.
#
# Percentile k of m values sits at position k * (m - 1) / 100, counted from 0:
# between the value at the whole part and the next one, by the remainder. A slice
# knows how many values of its period come before it, hence which of the wanted
# positions it holds, and only slices that hold one are ranked.
TARGETS_SQL = """
WITH spans AS (
  SELECT p, slice, rows,
         sum(rows) OVER (PARTITION BY p ORDER BY slice) - rows AS before,
         sum(rows) OVER (PARTITION BY p) AS total
  FROM (SELECT p, slice, sum(n) AS rows FROM {sliced} GROUP BY p, slice)
),
positions AS (
  SELECT p, slice, rows, before, point,
         point * (total - 1) div 100 AS whole, point * (total - 1) % 100 AS part
  FROM (SELECT *, explode(array(POINTS)) AS point FROM spans)
),
targets AS (
  SELECT p, slice, point, part, rank - before AS rank
  FROM (SELECT *, explode(array_distinct(array(whole, whole + if(part > 0, 1, 0)))) AS rank
        FROM positions)
  WHERE rank >= before AND rank < before + rows
)
SELECT * FROM targets
"""

# Only slices that hold a target are shuffled: the targets are written first, so that their
# size, some slices per period, is known to the planner.
RANK_SQL = """
WITH ranked AS (
  SELECT p, slice, v, n, sum(n) OVER w AS upto
  FROM {sliced} LEFT SEMI JOIN {targets} USING (p, slice)
  WINDOW w AS (PARTITION BY p, slice ORDER BY v ROWS UNBOUNDED PRECEDING)
)
SELECT p, point, CASE WHEN low = high THEN low ELSE low + (high - low) * (part / 100) END AS v
FROM (
  SELECT p, point, min(v) AS low, max(v) AS high, max(part) AS part
  FROM ranked JOIN {targets} USING (p, slice)
  WHERE rank < upto AND rank >= upto - n
  GROUP BY p, point
)
"""


def percentile_bands(
    df: DataFrame,
    period: str = "month",
    value: str = "perc_doacs",
    points: Sequence[int] = ALL_BANDS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per period and percentile: (period, percentile, value).

    Missing values and rows without a period do not count. Between two ranks the
    value is interpolated linearly.

    The distinct values are sorted over all tasks, cut into slices and written to the shared
    folder; ranks are looked up there, so no task holds a whole period.
    """
    points = sorted(set(points))
    if not points or not all(isinstance(p, int) and 0 <= p <= 100 for p in points):
        raise ValueError(f"percentiles must be whole numbers from 0 to 100: {points}")
    present = df.select(
        F.col(period).alias("p"), missing_to_null(F.col(value).cast("double")).alias("v")
    ).where("p IS NOT NULL AND v IS NOT NULL")
    # A value that many areas share travels as one row with a count.
    cells = present.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"))
    listed = ", ".join(f"{p}L" for p in points)
    found = _by_rank(cells, listed, slice_rows)
    return found.select(
        F.col("p").alias(period), F.col("point").cast("int").alias("percentile"), F.col("v").alias(value)
    )


def _by_rank(cells: DataFrame, listed: str, slice_rows: int) -> DataFrame:
    # The id counts up within a partition and from one to the next, like the sort.
    numbered = (
        cells.repartitionByRange("p", "v")
        .sortWithinPartitions("p", "v")
        .withColumn("slice", F.expr(f"monotonically_increasing_id() div {slice_rows}"))
    )
    # The range bounds come from a sample and differ from run to run. Written
    # down, the slices are the same for every read.
    sliced = scratch_table(numbered, "ranks")
    spark = cells.sparkSession
    targets = spark.sql(TARGETS_SQL.replace("POINTS", listed), sliced=sliced)
    return spark.sql(RANK_SQL, sliced=sliced, targets=scratch_table(targets, "targets"))
