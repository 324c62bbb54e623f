import datetime
import random

import numpy as np
import pytest
from helpers import plan
from pyspark.sql import functions as F

from areashare.operators import ALL_BANDS, DECILES, OUTER, percentile_bands

JAN, FEB = datetime.date(2012, 1, 1), datetime.date(2012, 2, 1)
SCHEMA = "month date, perc_doacs double"


def by_key(df):
    return {(r.month, r.percentile): r.perc_doacs for r in df.collect()}


def brute_force(data, points):
    found = {}
    for month in {m for m, v in data if m is not None and v is not None and v == v}:
        values = [v for m, v in data if m == month and v is not None and v == v]
        for p, q in zip(points, np.percentile(values, points)):
            found[(month, p)] = q
    return found


def test_point_sets():
    assert DECILES == (10, 20, 30, 40, 50, 60, 70, 80, 90)
    assert len(OUTER) == 18 and len(ALL_BANDS) == 27


def grouped(df, points=ALL_BANDS):
    """The same by Spark's own percentile, which holds a period in one buffer."""
    shares = ", ".join(f"{p / 100}D" for p in points)
    listed = ", ".join(map(str, points))
    values = df.where("month IS NOT NULL AND NOT isnan(perc_doacs)").groupBy("month")
    arrays = values.agg(F.expr(f"percentile(perc_doacs, array({shares}))").alias("vs"))
    return arrays.selectExpr("month", f"inline(arrays_zip(array({listed}), vs)) AS (percentile, perc_doacs)")


def test_hand_fixture(measure):
    found = by_key(percentile_bands(measure))
    assert len(found) == 2 * 27
    for p, expected in ((1, 0.3), (10, 3), (50, 15), (90, 27), (99, 29.7)):
        assert found[(JAN, p)] == pytest.approx(expected, abs=1e-12)
    assert {found[(FEB, p)] for p in ALL_BANDS} == {50.0}


def skewed(n, seed):
    """One month with most rows, one value with a third of them, all else close by."""
    rng = random.Random(seed)
    months = [JAN, FEB, datetime.date(2012, 3, 1), None]
    data = []
    for _ in range(n):
        month = JAN if rng.random() < 0.7 else rng.choice(months)
        value = 50.0 if rng.random() < 0.34 else 50 + rng.choice([1e-9, 1, 100]) * rng.random()
        data.append((month, rng.choice([value] * 20 + [None, float("nan")])))
    return data


@pytest.fixture
def many_partitions(spark):
    """Keep small shuffles apart, as large ones would be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("slice_rows", [1, 7, 65_536])
@pytest.mark.parametrize("n", [1, 2, 37, 4000])
def test_against_brute_force(spark, many_partitions, slice_rows, n):
    data = skewed(n, seed=n) + [(FEB, 3.5)]
    points = (0, *ALL_BANDS, 100)
    df = spark.createDataFrame(data, SCHEMA)
    found = by_key(percentile_bands(df, points=points, slice_rows=slice_rows))
    expected = brute_force(data, points)
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, rel=1e-12, abs=1e-12), key


def test_methods_agree(spark, many_partitions):
    df = spark.createDataFrame(skewed(3000, seed=5), SCHEMA)
    exact = by_key(percentile_bands(df, slice_rows=9))
    assert exact == pytest.approx(by_key(grouped(df)), rel=1e-12)


def test_bands_never_fall(spark):
    found = by_key(percentile_bands(spark.createDataFrame(skewed(3000, seed=6), SCHEMA), slice_rows=5))
    for month in {m for m, _ in found}:
        series = [found[(month, p)] for p in ALL_BANDS]
        assert all(b >= a - 1e-9 for a, b in zip(series, series[1:]))


def test_infinite_values(spark):
    df = spark.createDataFrame([(JAN, v) for v in (1.0, 2.0, float("inf"))], SCHEMA)
    found = by_key(percentile_bands(df, points=(0, 50, 90, 100)))
    assert found == {(JAN, 0): 1.0, (JAN, 50): 2.0, (JAN, 90): float("inf"), (JAN, 100): float("inf")}


def test_nothing_to_rank(spark):
    assert percentile_bands(spark.createDataFrame([(JAN, None)], SCHEMA)).collect() == []


def test_column_names(spark):
    df = spark.createDataFrame([(JAN, 1)], "rows date, slice int")
    found = percentile_bands(df, "rows", "slice", points=[50])
    assert found.columns == ["rows", "percentile", "slice"]


@pytest.mark.parametrize("points", [(), (101,), (-1,), (2.5,)])
def test_bad_points(spark, points):
    with pytest.raises(ValueError):
        percentile_bands(spark.createDataFrame([(JAN, 1.0)], SCHEMA), points=points)


def test_slices_are_cut_down_before_they_are_shuffled(spark):
    df = percentile_bands(spark.createDataFrame(skewed(3000, seed=9), SCHEMA), slice_rows=7)
    before, _, _ = plan(df).partition("Subqueries")
    assert "BroadcastHashJoin LeftSemi" in before and "SortMergeJoin LeftSemi" not in before


def test_nothing_is_ranked_in_one_task(spark):
    text = plan(percentile_bands(spark.createDataFrame(skewed(500, seed=8), SCHEMA)))
    assert "SinglePartition" not in text and "CartesianProduct" not in text
