import datetime

import numpy as np
import pytest
from helpers import plan
from pyspark.sql import functions as F

from areashare.operators import (
    merged_sketches,
    percentile_sketches,
    rank_bound,
    rank_errors,
    sketch_bands,
)

JAN, FEB = datetime.date(2012, 1, 1), datetime.date(2012, 2, 1)
SCHEMA = "month date, perc_doacs double"


def million(spark):
    """A hot month with a third of its rows on one value, another one with a long tail."""
    id = F.col("id")
    month = F.when(id % 3 == 0, F.lit(FEB)).otherwise(F.lit(JAN))
    value = F.when((id % 3 == 1), F.lit(50.0)).otherwise(F.exp(F.rand(7) * 20))
    return spark.range(1_000_000).select(month.alias("month"), value.alias("perc_doacs"))


def worst(errors):
    return errors.agg(F.max("error")).first()[0]


def test_ranks_are_within_the_bound_on_a_million_values(spark):
    df = million(spark)
    sketches = percentile_sketches(df)
    bands = sketch_bands(sketches)
    assert bands.count() == 54
    assert 0 < rank_bound() < 0.012
    assert worst(rank_errors(df, bands)) <= rank_bound()
    rows = {r.month: r.n for r in sketches.collect()}
    assert rows == {JAN: 666_666, FEB: 333_334}


def test_parts_merge_to_what_one_pass_has(spark):
    df = million(spark).withColumn("part", F.pmod(F.xxhash64("perc_doacs"), F.lit(5)))
    parts = percentile_sketches(df, by=["part"])
    months = merged_sketches(parts, "month")
    assert worst(rank_errors(df, sketch_bands(months))) <= rank_bound()
    whole = merged_sketches(parts, F.lit("all").alias("month"))
    assert whole.first().n == 1_000_000
    everything = df.withColumn("month", F.lit("all"))
    assert worst(rank_errors(everything, sketch_bands(whole))) <= rank_bound()


def test_a_coarser_sketch_is_worse_and_smaller(spark):
    df = million(spark)
    assert rank_bound(100) > 5 * rank_bound(800)
    size = lambda k: percentile_sketches(df, k=k).agg(F.max(F.length("sketch"))).first()[0]
    assert size(100) < size(800) < 40_000
    assert worst(rank_errors(df, sketch_bands(percentile_sketches(df, k=100)))) <= rank_bound(100)


def test_few_values_are_exact(spark):
    values = [float(v) for v in range(101)]
    rows = [(JAN, v) for v in values] + [(JAN, None), (JAN, float("nan")), (None, 1.0), (FEB, None)]
    sketches = percentile_sketches(spark.createDataFrame(rows, SCHEMA))
    assert [(r.month, r.n) for r in sketches.collect()] == [(JAN, 101)]
    found = {r.percentile: r.perc_doacs for r in sketch_bands(sketches, [0, 50, 100]).collect()}
    assert found == {0: 0.0, 50: 50.0, 100: 100.0}


def test_rank_errors_by_hand(spark):
    values = [1.0, 2.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(JAN, v) for v in values], SCHEMA)
    bands = spark.createDataFrame([(JAN, 50, 2.0), (JAN, 90, 2.0), (JAN, 10, 9.0)], "month date, percentile int, perc_doacs double")
    errors = {r.percentile: r.error for r in rank_errors(df, bands).collect()}
    assert errors[50] == 0 and errors[90] == pytest.approx(0.1) and errors[10] == pytest.approx(0.7)
    assert np.isclose(errors[90], 0.1)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert percentile_sketches(empty).isEmpty() and sketch_bands(percentile_sketches(empty)).isEmpty()
    with pytest.raises(ValueError):
        sketch_bands(percentile_sketches(empty), [101])


def test_values_are_sketched_before_the_shuffle(spark):
    text = plan(percentile_sketches(million(spark)))
    assert text.count("Exchange") and "partial_kll_sketch_agg_double" in text
