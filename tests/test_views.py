import datetime
import os

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from areashare.operators import (
    area_layer,
    latest_label,
    latest_period_rows,
    national_rollup,
    ordered,
    write_panels,
)
from areashare.plans.report import DOAC_SHARE, share_report
from areashare.sources import MEASURE_SCHEMA

JAN, FEB = datetime.date(2012, 1, 1), datetime.date(2012, 2, 1)
LAYER = [
    ("A01", "Alpha", "CCG", "london", 50.0, 0.5),
    ("B02", "Beta", "CCG", "rest", None, None),
    ("C03", "Gamma", "CCG", "rest", None, None),
    ("D04", "Delta", "CCG", "rest", None, None),
]


def test_national_rollup(spark, measure):
    assert rows(national_rollup(measure)) == [(JAN, 30), (FEB, 50)]
    odd = spark.createDataFrame([(None, "A", 5, 1.0), (JAN, "A", None, None)], MEASURE_SCHEMA)
    assert rows(national_rollup(odd)) == [(JAN, 0)]


def test_rollup_equals_sum_over_areas(measure):
    assert national_rollup(measure).agg(F.sum("doacs")).first()[0] == 80


def test_latest(spark, measure):
    assert rows(latest_label(measure)) == [(FEB, "February 2012")]
    assert [r[1] for r in rows(latest_period_rows(measure))] == ["A01", "B02", "C03"]
    empty = spark.createDataFrame([], MEASURE_SCHEMA)
    assert rows(latest_label(empty)) == [(None, None)]
    assert rows(latest_period_rows(empty)) == []


def test_latest_period_reaches_the_scan(measure):
    assert "EqualTo(month,ScalarSubquery" in plan(latest_period_rows(measure))


def test_area_layer(spark, measure, areas):
    assert rows(area_layer(DOAC_SHARE.members(areas), measure)) == LAYER
    empty = spark.createDataFrame([], MEASURE_SCHEMA)
    found = rows(area_layer(DOAC_SHARE.members(areas), empty))
    assert [(r[0], r[4], r[5]) for r in found] == [(c, None, None) for c in ("A01", "B02", "C03", "D04")]


def test_area_layer_without_panels(measure, areas):
    layer = area_layer(areas, measure, split=None)
    assert layer.columns == ["code", "name", "org_type", "is_london", "perc_doacs", "shade"]


def test_ordered(measure):
    found = [(r.month, r.pct) for r in ordered(measure, "month", "pct").collect()]
    assert found == [(JAN, "A01"), (JAN, "B02"), (FEB, "A01"), (FEB, "B02"), (FEB, "C03")]


def test_write_panels(spark, measure, areas, tmp_path):
    target = str(tmp_path / "layer")
    write_panels(area_layer(DOAC_SHARE.members(areas), measure), target)
    assert sorted(n for n in os.listdir(target) if n.startswith("panel")) == [
        "panel=london", "panel=rest",
    ]
    assert rows(spark.read.parquet(target).where("panel = 'london'").select("code")) == [("A01",)]


def test_report(spark, rx, areas, measure, tmp_path):
    path, facts, dims = (str(tmp_path / name) for name in ("report", "rx", "areas"))
    rx.write.parquet(facts)
    areas.write.parquet(dims)
    rx, areas = spark.read.parquet(facts), spark.read.parquet(dims)
    report = share_report(spark, DOAC_SHARE, rx, areas, path, inputs=[facts, dims])
    assert rows(report.measure) == rows(measure)
    assert rows(report.trend) == [(JAN, 30), (FEB, 50)]
    assert rows(report.latest) == [(FEB, "February 2012")]
    assert rows(report.layer) == LAYER
    assert rows(report.bands.where("percentile = 50")) == [(JAN, 50, 15.0), (FEB, 50, 50.0)]
    again = share_report(spark, DOAC_SHARE, rx.limit(0), areas, path, inputs=[facts, dims])
    assert rows(again.measure) == rows(measure)
    other = str(tmp_path / "other")
    rx.withColumn("items", rx.items * 100).write.parquet(other)
    more = share_report(spark, DOAC_SHARE, spark.read.parquet(other), areas, path, inputs=[other, dims])
    assert rows(more.trend) == [(JAN, 3000), (FEB, 5000)]
    with pytest.raises(TypeError):
        share_report(spark, DOAC_SHARE, rx, areas, path)


@pytest.mark.parametrize("column", ["month", "pct"])
def test_missing_column_is_an_error(measure, column):
    with pytest.raises(Exception, match=column):
        latest_period_rows(measure.drop("month")) if column == "month" else area_layer(
            measure, measure.drop("pct"), area_code="doacs"
        ).collect()
