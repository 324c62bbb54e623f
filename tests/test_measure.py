import datetime
import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from areashare.functions import CodeSet, as_percent, case_items, ieee_divide, period_date
from areashare.operators import ShareMeasure, duplicate_keys, require_unique
from areashare.plans.queries import BRAND_SHARE
from areashare.plans.report import DOAC_SHARE
from areashare.sources import staging

SF = "/root/testdata/sf0.001"
JAN, FEB = datetime.date(2012, 1, 1), datetime.date(2012, 2, 1)


def join_then_group(share, rx, areas):
    """The measure as its definition reads, row by row before any sum."""
    inside = F.substring(share.code, 1, share.denominator.length).isin(*share.denominator.codes)
    counted = F.substring(share.code, 1, share.numerator.length).isin(*share.numerator.codes)
    return (
        rx.join(areas, rx[share.area] == areas[share.area_code])
        .where(inside & (F.col("org_type") == share.area_type) & (F.col("month") >= share.since))
        .groupBy(period_date(F.col("month")).alias("month"), share.area)
        .agg(
            F.sum(case_items(counted, F.col("items"))).alias("doacs"),
            F.sum("items").alias("total"),
        )
        .withColumn("perc_doacs", as_percent(ieee_divide(F.col("doacs"), F.col("total"))))
        .drop("total")
    )


def test_hand_fixture(measure):
    assert rows(measure) == [
        (JAN, "A01", 30, 30.0),
        (JAN, "B02", 0, 0.0),
        (FEB, "A01", 50, 50.0),
        (FEB, "B02", 0, "NaN"),
        (FEB, "C03", None, None),
    ]


def test_declared_types(measure):
    assert measure.dtypes == [
        ("month", "date"), ("pct", "string"), ("doacs", "bigint"), ("perc_doacs", "double"),
    ]


def test_area_listed_twice_counts_twice(rx, areas):
    twice = areas.union(areas.where("code = 'A01'"))
    assert rows(DOAC_SHARE.build(rx, twice)) == rows(join_then_group(DOAC_SHARE, rx, twice))
    assert rows(DOAC_SHARE.build(rx, twice))[0] == (JAN, "A01", 60, 30.0)
    assert rows(duplicate_keys(twice, "code")) == [("A01", 2)]
    assert require_unique(areas, "code") is areas
    with pytest.raises(ValueError, match="1 repeated keys"):
        require_unique(twice, "code")


def test_one_area_with_a_third_of_the_rows(spark, areas):
    rng = random.Random(7)
    codes = [*DOAC_SHARE.denominator.codes, "0301010R0", "02080"]
    facts = []
    for _ in range(5000):
        area = "A01" if rng.random() < 0.4 else rng.choice(["B02", "C03", "D04", "X99", "Z00", None])
        day = datetime.datetime(2011, 11, 1) + datetime.timedelta(days=rng.randrange(0, 400))
        items = rng.choice([None, 0, 1, 5, -2])
        facts.append((day, area, rng.choice(codes) + "AAAAAA", items))
    rx = spark.createDataFrame(facts, "month timestamp_ntz, pct string, bnf_code string, items bigint")
    assert rows(DOAC_SHARE.build(rx, areas)) == rows(join_then_group(DOAC_SHARE, rx, areas))


def test_same_as_join_then_group_on_test_tables(spark):
    rx, areas = staging.prescribing(spark, SF), staging.areas(spark, SF)
    built = BRAND_SHARE.build(rx, areas)
    assert rows(built) == rows(join_then_group(BRAND_SHARE, rx, areas))
    assert built.count() == 694


def test_without_area_type_and_start(rx, areas):
    share = ShareMeasure(numerator=CodeSet.of("0208020X0"), denominator=DOAC_SHARE.denominator)
    found = rows(share.build(rx, areas))
    assert (datetime.date(2011, 12, 1), "A01", 0, 0.0) in found
    assert (JAN, "X99", 10, 100.0) in found


def test_numerator_within_denominator():
    whole = CodeSet.of("0208")
    ShareMeasure(numerator=CodeSet.of("0208020Z0"), denominator=whole)
    ShareMeasure(numerator=whole, denominator=CodeSet.of("0208020Z0"))
    with pytest.raises(ValueError, match="0301"):
        ShareMeasure(numerator=CodeSet.of("0301"), denominator=whole)


def test_properties(spark):
    share = BRAND_SHARE.build(staging.prescribing(spark, SF), staging.areas(spark, SF))
    assert share.where("perc_doacs < 0 OR perc_doacs > 100 OR perc_doacs IS NULL").isEmpty()
    sums = BRAND_SHARE.sums(staging.prescribing(spark, SF), staging.areas(spark, SF))
    assert sums.where("doacs > items").isEmpty()


def test_plan(spark):
    text = plan(BRAND_SHARE.build(staging.prescribing(spark, SF), staging.areas(spark, SF)))
    # Facts by period and area, areas by code; nothing after the join.
    assert text.count("hashpartitioning") == 2
    assert "GreaterThanOrEqual(p_brand,Brand#1)" in text
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)" in text
    assert "struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_plan_sums_before_it_joins_when_areas_are_many(spark):
    """Without any broadcast the facts still shuffle once, as partial sums."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rx = spark.read.schema(
            "month timestamp_ntz, pct bigint, bnf_code string, items bigint"
        ).parquet(f"{SF}/events.parquet")
        areas = spark.range(10).selectExpr("id AS code", "'CCG' AS org_type")
        text = plan(BRAND_SHARE.build(rx, areas))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text
    # Facts by period and area, their sums by area, areas by code.
    assert text.count("hashpartitioning") == 3
    tree = text[: text.index("(1) ")]
    assert tree.index("SortMergeJoin") < tree.index("HashAggregate")


def test_row_level_join_splits_a_hot_area(spark, tmp_path):
    """An area with a third of all facts is spread over several tasks by adaptive execution."""
    facts = spark.range(0, 60_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 1000 END AS pct", "uuid() AS text"
    )
    facts.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    areas = spark.range(1000).selectExpr("id AS code", "'CCG' AS org_type")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = facts.join(areas, facts["pct"] == areas["code"])
        assert len(joined.collect()) == 60_000
        text = plan(joined)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert "SortMergeJoin(skew=true)" in text
