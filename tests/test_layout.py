"""Footers, clustered copies and buckets: same rows, and what the plans read and shuffle."""

import datetime

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from areashare.functions import PrefixSet
from areashare.operators import latest_period_rows
from areashare.plans.report import DOAC_SHARE
from areashare.sources import (
    cell_sums,
    footer_maximum,
    latest_in,
    latest_rows_in,
    write_bucketed,
    write_clustered,
)


def scanned(df):
    """Rows that the scan of a collected frame put out."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(n)


def test_the_last_period_comes_from_the_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(50_000).select(
        F.date_add(F.lit(day(0)), (F.col("id") / 500).cast("int")).alias("month"), F.col("id").alias("v")
    )
    table.repartitionByRange(5, "month").write.parquet(path)
    found = footer_maximum(spark, path)
    # The scan puts out one row per file. The setting is of the session of its own.
    found.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    assert "PushedAggregation: [MAX(month)]" in plan(found)
    assert scanned(found) == 5
    assert found.first()[0] == day(99) == latest_in(spark, path)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    latest = latest_rows_in(spark, path)
    assert rows(latest) == rows(latest_period_rows(spark.read.parquet(path))) and latest.count() == 500
    assert "subquery" not in plan(latest).lower() and scanned(latest) < 50_000 / 4


def test_without_footers_that_tell_the_column_is_read(spark, tmp_path):
    cases = {
        "plain": ("month date, v int", [(day(1), 1), (day(3), 2), (None, 3)], day(3), {}),
        "bare": ("month date, v int", [(day(1), 1), (day(3), 2)], day(3), {"parquet.column.statistics.enabled": "false"}),
        "nulls": ("month date, v int", [(None, 1), (None, 2)], None, {}),
        "none": ("month date, v int", [], None, {}),
        "text": ("month string, v int", [("x" * 99 + "a", 1), ("x" * 99 + "b", 2)], "x" * 99 + "b", {}),
        "moment": ("month timestamp_ntz, v int", [(datetime.datetime(2020, 5, 1), 1)], datetime.datetime(2020, 5, 1), {}),
        "number": ("month int, v int", [(3, 1), (-4, 2)], 3, {}),
    }
    for name, (schema, data, last, options) in cases.items():
        path = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.options(**options).parquet(path)
        assert latest_in(spark, path) == last, name
        assert [r.month for r in latest_rows_in(spark, path).collect()] == ([] if last is None else [last]), name
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        latest_in(spark, str(tmp_path / "nowhere"))


def test_a_clustered_copy_is_pruned_by_period_and_code(spark, tmp_path):
    n, path = 200_000, str(tmp_path / "t")
    scattered = F.pmod(F.xxhash64("id"), F.lit(100))
    facts = spark.range(n).select(
        F.date_add(F.lit(day(0)), scattered.cast("int")).alias("month"),
        # One code with a third of all rows.
        F.when(F.col("id") % 3 == 0, "00").otherwise(F.format_string("%02d", F.col("id") % 97)).alias("bnf_code"),
        F.col("id").alias("items"),
    )
    write_clustered(facts, path, files=8, row_group_bytes=64 * 1024)
    copy = spark.read.parquet(path)
    assert copy.agg(F.count("*"), F.sum("items"), F.bit_xor(F.xxhash64("*"))).first() == facts.agg(
        F.count("*"), F.sum("items"), F.bit_xor(F.xxhash64("*"))
    ).first()
    period, code = F.col("month") >= F.lit(day(95)), PrefixSet.of("9").matches(F.col("bnf_code"))
    late = copy.where(period)
    assert late.count() == facts.where(period).count() and scanned(late) < n / 6
    both = copy.where(F.col("month") == F.lit(day(40))).where(code)
    assert rows(both) == rows(facts.where(F.col("month") == F.lit(day(40))).where(code)) and scanned(both) < n / 20
    held = copy.groupBy(F.input_file_name()).count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < n / 4


def test_a_hot_value_fills_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    facts = spark.range(30_000).select(F.lit(day(0)).alias("month"), F.lit("a").alias("bnf_code"), F.col("id").alias("items"))
    write_clustered(facts, path, files=6)
    held = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(held) == 6 and max(r["count"] for r in held) < 10_000


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_sums_in_buckets_need_no_shuffle(spark, rx, areas, tmp_path, no_broadcast):
    doubled = rx.unionAll(rx).unionAll(rx.where("items IS NULL"))
    write_bucketed(cell_sums(doubled), "facts_by_area", str(tmp_path / "facts"), "pct", 4, ("month", "bnf_code"))
    write_bucketed(areas, "areas_by_code", str(tmp_path / "areas"), "code", 4)
    facts, members = spark.table("facts_by_area"), spark.table("areas_by_code")
    measure = DOAC_SHARE.build(facts, members)
    assert rows(measure) == rows(DOAC_SHARE.build(doubled, areas))
    text = plan(measure)
    assert "Exchange" not in text and "SortMergeJoin" in text and "SelectedBucketsCount: 4 out of 4" in text
    assert "Exchange" in plan(DOAC_SHARE.build(doubled, areas))
    one = facts.where("pct = 'A01'")
    assert rows(one.drop("items")) == rows(cell_sums(rx).where("pct = 'A01'").drop("items"))
    for name in ("facts_by_area", "areas_by_code"):
        spark.sql(f"DROP TABLE {name}")


def test_empty_tables(spark, rx, tmp_path):
    none = rx.limit(0)
    write_clustered(none, str(tmp_path / "c"))
    assert spark.read.schema(rx.schema).parquet(str(tmp_path / "c")).count() == 0
    write_bucketed(cell_sums(none), "no_facts", str(tmp_path / "b"), "pct", 4)
    assert spark.table("no_facts").count() == 0
    spark.sql("DROP TABLE no_facts")
