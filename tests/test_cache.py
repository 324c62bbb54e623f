import datetime
import os

import pytest
from helpers import rows
from pyspark.errors import PySparkException

from areashare.sources import (
    AREA_SCHEMA,
    MEASURE_SCHEMA,
    ResultCache,
    cached_read,
    fingerprint,
    read_areas,
    read_own_text,
    read_prescribing,
    read_text_table,
    scratch_table,
    shared_folder,
    write_text_table,
)

DAY = datetime.date(2012, 1, 1)
CODES = ["0E1", "0208020", " 12", "12 ", "a,b", 'say "x"', "back\\slash", "", None, "NULL", "NaN", "é"]


class Counted:
    """A build that counts how often its rows were computed."""

    def __init__(self, spark, n=3):
        self.spark, self.n, self.runs = spark, n, 0

    def __call__(self):
        self.runs += 1
        return self.spark.range(self.n)


def test_reuse_and_invalidation(spark, tmp_path):
    cache = ResultCache(str(tmp_path / "c"))
    build = Counted(spark)
    first = cache.get(spark, "spec", build)
    assert rows(first) == rows(cache.get(spark, "spec", build)) == [(0,), (1,), (2,)]
    assert build.runs == 1
    cache.get(spark, "other spec", build)
    assert build.runs == 2
    build.n = 5
    refreshed = cache.get(spark, "spec", build, refresh=True)
    assert refreshed.count() == 5 and first.count() == 3
    assert cache.get(spark, "spec", build).count() == 5
    assert build.runs == 3


def test_changed_input_rebuilds(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    cache = ResultCache(str(tmp_path / "c"))

    def get():
        return cache.get(spark, "spec", lambda: spark.read.parquet(source), inputs=[source])

    assert get().count() == 3
    before = fingerprint(spark, "spec", [source])
    assert before == fingerprint(spark, "spec", [source]) != fingerprint(spark, "spec")
    spark.range(4).write.mode("append").parquet(source)
    assert before != fingerprint(spark, "spec", [source])
    assert get().count() == 7


def test_unfinished_build_is_not_read(spark, tmp_path):
    cache = ResultCache(str(tmp_path / "c"))
    build = Counted(spark)
    cache.get(spark, "spec", build)
    (folder,) = os.listdir(tmp_path / "c")
    os.remove(tmp_path / "c" / folder / "_SUCCESS")
    cache.get(spark, "spec", build)
    assert build.runs == 1
    for name in os.listdir(tmp_path / "c" / folder / "_manifest"):
        os.remove(tmp_path / "c" / folder / "_manifest" / name)
    cache.get(spark, "spec", build)
    assert build.runs == 2


def test_equal_length_replacement_in_a_nested_folder_rebuilds(spark, tmp_path):
    source = tmp_path / "source"
    (source / "part=1").mkdir(parents=True)
    (source / "part=1" / "a.txt").write_text("77")
    cache = ResultCache(str(tmp_path / "c"))

    def get():
        return cache.get(spark, "spec", lambda: spark.read.text(str(source)), inputs=[str(source)])

    assert rows(get().select("value")) == [("77",)]
    (source / "part=1" / "a.txt").write_text("99")
    os.utime(source / "part=1" / "a.txt", (2_000_000_000, 2_000_000_000))
    assert rows(get().select("value")) == [("99",)]


def test_a_kept_text_needs_no_source(spark, tmp_path):
    spark.sql("SELECT 1 AS n, timestamp'2012-01-01 00:00:00.123456' AS t").createOrReplaceTempView("gone")
    path = str(tmp_path / "c")
    first = rows(cached_read(spark, "SELECT * FROM gone", path, format="csv"))
    spark.catalog.dropTempView("gone")
    again = cached_read(spark, "SELECT * FROM gone", path, format="csv")
    assert rows(again) == first and again.dtypes == [("n", "int"), ("t", "timestamp")]


def test_a_supplied_text_becomes_the_kept_result(spark, tmp_path, measure):
    (tmp_path / "made_up.csv").write_text("month,pct,doacs,perc_doacs\n2012-01-01,0E1,3,50.0\n")
    cache = ResultCache(str(tmp_path / "c"), "csv")
    cache.adopt(spark, "spec", str(tmp_path / "made_up.csv"), MEASURE_SCHEMA)
    found = cache.get(spark, "spec", lambda: pytest.fail("built"))
    assert rows(found) == [(DAY, "0E1", 3, 50.0)]


def test_failed_build_leaves_nothing_to_read(spark, tmp_path):
    cache = ResultCache(str(tmp_path / "c"))
    with pytest.raises(PySparkException):
        cache.get(spark, "spec", lambda: spark.sql("SELECT raise_error('stop') AS x"))
    assert cache.newest(spark, fingerprint(spark, "spec")) is None


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_cached_read(spark, tmp_path, format):
    spark.range(4).createOrReplaceTempView("numbers")
    sql = "SELECT id, cast(id AS string) AS code, DATE '2012-01-01' AS month FROM numbers"
    path = str(tmp_path / "c")
    first = cached_read(spark, sql, path, format=format)
    assert first.dtypes == [("id", "bigint"), ("code", "string"), ("month", "date")]
    spark.range(6).createOrReplaceTempView("numbers")
    assert rows(cached_read(spark, sql, path, format=format)) == rows(first)
    assert cached_read(spark, sql, path, cache=False, format=format).count() == 6
    assert cached_read(spark, sql, path, format=format).count() == 6


def test_unknown_format(tmp_path):
    with pytest.raises(ValueError):
        ResultCache(str(tmp_path), "orc")


def test_text_round_trip_keeps_every_value(spark, tmp_path):
    shares = [0.1, float("nan"), float("inf"), float("-inf"), None, 1 / 3, 1e300]
    data = [(DAY, code, i, shares[i % len(shares)]) for i, code in enumerate(CODES)]
    df = spark.createDataFrame([*data, (None, "x", None, None)], MEASURE_SCHEMA)
    path = str(tmp_path / "t")
    write_text_table(df, path)
    back = read_own_text(spark, path, MEASURE_SCHEMA)
    assert back.dtypes == df.dtypes
    assert rows(back) == rows(df)


ODD = ["a", None, "", "one\ntwo", "\r\n", "\\n", "\\", "\\\\n", "\\N", "\x00", "\u0000a", '"', "a,b", " ", "\t", "\u00a0"]


@pytest.mark.parametrize("columns", [1, 2])
def test_own_text_keeps_rows_and_line_breaks(spark, tmp_path, columns):
    schema = "s string" if columns == 1 else "s string, t string"
    df = spark.createDataFrame([(text, text)[:columns] for text in ODD], schema)
    write_text_table(df, str(tmp_path / "t"))
    assert rows(read_own_text(spark, str(tmp_path / "t"), df.schema)) == rows(df)
    kept = ResultCache(str(tmp_path / "c"), "csv")
    for _ in range(2):
        assert rows(kept.get(spark, "spec", lambda: df)) == rows(df)


def test_own_text_keeps_moments(spark, tmp_path):
    df = spark.sql(
        "SELECT timestamp'2012-01-01 00:00:00.123456' AS t, timestamp_ntz'2012-01-01 00:00:00.123456' AS u,"
        " 12.50BD AS d, true AS b, float('nan') AS f"
    )
    write_text_table(df, str(tmp_path / "t"))
    back = read_own_text(spark, str(tmp_path / "t"), df.schema)
    assert back.dtypes == df.dtypes and rows(back) == rows(df)


def test_own_text_refuses_nested_values(spark, tmp_path):
    with pytest.raises(ValueError, match="array"):
        write_text_table(spark.sql("SELECT array(1) AS a"), str(tmp_path / "t"))


def test_text_that_does_not_fit_is_an_error(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("not a day", "A")], "month string, pct string").write.csv(path, header=True)
    with pytest.raises(Exception, match="MALFORMED_RECORD|not a day"):
        read_text_table(spark, path, "month date, pct string").collect()


def test_text_with_other_columns_is_an_error(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("A", 1)], "pct string, month int").write.csv(path, header=True)
    with pytest.raises(Exception, match="header does not conform"):
        read_text_table(spark, path, "month int, pct string").collect()


def test_line_breaks_in_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('s,n\n"one\ntwo",1\nthree,2\n')
    found = read_text_table(spark, str(tmp_path / "t.csv"), "s string, n int", multiline=True)
    assert rows(found) == [("one\ntwo", 1), ("three", 2)]


def test_read_sources(spark, tmp_path, rx, areas):
    facts, dims = str(tmp_path / "rx"), str(tmp_path / "areas")
    rx.withColumnRenamed("month", "processing_date").write.parquet(facts)
    areas.write.csv(dims, header=True)
    found = read_prescribing(spark, facts, renames={"month": "processing_date"})
    assert rows(found) == rows(rx)
    assert rows(read_areas(spark, dims, format="csv")) == rows(areas)
    areas.createOrReplaceTempView("area_list")
    assert rows(read_areas(spark, "area_list", format="table")) == rows(areas)
    assert read_areas(spark, dims, format="csv").schema == AREA_SCHEMA
    with pytest.raises(ValueError):
        read_areas(spark, dims, format="orc")
    rx.withColumn("items", rx.items.cast("int")).write.parquet(facts + "-narrow")
    assert read_prescribing(spark, facts + "-narrow").schema["items"].dataType.simpleString() == "bigint"
    rx.withColumn("items", rx.items.cast("double")).write.parquet(facts + "-wide")
    with pytest.raises(ValueError, match="items is double"):
        read_prescribing(spark, facts + "-wide")


def test_scratch_table_is_in_the_shared_folder(spark):
    kept = scratch_table(spark.range(3), "test")
    assert rows(kept) == [(0,), (1,), (2,)]
    assert all(shared_folder(spark) in name for name in kept.inputFiles())
