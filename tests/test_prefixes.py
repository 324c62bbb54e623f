"""Prefix sets: membership, ranges, and what the scan reads for them."""

import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from areashare.functions import PrefixSet
from areashare.functions.prefixes import after_prefix

TOP = chr(0x10FFFF)


def test_the_text_after_a_prefix():
    assert after_prefix("ab") == "ac" and after_prefix("a" + TOP) == "b"
    assert after_prefix(TOP) is None and after_prefix("퟿") == ""


def test_codes_under_a_shorter_one_are_left_out():
    assert PrefixSet.of("ab", "a", "abc", "b", "a").codes == ("a", "b")
    assert (PrefixSet.of("ab") | PrefixSet.of("a")).codes == ("a",)
    for bad in ((), ("a", "")):
        with pytest.raises(ValueError):
            PrefixSet(bad)


def test_ranges():
    some = PrefixSet.of("a1", "a2", "b", "k", "l0", TOP)
    assert some.ranges() == [("a1", "a3"), ("b", "c"), ("k", "l"), ("l0", "l1"), (TOP, None)]
    # The smallest gaps are closed first.
    assert some.ranges(4) == [("a1", "a3"), ("b", "c"), ("k", "l1"), (TOP, None)]
    assert some.ranges(3) == [("a1", "c"), ("k", "l1"), (TOP, None)]
    assert some.ranges(1) == [("a1", None)]


def test_membership_against_brute_force(spark):
    rng = random.Random(4)
    letters = "abé" + TOP + "퟿0"
    text = lambda low: "".join(rng.choices(letters, k=rng.randint(low, 4)))
    values = [None, *{text(0) for _ in range(600)}]
    df = spark.createDataFrame([(v,) for v in values], "code string").cache()
    for n in (1, 3, 40):
        codes = [text(1) for _ in range(n)]
        some = PrefixSet.of(*codes)
        for pushed in (1, 2, 16):
            found = df.select("code", some.matches(F.col("code"), pushed).alias("m")).collect()
            for r in found:
                assert r.m == (None if r.code is None else r.code.startswith(tuple(codes)))
            ranges = some.ranges(pushed)
            assert len(ranges) <= pushed and ranges == sorted(ranges)
            assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def rows_read(df):
    """Rows that the scan of a collected frame put out."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_distant_codes_read_their_own_row_groups(spark, tmp_path):
    path, n = str(tmp_path / "t"), 200_000
    facts = spark.range(n).select(F.format_string("%06d", "id").alias("code"), F.col("id").alias("items"))
    facts.coalesce(1).write.option("parquet.block.size", 64 * 1024).parquet(path)
    df = spark.read.parquet(path)
    assert rows_read(df) == n
    ends = df.where(PrefixSet.of("00001", "1999").matches(F.col("code")))
    assert rows_read(ends) < n / 4 and ends.count() == 10 + 100
    one_range = df.where(PrefixSet.of("00001", "1999").matches(F.col("code"), pushed=1))
    assert rows_read(one_range) > n / 2 and rows(one_range) == rows(ends)
    many = PrefixSet.of(*(f"{i:04d}" for i in range(0, 2000, 7)))
    assert plan(df.where(many.matches(F.col("code")))).count("GreaterThanOrEqual(code,") <= 16
