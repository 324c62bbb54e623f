import datetime
import math
import random

import pytest
from helpers import plan, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from areashare.functions import (
    CodeSet,
    code_prefix,
    ieee_divide,
    missing_to_null,
    parse_period,
    period_date,
    period_label,
    register_sql_functions,
    scale_clamp,
)

INF = float("inf")
NAN = float("nan")
DIVISIONS = [
    (1.0, 0.0, INF),
    (0.0, 0.0, NAN),
    (-1.0, 0.0, -INF),
    (None, 0.0, None),
    (0.0, None, None),
    (1.0, None, None),
    (NAN, 0.0, NAN),
    (1.0, NAN, NAN),
    (3.0, 2.0, 1.5),
    (INF, 0.0, INF),
    (INF, INF, NAN),
    (-INF, 0.0, -INF),
]


def same(a, b):
    if a is None or b is None:
        return a is b
    return a == b or (math.isnan(a) and math.isnan(b))


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_ieee_divide(spark, ansi):
    df = spark.createDataFrame(DIVISIONS, "x double, y double, expected double")
    register_sql_functions(spark)
    found = df.select(
        "x", "y", "expected",
        ieee_divide(F.col("x"), F.col("y")).alias("built"),
        F.expr("ieee_divide(x, y)").alias("from_sql"),
    )
    for row in found.collect():
        assert same(row.built, row.expected), row
        assert same(row.from_sql, row.expected), row


def test_ieee_divide_folded(spark):
    one = spark.range(1).select(ieee_divide(F.lit(0), F.lit(0)), ieee_divide(F.lit(2), F.lit(0)))
    nan, inf = one.first()
    assert math.isnan(nan) and inf == INF


def test_code_set_checks():
    with pytest.raises(ValueError):
        CodeSet.of()
    with pytest.raises(ValueError):
        CodeSet.of("")
    with pytest.raises(ValueError):
        CodeSet.of("0208020Z0", "0208020")
    joined = CodeSet.of("aa", "bb", "aa") | CodeSet.of("cc", "bb")
    assert joined.codes == ("aa", "bb", "cc") and joined.length == 2


@pytest.mark.parametrize("size", [1, 5, 32, 33, 200])
@pytest.mark.parametrize("start", ["", "02"])
def test_code_set_equals_prefix_in_list(spark, size, start):
    rng = random.Random(size)

    def code(n):
        return start + "".join(rng.choice("abcd%_") for _ in range(n))

    codes = CodeSet(tuple(code(4) for _ in range(size)))
    texts = [code(rng.randrange(0, 9)) for _ in range(2000)] + list(codes.codes)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "code string")
    col = F.col("code")
    got = df.select(
        codes.matches(col).alias("built"),
        code_prefix(col, codes.length).isin(*codes.codes).alias("plain"),
    )
    assert got.where(~F.col("built").eqNullSafe(F.col("plain"))).count() == 0
    assert got.where("built").count() >= len(codes)


def test_code_prefix_counts_from_the_start(spark):
    df = spark.createDataFrame([("0208020Z0AAAAAA",), ("02",), (None,)], "code string")
    found = df.select(code_prefix(F.col("code"), 9)).collect()
    assert [r[0] for r in found] == ["0208020Z0", "02", None]


def test_periods(spark):
    when = datetime.datetime(2019, 12, 17, 23, 59)
    df = spark.createDataFrame([(when,), (None,)], "t timestamp_ntz")
    found = df.select(
        period_date(F.col("t")), period_date(F.col("t"), "day"), period_label(F.col("t"))
    ).collect()
    assert tuple(found[0]) == (datetime.date(2019, 12, 1), when.date(), "December 2019")
    assert tuple(found[1]) == (None, None, None)


def test_parse_period(spark, ansi):
    good = spark.createDataFrame([("2012-01-01",), ("2012-02-03 04:05:06",), (None,)], "s string")
    assert [r[0] for r in good.select(parse_period(F.col("s"))).collect()] == [
        datetime.datetime(2012, 1, 1),
        datetime.datetime(2012, 2, 3, 4, 5, 6),
        None,
    ]
    bad = spark.createDataFrame([("2012-13-01",)], "s string")
    assert bad.select(parse_period(F.col("s"), lenient=True)).first()[0] is None
    with pytest.raises(PySparkException, match="not a timestamp: 2012-13-01"):
        bad.select(parse_period(F.col("s"))).collect()


def test_scale_clamp(spark):
    values = [(-5.0,), (0.0,), (25.0,), (100.0,), (150.0,), (INF,), (-INF,), (NAN,), (None,)]
    df = spark.createDataFrame(values, "v double")
    found = [r[0] for r in df.select(scale_clamp(F.col("v"), 0, 100)).collect()]
    assert found == [0.0, 0.0, 0.25, 1.0, 1.0, 1.0, 0.0, None, None]
    with pytest.raises(ValueError):
        scale_clamp(F.col("v"), 5, 5)


def test_missing_to_null(spark):
    df = spark.createDataFrame([(NAN,), (None,), (1.0,), (INF,)], "v double")
    assert rows(df.select(missing_to_null(F.col("v")))) == [(None,), (None,), (1.0,), (INF,)]


@pytest.mark.parametrize("n", [1, 5, 33, 2000])
def test_code_sets_of_any_length_are_pushed(spark, tmp_path, n):
    codes = [f"{chr(ord('A') + i % 25)}{i:04d}" for i in range(n)]
    data = [None, "", "A", "A0000", "A0000x", "é0000", "Z9999", "A000\u00e9", *(c + "tail" for c in codes[::7])]
    path = str(tmp_path / "t")
    spark.createDataFrame([(d,) for d in data], "code string").write.parquet(path)
    df = spark.read.parquet(path)
    chosen = df.where(CodeSet.of(*codes).matches(F.col("code")))
    assert "GreaterThanOrEqual(code," in plan(chosen)
    assert rows(chosen) == rows(df.where(F.substring("code", 1, 5).isin(codes)))


def test_unknown_grain(spark):
    with pytest.raises(ValueError, match="monthly"):
        period_date(F.col("month"), "monthly")
