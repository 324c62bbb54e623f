import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from areashare.operators import (
    TextRule,
    assert_snapshot,
    bucket_digests,
    compare_texts,
    differing_buckets,
    digest_diff,
    load_rules,
    sanitise_text,
    snapshot_diff,
    snapshot_except_all,
)
from areashare.operators.digests import bucket_of

SCHEMA = "k string, v double, note string"
NAN = float("nan")


def table(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


@pytest.fixture
def saved(spark):
    return table(spark, ("a", 1.0, "x"), ("b", NAN, "x"), ("c", None, "x"), ("d", 4.0, "x"), (None, 5.0, "x"))


@pytest.fixture
def current(spark):
    return table(spark, ("a", 1.0, "x"), ("b", NAN, "x"), ("c", 3.0, "x"), ("e", 4.0, "x"), (None, 6.0, "x"))


def test_sanitise(spark):
    text = "obj at 0x7f3a2b1c9d10 id 123e4567-e89b-12d3-a456-426614174000 0x7f3a"
    df = spark.createDataFrame([(text * 2, text), (None, "")], "a string, b string")
    clean = "obj at <memory_address> id <uuid> 0x7f3a"
    first, second = sanitise_text(df, "a", "b").collect()
    # Where two texts meet, "0x7f3aobj" ends at a letter and matches no rule.
    assert tuple(first) == (clean * 2, clean) and tuple(second) == (None, "")


def test_sanitise_in_order_and_literally(spark):
    rules = [TextRule("one", "a+", "b$1"), TextRule("two", "b", r"\c")]
    df = spark.createDataFrame([("xaa",)], "t string")
    assert sanitise_text(df, "t", rules=rules).first()[0] == r"x\c$1"


def test_load_rules(spark, tmp_path):
    path = tmp_path / "rules.conf"
    path.write_text("[year]\nregex: \\b20[0-9]{2}\\b\nreplace: <year>\n\n[percent]\nregex: %\nreplace: pc\n")
    rules = load_rules(str(path))
    assert [r.name for r in rules] == ["year", "percent"]
    df = spark.createDataFrame([("5% in 2019 and 2020",)], "t string")
    assert sanitise_text(df, "t", rules=rules).first()[0] == "5pc in <year> and <year>"


def test_diff(current, saved):
    found = rows(snapshot_diff(current, saved, ["k"]).drop("saved_note", "current_note"))
    assert found == [
        (None, "changed", 1, 1, 5.0, 6.0),
        ("c", "changed", 1, 1, None, 3.0),
        ("d", "missing", 1, 0, 4.0, None),
        ("e", "unexpected", 0, 1, None, 4.0),
    ]


def test_same_tables_have_no_diff(saved):
    assert snapshot_diff(saved, saved, ["k"]).isEmpty()
    assert snapshot_except_all(saved, saved).isEmpty()


def test_column_order_does_not_matter(saved):
    assert snapshot_diff(saved.select("note", "k", "v"), saved, ["k"]).isEmpty()


def test_repeated_keys_are_bags(spark):
    left = table(spark, ("a", 1.0, "x"), ("a", 1.0, "x"), ("a", 2.0, "x"))
    right = table(spark, ("a", 2.0, "x"), ("a", 1.0, "x"), ("a", 1.0, "x"))
    assert snapshot_diff(left, right, ["k"]).isEmpty()
    fewer = table(spark, ("a", 1.0, "x"), ("a", 2.0, "x"))
    assert rows(snapshot_diff(fewer, left, ["k"]).select("k", "status", "saved_rows", "current_rows")) == [
        ("a", "changed", 1, 0)
    ]


def test_every_unmatched_row_of_a_repeated_key(spark):
    saved = table(spark, ("a", 1.0, "x"), ("a", 2.0, "x"), ("a", 3.0, "x"), ("b", 1.0, "x"))
    current = table(spark, ("a", 1.0, "x"), ("a", 9.0, "x"), ("c", 1.0, "x"), ("c", 2.0, "x"))
    found = snapshot_diff(current, saved, ["k"]).drop("saved_note", "current_note")
    assert rows(found) == rows(
        spark.createDataFrame(
            [
                ("a", "changed", 1, 1, 2.0, 9.0),
                ("a", "changed", 1, 0, 3.0, None),
                ("b", "missing", 1, 0, 1.0, None),
                ("c", "unexpected", 0, 1, None, 1.0),
                ("c", "unexpected", 0, 1, None, 2.0),
            ],
            found.schema,
        )
    )


def test_texts_are_cleaned_before_they_are_compared(spark):
    schema = "k int, kind string, text string"
    saved = [(1, "out", "at 0x7f3a2b1c9d10"), (2, "stderr", "a"), (3, "out", "b"), (4, None, "c")]
    current = [(1, "out", "at 0x7f3a2b1c9d11"), (2, "stderr", "z"), (3, "out", "y"), (4, None, "c")]
    sides = [spark.createDataFrame(side, schema) for side in (current, saved)]
    assert rows(compare_texts(*sides, keys=["k", "kind"]).select("k", "status")) == [(3, "changed")]
    with pytest.raises(ValueError, match="nothing to compare"):
        compare_texts(*[side.where("k = 2") for side in sides], keys=["k"])


def test_except_all_counts_copies(spark):
    hot = spark.range(3000).selectExpr("'hot' AS k", "1.0D AS v", "'x' AS note")
    left = hot.union(table(spark, ("a", 1.0, "x")))
    right = hot.limit(2990).union(table(spark, ("b", 1.0, "x")))
    assert rows(snapshot_except_all(left, right)) == [
        ("a", 1.0, "x", 0, 1),
        ("b", 1.0, "x", 1, 0),
        ("hot", 1.0, "x", 2990, 3000),
    ]


def test_ignore(current, saved):
    other = saved.withColumn("note", F.lit("y"))
    assert snapshot_diff(saved, other, ["k"]).count() == 5
    assert snapshot_diff(saved, other, ["k"], ignore_columns=["note"]).isEmpty()
    found = snapshot_diff(current, saved, ["k"], ignore_where="k IN ('c', 'd', 'e')")
    assert rows(found.select("k", "status")) == [(None, "changed")]
    kept = snapshot_except_all(current, saved, ignore_where=F.col("v") > 3.5)
    assert rows(kept.select("k")) == [("c",), ("c",)]


def test_only_keys(spark):
    left, right = table(spark, ("a", 1.0, "x")).select("k"), table(spark, ("b", 1.0, "x")).select("k")
    assert rows(snapshot_diff(left, right, ["k"])) == [("a", "unexpected", 0, 1), ("b", "missing", 1, 0)]


def test_different_columns_are_an_error(saved):
    with pytest.raises(ValueError, match="columns differ"):
        snapshot_except_all(saved, saved.withColumn("v", F.col("v").cast("string")))
    with pytest.raises(ValueError, match="columns differ"):
        snapshot_diff(saved.drop("v"), saved, ["k"])


def test_reserved_names_are_an_error(saved):
    odd = saved.withColumnRenamed("note", "saved_rows")
    with pytest.raises(ValueError, match="saved_rows"):
        snapshot_except_all(odd, odd)


def test_assert_snapshot(current, saved):
    assert_snapshot(saved, saved, ["k"])
    with pytest.raises(AssertionError, match="2 changed, 1 missing, 1 unexpected"):
        assert_snapshot(current, saved, ["k"])
    with pytest.raises(ValueError, match="nothing to compare"):
        assert_snapshot(saved, saved, ["k"], ignore_where="true")
    with pytest.raises(AssertionError, match="5 unexpected"):
        assert_snapshot(saved, saved.limit(0), ["k"])


def as_rows(df):
    return rows(df.select(*sorted(df.columns)))


def test_a_hot_key_is_numbered_in_slices(spark):
    """A third of the differing rows and more under one key: dealt out, with the same rows."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), F.col("id") % 50)
    )
    table = spark.range(3000).select(hot.cast("string").alias("k"), (F.col("id") % 700).cast("double").alias("v"), "id")
    saved = table.where("id % 7 < 6").drop("id")
    current = table.where("id % 11 < 10").withColumn("v", F.when(F.col("id") % 2 == 0, F.col("v")).otherwise(F.col("v") + 0.5)).drop("id")
    plain = as_rows(snapshot_diff(current, saved, ["k"]))
    assert len(plain) > 1000
    assert as_rows(snapshot_diff(current, saved, ["k"], slice_rows=16)) == plain


def test_slices_spread_a_key_over_tasks(spark):
    from areashare.operators.snapshot import _numbered

    rows_ = spark.range(4000).select(F.lit("hot").alias("k"), (-F.col("id")).alias("v"))
    found = _numbered(rows_, ["k"], "v", 100)
    assert [(r.v, r["__nth"]) for r in found.orderBy("v").collect()] == [(v - 3999, v + 1) for v in range(4000)]
    cut = [line for line in plan(found).splitlines() if "hashpartitioning" in line]
    # The rows' window is dealt by key and slice; only the slices' counts by key alone.
    assert any("__slice" in line for line in cut)


def test_digests_first(spark, current, saved):
    for buckets in (1, 3, 4096):
        found = digest_diff(current, saved, ["k"], buckets=buckets)
        assert as_rows(found) == as_rows(snapshot_diff(current, saved, ["k"]))
    assert digest_diff(saved, saved, ["k"]).isEmpty()
    assert digest_diff(saved.limit(0), saved.limit(0), ["k"]).isEmpty()
    found = digest_diff(current, saved, ["k"], ignore_columns=["note"], ignore_where="k = 'd'")
    assert as_rows(found) == as_rows(snapshot_diff(current, saved, ["k"], ignore_columns=["note"], ignore_where="k = 'd'"))
    with pytest.raises(ValueError, match="columns differ"):
        digest_diff(saved.drop("v"), saved, ["k"])


def test_digests_are_of_bags(spark):
    one = table(spark, ("a", 1.0, "x"), ("a", 1.0, "x"), ("b", -0.0, None), ("c", NAN, "y"))
    same = table(spark, ("c", float("nan"), "y"), ("a", 1.0, "x"), ("b", 0.0, None), ("a", 1.0, "x"))
    digests = [bucket_digests(df, ["k"], 8) for df in (one, same.select("note", "v", "k"))]
    assert differing_buckets(*digests).isEmpty()
    fewer = bucket_digests(one.distinct(), ["k"], 8)
    assert differing_buckets(digests[0], fewer).count() == 1
    # NULLs and values that swap columns are not the same.
    left = spark.createDataFrame([("a", None, "x")], "k string, v string, w string")
    right = spark.createDataFrame([("a", "x", None)], "k string, v string, w string")
    assert differing_buckets(*[bucket_digests(df, ["k"]) for df in (left, right)]).count() == 1


def test_one_changed_row_moves_one_bucket(spark):
    saved = spark.range(20_000).selectExpr("id AS k", "CAST(id % 7 AS double) AS v")
    current = saved.withColumn("v", F.when(F.col("k") == 123, F.lit(99.0)).otherwise(F.col("v")))
    digests = [bucket_digests(df, ["k"]) for df in (current, saved)]
    (bucket,) = differing_buckets(*digests).collect()
    moved = saved.where(bucket_of(["k"]) == bucket[0]).count()
    assert 0 < moved < 30
    assert rows(digest_diff(current, saved, ["k"])) == [(123, "changed", 1, 1, 4.0, 99.0)]
    # The partial sums are all that is shuffled for digests: a row per task and bucket.
    assert "partial_sum" in plan(digests[0])


def test_kept_digests_stand_for_the_saved_table(spark, current, saved):
    kept = bucket_digests(saved, ["k"])
    found = digest_diff(current, saved, ["k"], saved_digests=kept)
    assert as_rows(found) == as_rows(snapshot_diff(current, saved, ["k"]))
    unread = saved.withColumn("v", F.raise_error(F.lit("read")).cast("double"))
    assert digest_diff(saved, unread, ["k"], saved_digests=kept).isEmpty()
