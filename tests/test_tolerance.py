"""Comparison within a tolerance, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from areashare.operators import assert_snapshot, snapshot_diff, snapshot_except_all, within_tolerance
from areashare.operators.tolerance import CELL

INF, NAN = float("inf"), float("nan")
SCHEMA = "k string, v double, w double"


def left(spark, saved, current, tolerance):
    sides = [spark.createDataFrame(rows, SCHEMA) for rows in (current, saved)]
    found = within_tolerance(snapshot_except_all(*sides), tolerance)
    return sorted(tuple(map(str, r)) for r in found.collect())


def most_matches(saved, current, near):
    """The largest number of pairs, by augmenting paths."""
    taken = {}

    def give(i, seen):
        for j in range(len(current)):
            if j not in seen and near(saved[i], current[j]):
                seen.add(j)
                if j not in taken or give(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(give(i, set()) for i in range(len(saved)))


def test_special_values(spark):
    saved = [("a", 1.0, 0.0), ("b", NAN, 0.0), ("c", None, 0.0), ("d", INF, 0.0), ("e", NAN, 0.0), ("f", INF, 0.0)]
    current = [("a", 1.5, 0.0), ("b", NAN, 0.0), ("c", None, 0.0), ("d", INF, 0.0), ("e", 1.0, 0.0), ("f", -INF, 0.0)]
    found = left(spark, saved, current, {"v": 0.5})
    assert found == sorted(
        [("e", "nan", "0.0", "1", "0"), ("e", "1.0", "0.0", "0", "1")]
        + [("f", "inf", "0.0", "1", "0"), ("f", "-inf", "0.0", "0", "1")]
    )
    assert left(spark, [("c", None, 0.0)], [("c", 0.0, 0.0)], {"v": 9.0}) == [
        ("c", "0.0", "0.0", "0", "1"), ("c", "None", "0.0", "1", "0")
    ]
    assert left(spark, [], [], {"v": 1.0}) == []


def test_counts_go_down_one_for_one(spark):
    saved = [("a", 1.0, 0.0)] * 5 + [(None, 7.0, 0.0)]
    current = [("a", 1.25, 0.0)] * 2 + [("a", 0.75, 0.0), ("a", 1.0, 0.0), (None, 7.25, 0.0), (None, 7.25, 0.0)]
    assert left(spark, saved, current, {"v": 0.25}) == [
        ("None", "7.25", "0.0", "0", "1"), ("a", "1.0", "0.0", "2", "1")
    ]


def test_both_columns_must_be_near(spark):
    saved, current = [("a", 1.0, 5.0), ("b", 1.0, 5.0)], [("a", 1.25, 5.25), ("b", 1.25, 6.0)]
    found = left(spark, saved, current, {"v": 0.25, "w": 0.25})
    assert [r[0] for r in found] == ["b", "b"]


def test_against_brute_force(spark):
    """Many keys at once, with ties and chains; steps of a half the tolerance keep the sums exact."""
    rng = random.Random(5)
    saved, current = [], []
    for k in range(120):
        for side in (saved, current):
            side += [(f"k{k}", rng.randrange(1, 14) * 0.25, 0.0) for _ in range(rng.randrange(7))]
    found = left(spark, saved, current, {"v": 0.5})
    for k in range(120):
        name = f"k{k}"
        a, b = ([r[1] for r in side if r[0] == name] for side in (saved, current))
        for v in set(a) & set(b):  # equal rows are matched first
            for _ in range(min(a.count(v), b.count(v))):
                a.remove(v)
                b.remove(v)
        matches = most_matches(a, b, lambda x, y: abs(x - y) <= 0.5)
        rest = [(float(r[1]), int(r[3]) - int(r[4])) for r in found if r[0] == name]
        assert sum(n for _, n in rest if n > 0) == len(a) - matches
        assert -sum(n for _, n in rest if n < 0) == len(b) - matches


def test_a_match_across_the_edge_of_a_cell(spark):
    edges = [CELL * 0.5 * i for i in range(-2, 3)]
    saved = [("a", e - 0.125, 0.0) for e in edges]
    current = [("a", e + 0.125, 0.0) for e in edges]
    assert left(spark, saved, current, {"v": 0.5}) == []


def test_no_two_rows_left_match_and_a_hot_key_is_spread(spark):
    rng = random.Random(6)
    values = lambda: [("hot", rng.randrange(4000) * 0.125 * CELL / 400, 0.0) for _ in range(3000)]
    saved, current = values(), values()
    found = left(spark, saved, current, {"v": 0.5})
    over = [(float(r[1]), int(r[3]) - int(r[4])) for r in found]
    for (v, n), (w, m) in itertools.combinations(over, 2):
        assert n * m > 0 or abs(v - w) > 0.5
    cells = {int(v // (0.5 * CELL)) for _, v, _ in saved}
    assert len(cells) > 1  # tasks of the one key


def test_snapshot_diff_within_a_tolerance(spark):
    saved = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 3.0, 1.0)], SCHEMA)
    current = spark.createDataFrame([("a", 1.0 + 1e-12, 1.0), ("b", 2.5, 1.0), ("d", 3.0, 1.0)], SCHEMA)
    found = snapshot_diff(current, saved, ["k"], tolerance={"v": 1e-9}).select("k", "status").collect()
    assert sorted(map(tuple, found)) == [("b", "changed"), ("c", "missing"), ("d", "unexpected")]
    same = saved.withColumn("v", F.col("v") * (1 + 1e-13))
    assert_snapshot(same, saved, ["k"], tolerance={"v": 1e-9})
    with pytest.raises(AssertionError):
        assert_snapshot(same, saved, ["k"])
    for bad in ({"v": 0.0}, {"v": NAN}, {"k": 1.0}, {"x": 1.0}):
        with pytest.raises(ValueError):
            snapshot_diff(current, saved, ["k"], tolerance=bad)
