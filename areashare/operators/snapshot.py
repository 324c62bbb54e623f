"""Compare a result with a saved one, after cleaning text of run-specific parts."""

from __future__ import annotations

import configparser
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areashare.operators.tolerance import within_tolerance
from areashare.sources.storage import scratch_table


@dataclass(frozen=True)
class TextRule:
    """Replace every match of a regular expression with a literal text."""

    name: str
    regex: str
    replace: str


# What a run leaves in its text output that the next run will not.
RUN_RULES = (
    TextRule("python_memory_ref", r"\b0x[a-f0-9]{12}\b", "<memory_address>"),
    TextRule(
        "uuid",
        r"\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b",
        "<uuid>",
    ),
)


def load_rules(path: str) -> tuple[TextRule, ...]:
    """Rules from an INI file: one section each, with ``regex`` and ``replace``."""
    parser = configparser.RawConfigParser()
    with open(path, encoding="utf-8") as file:
        parser.read_file(file)
    return tuple(
        TextRule(name, parser.get(name, "regex"), parser.get(name, "replace"))
        for name in parser.sections()
    )


def sanitise(text: Column, rules: Iterable[TextRule] = RUN_RULES) -> Column:
    """All rules applied in order, each to what the one before left."""
    for rule in rules:
        literal = re.sub(r"([\\$])", r"\\\1", rule.replace)
        text = F.regexp_replace(text, F.lit(rule.regex), F.lit(literal))
    return text


def sanitise_text(df: DataFrame, *columns: str, rules: Iterable[TextRule] = RUN_RULES) -> DataFrame:
    rules = tuple(rules)
    return df.withColumns({c: sanitise(F.col(c), rules) for c in columns})


def _compared(
    df: DataFrame, ignore_columns: Sequence[str], ignore_where: Column | str | None
) -> DataFrame:
    if ignore_where is not None:
        skip = F.expr(ignore_where) if isinstance(ignore_where, str) else ignore_where
        df = df.where(~F.coalesce(skip, F.lit(False)))
    return df.drop(*ignore_columns)


def snapshot_except_all(
    current: DataFrame,
    saved: DataFrame,
    *,
    ignore_columns: Sequence[str] = (),
    ignore_where: Column | str | None = None,
) -> DataFrame:
    """Rows that one side has more often than the other, with both counts.

    Equal rows are counted before they are compared, so a row that makes up a
    third of a table travels as one row per task. NULL equals NULL and NaN
    equals NaN. ``saved_rows > current_rows`` means rows went missing.
    """
    current = _compared(current, ignore_columns, ignore_where)
    saved = _compared(saved, ignore_columns, ignore_where)
    if dict(current.dtypes) != dict(saved.dtypes):
        raise ValueError(f"columns differ: {current.dtypes} and {saved.dtypes}")
    names = current.columns
    reserved = {"saved_rows", "current_rows"} & set(names)
    if reserved:
        raise ValueError(f"rename before comparing: {', '.join(sorted(reserved))}")
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = saved.select(*names, one.alias("saved_rows"), none.alias("current_rows")).unionByName(
        current.select(*names, none.alias("saved_rows"), one.alias("current_rows"))
    )
    return (
        both.groupBy(*names)
        .agg(F.sum("saved_rows").alias("saved_rows"), F.sum("current_rows").alias("current_rows"))
        .where(F.col("saved_rows") != F.col("current_rows"))
    )


# Rows of one key that are numbered in one go.
SLICE_ROWS = 65_536


def _numbered(rows: DataFrame, keys: Sequence[str], order: str, slice_rows: int) -> DataFrame:
    """``rows`` with ``__nth``: the place of each within its key, by ``order``.

    A key of few rows is numbered in one window. If any has more than ``slice_rows``, all rows are sorted
    over the tasks and cut into slices; rows are numbered within their slice of the key, after the counts
    of the key's slices before. So no task ever holds a hot key.
    """
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= slice_rows:
        return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    ordered = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    # The id counts up within a partition and from one to the next, like the sort. Written down, because
    # the bounds of the ranges come from a sample and differ from run to run.
    cut = F.expr(f"monotonically_increasing_id() div {slice_rows}")
    sliced = scratch_table(ordered.withColumn("__slice", cut), "ranks")
    counts = sliced.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"__of_{k}") for k in keys],
        F.col("__slice").alias("__of_slice"),
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(order))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    numbered = sliced.withColumn("__within", within).join(
        counts, [F.col("__slice") == F.col("__of_slice"), *same]
    )
    place = F.col("__before") + F.col("__within")
    return numbered.select(*rows.columns, place.alias("__nth"))


def snapshot_diff(
    current: DataFrame,
    saved: DataFrame,
    keys: Sequence[str],
    *,
    ignore_columns: Sequence[str] = (),
    ignore_where: Column | str | None = None,
    tolerance: Mapping[str, float] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every row that one side has over the other: its key's ``status`` and the values.

    ``missing`` keys are only in ``saved``, ``unexpected`` ones only in ``current``, ``changed`` ones
    in both. The rows of a key that are left over on either side stand next to each other in order of
    their values; ``saved_rows`` and ``current_rows`` count how often they are left over. So a
    key that does not repeat gives one row. Only rows that differ are grouped by key, and only
    their keys are looked up for rows that do not. They are written to the shared folder once.
    With ``tolerance``, a greatest difference by column, rows that match within it do not differ.
    """
    skipped = {"ignore_columns": ignore_columns, "ignore_where": ignore_where}
    unmatched = scratch_table(snapshot_except_all(current, saved, **skipped), "unmatched")
    if tolerance:
        if set(tolerance) & set(keys):
            raise ValueError("a key has no tolerance")
        unmatched = scratch_table(within_tolerance(unmatched, tolerance), "unmatched")
    values = [c for c in unmatched.columns if c not in {*keys, "saved_rows", "current_rows"}]
    over = F.col("saved_rows") - F.col("current_rows")
    row = F.struct(*values) if values else F.struct(F.lit(None).alias("__none"))
    sides = unmatched.select(*keys, row.alias("__row"), over.alias("__over"), (over > 0).alias("__left"))
    sides = _numbered(sides, [*keys, "__left"], "__row", slice_rows)
    left, right = F.col("__over") > 0, F.col("__over") < 0
    paired = sides.groupBy(*keys, "__nth").agg(
        F.sum(F.greatest("__over", F.lit(0))).alias("saved_rows"),
        F.sum(F.greatest(-F.col("__over"), F.lit(0))).alias("current_rows"),
        F.max(F.when(left, F.col("__row"))).alias("__saved"),
        F.max(F.when(right, F.col("__row"))).alias("__current"),
    )
    found = unmatched.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    present = None
    for side, df in (("saved", saved), ("current", current)):
        held = _compared(df, ignore_columns, ignore_where).select(
            *keys, F.lit(side == "saved").alias("__in_saved"), F.lit(side == "current").alias("__in_current")
        )
        present = held if present is None else present.unionByName(held)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    present = (
        present.join(found, same, "left_semi")
        .groupBy(*[F.col(k).alias(f"__{k}") for k in keys])
        .agg(F.max("__in_saved").alias("__in_saved"), F.max("__in_current").alias("__in_current"))
    )
    status = (
        F.when(~F.col("__in_current"), "missing")
        .when(~F.col("__in_saved"), "unexpected")
        .otherwise("changed")
    )
    return paired.join(present, same).select(
        *keys,
        status.alias("status"),
        "saved_rows",
        "current_rows",
        *[F.col("__saved")[v].alias(f"saved_{v}") for v in values],
        *[F.col("__current")[v].alias(f"current_{v}") for v in values],
    )


# Kinds of output that a regression check leaves out.
SKIPPED_KINDS = ("application/vnd.plotly.v1+json", "stderr")


def compare_texts(
    current: DataFrame,
    saved: DataFrame,
    keys: Sequence[str],
    *,
    kind: str = "kind",
    text: str = "text",
    skip_kinds: Iterable[str] = SKIPPED_KINDS,
    skip_where: Column | str | None = None,
    rules: Iterable[TextRule] = RUN_RULES,
) -> DataFrame:
    """The regression check as one job: texts of both sides cleaned of what a run leaves in
    them, without the kinds and rows to skip, and then compared by key.

    Fails when nothing is left to compare.
    """
    rules, skipped = tuple(rules), list(skip_kinds)
    sides = []
    for df in (current, saved):
        kept = _compared(df, (), skip_where).where(~F.coalesce(F.col(kind).isin(skipped), F.lit(False)))
        sides.append(sanitise_text(kept, text, rules=rules))
    if all(side.isEmpty() for side in sides):
        raise ValueError("nothing to compare: both sides are empty")
    return snapshot_diff(*sides, keys=keys)


def assert_snapshot(
    current: DataFrame,
    saved: DataFrame,
    keys: Sequence[str],
    *,
    ignore_columns: Sequence[str] = (),
    ignore_where: Column | str | None = None,
    tolerance: Mapping[str, float] | None = None,
) -> None:
    """Fail when the tables differ, and also when there is nothing to compare."""
    skipped = {"ignore_columns": ignore_columns, "ignore_where": ignore_where}
    left = [_compared(df, (), ignore_where) for df in (current, saved)]
    if all(df.isEmpty() for df in left):
        raise ValueError("nothing to compare: both tables are empty")
    found = snapshot_diff(current, saved, keys, tolerance=tolerance, **skipped).groupBy("status").count().collect()
    if found:
        counts = ", ".join(f"{row['count']} {row.status}" for row in sorted(found))
        raise AssertionError(f"differs from the saved table: {counts}")
