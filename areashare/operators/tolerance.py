"""Match the rows that two tables differ in when their numbers are the same but for rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Width of a cell in tolerances. Rows that are equal but for their numbers are dealt out by cell.
CELL = 1 << 20


def _finite(names: list[str]) -> Column:
    """All of the columns hold a number: no NULL, NaN or infinity."""
    found = F.lit(True)
    for name in names:
        value = F.col(name).cast("double")
        found &= F.coalesce(F.abs(value) < float("inf"), F.lit(False)) & ~F.isnan(value)
    return found


def _merge(tolerance: Mapping[str, float]):
    """Read rows in order of ``__key`` and the first column; take off the counts of rows that match."""
    limits = list(tolerance.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, []  # rows of this key that a later one may match
        held: dict[int, tuple[pa.RecordBatch, list[int]]] = {}
        for number, batch in enumerate(batches):
            over = batch.column("__over").to_pylist()
            held[number] = (batch, over)
            values = zip(*(batch.column(f"__{i}").to_pylist() for i in range(len(limits))))
            for at, (of, value) in enumerate(zip(batch.column("__key").to_pylist(), values)):
                if of != key:
                    key, waiting = of, []
                waiting = [w for w in waiting if value[0] - w[0][0] <= limits[0]]
                for other, counts, place in waiting:
                    if counts[place] * over[at] < 0 and all(
                        abs(v - o) <= limit for v, o, limit in zip(value, other, limits)
                    ):
                        same = min(abs(counts[place]), abs(over[at]))
                        counts[place] -= int(math.copysign(same, counts[place]))
                        over[at] -= int(math.copysign(same, over[at]))
                waiting = [w for w in waiting if w[1][w[2]]]
                if over[at]:
                    waiting.append((value, over, at))
            # Counts of rows that still wait may change: their batches stay until they are settled.
            open_counts = {id(counts) for _, counts, _ in waiting}
            for n in [n for n, (_, counts) in held.items() if id(counts) not in open_counts]:
                yield _settled(*held.pop(n))
        for rest in held.values():
            yield _settled(*rest)

    return run


def _settled(batch: pa.RecordBatch, over: list[int]) -> pa.RecordBatch:
    column = batch.schema.get_field_index("__over")
    return batch.set_column(column, batch.schema.field(column), pa.array(over, pa.int64()))


def within_tolerance(unmatched: DataFrame, tolerance: Mapping[str, float]) -> DataFrame:
    """What ``snapshot_except_all`` found, without rows that match one of the other side within ``tolerance``.

    ``tolerance`` gives the greatest difference for each of its numeric columns; all other columns must
    be equal. NULL, NaN and infinities match only themselves, which the exact comparison has done. A
    row matches one row of the other side, so counts go down one for one. In order of the
    first column each row takes the smallest rows still free, so with one column no other choice
    matches more, but for chains of rows across the edge of a cell. No two rows that are left match.

    Rows with the same other columns are dealt out to tasks by cells of ``CELL`` tolerances, twice, with cells
    shifted by a half, so that a match across an edge is found; each task merges sorted rows and
    holds those within a tolerance of the current one.
    """
    names = list(tolerance)
    if not names or not all(0 < limit < float("inf") for limit in tolerance.values()):
        raise ValueError(f"tolerances must be above zero: {dict(tolerance)}")
    lacking = set(names) - set(unmatched.columns)
    if lacking:
        raise ValueError(f"no such columns to compare: {', '.join(sorted(lacking))}")
    exact = [c for c in unmatched.columns if c not in {*names, "saved_rows", "current_rows"}]
    marked = unmatched.withColumn("__finite", _finite(names))
    rows = marked.where("__finite").drop("__finite")
    rows = rows.withColumn("__over", F.col("saved_rows") - F.col("current_rows"))
    for shift in (0.0, 0.5):
        first = F.col(names[0]).cast("double")
        cell = F.floor(first / F.lit(tolerance[names[0]] * CELL) + F.lit(shift))
        # One text per distinct values; sorting by it keeps equal ones together.
        keyed = rows.withColumn("__key", F.to_json(F.struct(*exact, cell.alias("__cell"))))
        keyed = keyed.withColumns({f"__{i}": F.col(n).cast("double") for i, n in enumerate(names)})
        order = ["__key", *(f"__{i}" for i in range(len(names)))]
        sliced = keyed.repartition("__key").sortWithinPartitions(*order)
        merged = sliced.mapInArrow(_merge(tolerance), sliced.schema).where("__over != 0")
        rows = merged.select(*rows.columns)
    left = F.col("__over") > 0
    rows = rows.withColumns(
        {
            "saved_rows": F.when(left, F.col("current_rows") + F.col("__over")).otherwise(F.col("saved_rows")),
            "current_rows": F.when(left, F.col("current_rows")).otherwise(F.col("saved_rows") - F.col("__over")),
        }
    )
    return marked.where("not __finite").select(*unmatched.columns).unionByName(rows.select(*unmatched.columns))
