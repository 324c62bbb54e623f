"""Column builders: periods, conditional values, IEEE division, scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


GRAINS = ("day", "week", "month", "quarter", "year")


def period_date(moment: Column, grain: str = "month") -> Column:
    """The date of a timestamp, taken back to the first day of its ``grain``."""
    if grain not in GRAINS:  # Spark would answer NULL
        raise ValueError(f"unknown grain {grain}, not one of {', '.join(GRAINS)}")
    if grain == "day":
        return F.to_date(moment)
    return F.trunc(moment, grain)


def case_items(predicate: Column, items: Column) -> Column:
    """``items`` where the predicate holds, 0 elsewhere."""
    return F.when(predicate, items).otherwise(F.lit(0))


def ieee_divide(x: Column, y: Column) -> Column:
    """Division that follows IEEE 754 in every ANSI mode.

    ``x/0`` is an infinity with the sign of ``x``, ``0/0`` and ``NaN/0`` are NaN,
    NULL on either side is NULL. A divisor of -0.0 counts as +0.0.
    """
    x, y = x.cast("double"), y.cast("double")
    # x * inf is what IEEE 754 says x/0 is, for zero, NaN and NULL as well.
    return F.when(y == 0, x * float("inf")).otherwise(x / y)


def as_percent(ratio: Column) -> Column:
    return F.lit(100) * ratio


def parse_period(text: Column, lenient: bool = False) -> Column:
    """Text to a timestamp without zone; bad text fails unless ``lenient``."""
    parsed = text.try_cast("timestamp_ntz")
    if lenient:
        return parsed
    # raise_error rather than a plain cast: a session with ANSI off would turn
    # bad text into NULL silently.
    bad = F.raise_error(F.concat(F.lit("not a timestamp: "), text))
    return F.when(text.isNotNull() & parsed.isNull(), bad).otherwise(parsed)


def period_label(period: Column) -> Column:
    """A period as a chart caption, such as ``December 2019``."""
    return F.date_format(period, "MMMM yyyy")


def missing_to_null(value: Column) -> Column:
    """NaN becomes NULL, so that percentiles, max and clamps skip both alike."""
    return F.when(~F.isnan(value), value)


def scale_clamp(value: Column, vmin: float, vmax: float) -> Column:
    """``value`` clamped to [vmin, vmax] and mapped to [0, 1]; missing stays NULL."""
    if not vmin < vmax:
        raise ValueError(f"empty scale: {vmin} to {vmax}")
    present = missing_to_null(value)
    clamped = F.least(F.greatest(present, F.lit(float(vmin))), F.lit(float(vmax)))
    # least and greatest skip NULL, so an unguarded clamp paints a missing value
    # as vmin.
    return F.when(present.isNotNull(), (clamped - float(vmin)) / (float(vmax) - float(vmin)))
