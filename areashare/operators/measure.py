"""The share measure: 100 * sum(items in a code set) / sum(items in a wider one)."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashare.functions.codes import CodeSet
from areashare.functions.scalars import as_percent, case_items, ieee_divide, period_date


@dataclass(frozen=True)
class ShareMeasure:
    """What to measure and the names of the columns it is read from and put into."""

    numerator: CodeSet
    denominator: CodeSet
    area_type: str | None = None
    since: datetime.date | None = None
    grain: str = "month"
    period: str = "month"
    area: str = "pct"
    code: str = "bnf_code"
    items: str = "items"
    area_code: str = "code"
    area_type_column: str = "org_type"
    total_name: str = "doacs"
    share_name: str = "perc_doacs"

    def __post_init__(self):
        for code in self.numerator.codes:
            if not any(code.startswith(d) or d.startswith(code) for d in self.denominator.codes):
                raise ValueError(f"{code} counts in the numerator but not in the denominator")

    def period_expr(self) -> Column:
        return period_date(F.col(self.period), self.grain)

    def in_denominator(self) -> Column:
        return self.denominator.matches(F.col(self.code))

    def from_period(self) -> Column:
        """Lower bound on the bare source column, so that it reaches the scan."""
        return F.col(self.period) >= F.lit(self.since)

    def numerator_items(self) -> Column:
        return case_items(self.numerator.matches(F.col(self.code)), F.col(self.items))

    def facts(self, rx: DataFrame) -> DataFrame:
        """Fact rows that count towards the denominator."""
        kept = rx.where(self.in_denominator())
        return kept if self.since is None else kept.where(self.from_period())

    def members(self, areas: DataFrame) -> DataFrame:
        """Areas that take part."""
        if self.area_type is None:
            return areas
        return areas.where(F.col(self.area_type_column) == self.area_type)

    def area_sums(self, rx: DataFrame, *by: str) -> DataFrame:
        """Numerator and denominator items per period and area code (and ``by``), known or not."""
        return (
            self.facts(rx)
            .groupBy(*by, self.period_expr().alias(self.period), F.col(self.area))
            .agg(
                F.sum(self.numerator_items()).alias(self.total_name),
                F.sum(self.items).alias(self.items),
            )
        )

    def of_members(self, per_area: DataFrame, areas: DataFrame) -> DataFrame:
        """Sums of the areas that take part. An area listed several times counts as often."""
        listed = (
            self.members(areas)
            .groupBy(F.col(self.area_code).alias("__code"))
            .agg(F.count(F.lit(1)).alias("__times"))
        )
        times = F.col("__times")
        return per_area.join(listed, F.col(self.area) == F.col("__code")).select(
            self.period,
            self.area,
            (F.col(self.total_name) * times).alias(self.total_name),
            (F.col(self.items) * times).alias(self.items),
        )

    def sums(self, rx: DataFrame, areas: DataFrame) -> DataFrame:
        """Numerator and denominator items per period and area.

        The facts are summed before they meet the areas: what is shuffled is one
        partial row per task, period and area, however hot an area is, and the
        join sees periods x areas rows, so it needs no broadcast to be cheap. An
        area listed several times counts as often, by a factor and not by rows.
        """
        return self.of_members(self.area_sums(rx), areas)

    def build(self, rx: DataFrame, areas: DataFrame) -> DataFrame:
        """The measure table: period, area, numerator items, share in percent."""
        return self.from_sums(self.area_sums(rx), areas)

    def from_sums(self, per_area: DataFrame, areas: DataFrame) -> DataFrame:
        """The measure table from sums per period and area."""
        share = as_percent(ieee_divide(F.col(self.total_name), F.col(self.items)))
        return self.of_members(per_area, areas).select(
            self.period, self.area, self.total_name, share.alias(self.share_name)
        )
