"""From facts and areas to every table the charts are drawn from."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from areashare.functions.codes import CodeSet
from areashare.operators.bands import percentile_bands
from areashare.operators.measure import ShareMeasure
from areashare.operators.views import area_layer, latest_label, national_rollup, ordered
from areashare.sources.cache import ResultCache

# The code sets, start and area type of the published analysis.
# Apixaban, dabigatran etexilate, edoxaban and rivaroxaban.
DOACS = CodeSet.of("0208020Z0", "0208020X0", "0208020AA", "0208020Y0")
WARFARIN = CodeSet.of("0208020V0")
DOAC_SHARE = ShareMeasure(
    numerator=DOACS,
    denominator=DOACS | WARFARIN,
    area_type="CCG",
    since=datetime.date(2012, 1, 1),
)


@dataclass(frozen=True)
class ShareReport:
    measure: DataFrame
    trend: DataFrame
    latest: DataFrame
    layer: DataFrame
    bands: DataFrame


def share_report(
    spark: SparkSession,
    share: ShareMeasure,
    rx: DataFrame,
    areas: DataFrame,
    path: str,
    *,
    inputs: Sequence[str],
    refresh: bool = False,
    vmin: float = 0,
    vmax: float = 100,
) -> ShareReport:
    """The measure table, written once under ``path``, and the views that read it.

    ``inputs`` are the paths behind ``rx`` and ``areas``: a change of the files, or other
    files, make another result.
    """
    measure = ResultCache(path).get(
        spark,
        repr(share),
        lambda: ordered(share.build(rx, areas), share.period, share.area),
        inputs=inputs,
        refresh=refresh,
    )
    return ShareReport(
        measure=measure,
        trend=ordered(
            national_rollup(measure, share.period, (share.total_name,)), share.period
        ),
        latest=latest_label(measure, share.period),
        layer=area_layer(
            share.members(areas),
            measure,
            vmin,
            vmax,
            period=share.period,
            area=share.area,
            value=share.share_name,
            area_code=share.area_code,
            split="is_london" if "is_london" in areas.columns else None,
        ),
        bands=percentile_bands(measure, share.period, share.share_name),
    )
