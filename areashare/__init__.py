"""Share measures over coded transactions, as Spark DataFrame transformations."""

from areashare.functions import CodeSet, register_sql_functions
from areashare.operators import (
    ShareMeasure,
    area_layer,
    assert_snapshot,
    latest_label,
    latest_period_rows,
    national_rollup,
    percentile_bands,
    sanitise_text,
    snapshot_diff,
    snapshot_except_all,
)
from areashare.plans import DOAC_SHARE, ShareReport, share_report
from areashare.sources import ResultCache, cached_read, read_areas, read_prescribing

__all__ = [
    "DOAC_SHARE",
    "CodeSet",
    "ResultCache",
    "ShareMeasure",
    "ShareReport",
    "area_layer",
    "assert_snapshot",
    "cached_read",
    "latest_label",
    "latest_period_rows",
    "national_rollup",
    "percentile_bands",
    "read_areas",
    "read_prescribing",
    "register_sql_functions",
    "sanitise_text",
    "share_report",
    "snapshot_diff",
    "snapshot_except_all",
]
