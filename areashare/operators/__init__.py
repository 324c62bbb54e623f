from areashare.operators.bands import ALL_BANDS, DECILES, OUTER, percentile_bands
from areashare.operators.digests import bucket_digests, differing_buckets, digest_diff
from areashare.operators.keys import duplicate_keys, require_unique
from areashare.operators.measure import ShareMeasure
from areashare.operators.sketches import merged_sketches, percentile_sketches, rank_bound, rank_errors, sketch_bands
from areashare.operators.snapshot import (
    RUN_RULES,
    TextRule,
    assert_snapshot,
    compare_texts,
    load_rules,
    sanitise,
    sanitise_text,
    snapshot_diff,
    snapshot_except_all,
)
from areashare.operators.tolerance import within_tolerance
from areashare.operators.views import (
    area_layer,
    latest_label,
    latest_period,
    latest_period_rows,
    national_rollup,
    ordered,
    panel,
    read_panels,
    replace_panels,
    write_panels,
)

__all__ = [
    "ALL_BANDS",
    "DECILES",
    "OUTER",
    "RUN_RULES",
    "ShareMeasure",
    "TextRule",
    "area_layer",
    "assert_snapshot",
    "bucket_digests",
    "compare_texts",
    "differing_buckets",
    "digest_diff",
    "duplicate_keys",
    "latest_label",
    "latest_period",
    "latest_period_rows",
    "load_rules",
    "merged_sketches",
    "national_rollup",
    "ordered",
    "panel",
    "percentile_bands",
    "percentile_sketches",
    "rank_bound",
    "rank_errors",
    "read_panels",
    "replace_panels",
    "require_unique",
    "sanitise",
    "sanitise_text",
    "sketch_bands",
    "snapshot_diff",
    "snapshot_except_all",
    "within_tolerance",
    "write_panels",
]
