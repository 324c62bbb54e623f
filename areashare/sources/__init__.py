from areashare.sources.cache import ResultCache, cached_read, fingerprint
from areashare.sources.footers import footer_maximum, latest_in, latest_rows_in
from areashare.sources.layout import cell_sums, write_bucketed, write_clustered
from areashare.sources.storage import scratch_table, shared_folder
from areashare.sources.tables import (
    AREA_SCHEMA,
    MEASURE_SCHEMA,
    PRESCRIBING_SCHEMA,
    read_areas,
    read_prescribing,
)
from areashare.sources.text import read_own_text, read_text_parts, read_text_table, write_text_table

__all__ = [
    "AREA_SCHEMA",
    "MEASURE_SCHEMA",
    "PRESCRIBING_SCHEMA",
    "ResultCache",
    "cached_read",
    "cell_sums",
    "fingerprint",
    "footer_maximum",
    "latest_in",
    "latest_rows_in",
    "read_areas",
    "read_own_text",
    "read_prescribing",
    "read_text_parts",
    "read_text_table",
    "scratch_table",
    "shared_folder",
    "write_bucketed",
    "write_clustered",
    "write_text_table",
]
