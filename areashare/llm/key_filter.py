"""A fixed-size Bloom filter over keys, to thin out rows before they are shuffled for a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 2 MB in any case. Past some ten million keys it lets more and more rows by, and the join decides.
BITS = 1 << 24
HASHES = 2


def _places(hashed: np.ndarray) -> list[np.ndarray]:
    width = BITS.bit_length() - 1
    return [(hashed >> (width * i)) & (BITS - 1) for i in range(HASHES)]


def key_filter(keys: DataFrame) -> np.ndarray:
    """Words of the filter over ``keys``, one column of hashes (bigint)."""
    name, width = keys.columns[0], BITS.bit_length() - 1
    key = F.col(name)
    places = [F.shiftright(key, width * i).bitwiseAND(F.lit(BITS - 1)) for i in range(HASHES)]
    bits = keys.select(F.explode(F.array(*places)).alias("place"))
    words = bits.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    )
    # At most a row per word of the filter.
    found = words.toArrow()
    held = np.zeros(BITS >> 6, np.int64)
    held[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return held


def thinned(rows: DataFrame, key: str, held: np.ndarray) -> DataFrame:
    """The rows whose ``key`` may be in the filter: all that are, and some that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column(key).to_numpy()
            inside = np.ones(len(hashed), bool)
            for place in _places(hashed):
                inside &= (held[place >> 6] >> (place & 63)) & 1 == 1
            yield batch.filter(pa.array(inside))

    return rows.mapInArrow(run, rows.schema)
