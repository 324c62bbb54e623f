"""The last period of a written table from the footers of its files."""

from __future__ import annotations

import datetime

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types whose greatest value a footer holds as it is: no text cut short, no NaN left out.
EXACT_TYPES = (T.DateType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# What lets the newer file source answer from footers; set in a session of its own, the caller's stays as it is.
FOOTER_SETTINGS = {
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
}

Period = datetime.date | int | None


def footer_maximum(spark: SparkSession, path: str, period: str = "month") -> DataFrame:
    """One row: the greatest ``period``, pushed into the scan as an aggregate, so that one row per file comes out.

    Fails when run if a row group has no statistics or holds nothing but NULL; ``latest_in`` then reads the column.
    """
    own = spark.newSession()
    for name, value in FOOTER_SETTINGS.items():
        own.conf.set(name, value)
    return own.read.parquet(path).agg(F.max(period).alias(period))


def latest_in(spark: SparkSession, path: str, period: str = "month") -> Period:
    """The last period of the Parquet table at ``path``, None without any.

    From footers where they tell, else from the one column. A file that cannot be read fails in both.
    """
    table = spark.read.parquet(path)
    if isinstance(table.schema[period].dataType, EXACT_TYPES):
        try:
            return footer_maximum(spark, path, period).first()[0]
        except (Py4JError, PySparkException):
            pass
    return table.agg(F.max(period)).first()[0]


def latest_rows_in(spark: SparkSession, path: str, period: str = "month") -> DataFrame:
    """Rows of the last period as it is at the time of the call; the scan gets it as a constant."""
    last = latest_in(spark, path, period)
    return spark.read.parquet(path).where(F.lit(False) if last is None else F.col(period) == F.lit(last))
