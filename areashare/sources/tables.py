"""The fact table and the area table, from files or a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areashare.sources.text import read_text_table

PRESCRIBING_SCHEMA = T.StructType(
    [
        T.StructField("month", T.TimestampNTZType()),
        T.StructField("pct", T.StringType()),
        T.StructField("bnf_code", T.StringType()),
        T.StructField("items", T.LongType()),
    ]
)

AREA_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("org_type", T.StringType()),
        T.StructField("is_london", T.BooleanType()),
    ]
)

MEASURE_SCHEMA = T.StructType(
    [
        T.StructField("month", T.DateType()),
        T.StructField("pct", T.StringType()),
        T.StructField("doacs", T.LongType()),
        T.StructField("perc_doacs", T.DoubleType()),
    ]
)


def read_table(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    format: str = "parquet",
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """The columns of ``schema`` from a Parquet, text or catalog source.

    ``renames`` maps a column of the schema to its name in a Parquet or catalog
    source. Text is read with the declared types. The others must carry these types, or
    narrower ones that are widened without loss; any other type is an error.
    """
    if format == "csv":
        return read_text_table(spark, source, schema)
    if format not in ("parquet", "table"):
        raise ValueError(f"unknown source format {format}")
    df = spark.table(source) if format == "table" else spark.read.parquet(source)
    renames = renames or {}
    return df.select(*[_typed(df, renames.get(f.name, f.name), f) for f in schema])


# Types that go into a wider one without loss.
WIDER = {
    "bigint": ("int", "smallint", "tinyint"),
    "double": ("float", "int", "smallint", "tinyint"),
    "timestamp_ntz": ("date",),
    "timestamp": ("date", "timestamp_ntz"),
}
# Read as they are: a period may be a date or either kind of timestamp.
MOMENTS = ("date", "timestamp", "timestamp_ntz")


def _typed(df: DataFrame, name: str, field: T.StructField) -> Column:
    found, wanted = df.schema[name].dataType.simpleString(), field.dataType.simpleString()
    if found == wanted or (found in MOMENTS and wanted in MOMENTS):
        return F.col(name).alias(field.name)
    if found not in WIDER.get(wanted, ()):
        raise ValueError(f"column {name} is {found}, not {wanted}")
    return F.col(name).cast(field.dataType).alias(field.name)


def read_prescribing(spark: SparkSession, source: str, **how) -> DataFrame:
    return read_table(spark, source, PRESCRIBING_SCHEMA, **how)


def read_areas(spark: SparkSession, source: str, **how) -> DataFrame:
    return read_table(spark, source, AREA_SCHEMA, **how)
