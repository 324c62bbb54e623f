"""Tables as delimited text: own files that keep every row and value, and files of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areashare.sources.storage import scratch_table

# Codes such as '0E1' or ' 12' must come back as the text they were, hence no
# type inference and no trimming.
TEXT_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# In own files a mark stands for NULL, which no value can be: its backslash would be doubled.
NULL_MARK = "\\N"
# Quotes keep a line of a lone blank from looking empty.
OWN_OPTIONS = TEXT_OPTIONS | {"nullValue": NULL_MARK, "emptyValue": '""', "quoteAll": "true"}
# In files of others nothing stands for NULL and "" for empty text. The reader takes what it
# calls null value for NULL wherever it came from, so it must be no value of the data.
READ_OPTIONS = TEXT_OPTIONS | {"nullValue": "\u0000", "emptyValue": ""}
ESCAPES = (("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))
NTZ_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _kept(value: Column, kind: T.DataType) -> Column:
    """A value as text on one line that gives the value back."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        for raw, escaped in (("\\", "\\\\"), *ESCAPES):
            value = F.replace(value, F.lit(raw), F.lit(escaped))
        return value
    if isinstance(kind, T.TimestampType):  # the same moment in any time zone
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(value, NTZ_FORMAT)
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType)):
        return value.cast("string")
    raise ValueError(f"text cannot keep values of type {kind.simpleString()}")


def _given_back(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        # Doubled backslashes apart, a backslash begins another escape.
        def unescaped(part: Column) -> Column:
            for raw, escaped in ESCAPES:
                part = F.replace(part, F.lit(escaped), F.lit(raw))
            return part

        return F.array_join(F.transform(F.split(text, r"\\\\", -1), unescaped), "\\")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    return text.cast(kind)


def write_text_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write every row on a line of its own, so that files can be split between tasks."""
    columns = [_kept(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    df.select(*columns).write.mode(mode).options(**OWN_OPTIONS).csv(path)


def read_own_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that ``write_text_table`` wrote: the same rows, values and types."""
    texts = T.StructType([T.StructField(name, T.StringType()) for name in schema.names])
    options = OWN_OPTIONS | {"emptyValue": "", "mode": "FAILFAST", "enforceSchema": "false"}
    rows = spark.read.schema(texts).options(**options).csv(path)
    return rows.select(*[_given_back(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema])


def read_text_table(
    spark: SparkSession, path: str, schema: T.StructType | str, *, multiline: bool = False
) -> DataFrame:
    """Text of others read with the declared types; a value that does not fit is an error.

    ``multiline`` allows line breaks inside quoted values, at the price of files
    that cannot be split between tasks.
    """
    return (
        spark.read.schema(schema)
        .options(**READ_OPTIONS)
        .option("mode", "FAILFAST")
        .option("enforceSchema", "false")
        .option("multiLine", str(multiline).lower())
        .csv(path)
    )


REJECTED = "__row"


def read_text_parts(
    spark: SparkSession, path: str, schema: T.StructType, *, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Text of others as two tables: the rows that fit the declared types, and the rejected ones.

    A rejected row is given as ``file``, ``row`` (its text) and ``reason``: which values do not fit which types, or
    that the number of fields is another one. Each line is in exactly one of the two tables. Files can be
    split between tasks, so rows have no line numbers. The text is parsed once, into a table in the
    shared folder that both are read from.
    """
    with_row = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
    options = READ_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED}
    options["header"] = str(header).lower()
    rows = spark.read.schema(with_row).options(**options).csv(path)
    rows = scratch_table(rows.select("*", F.col("_metadata.file_path").alias("__file")), "parsed")
    row = F.col(REJECTED)
    # The rejected line once more, as texts: a value that is there but got lost does not fit.
    texts = T.StructType([T.StructField(name, T.StringType()) for name in schema.names])
    again = {k: v for k, v in READ_OPTIONS.items() if k != "header"}
    raw = F.from_csv(row, texts.simpleString()[len("struct<") : -1].replace(":", " "), again)
    odd = [
        F.when(
            raw[f.name].isNotNull() & F.col(f"`{f.name}`").isNull(),
            F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), raw[f.name]),
        )
        for f in schema
    ]
    reason = F.concat_ws("; ", *odd)
    rejected = rows.where(row.isNotNull()).select(
        F.col("__file").alias("file"),
        row.alias("row"),
        F.when(reason == "", "another number of fields").otherwise(reason).alias("reason"),
    )
    return rows.where(row.isNull()).select(*schema.names), rejected
