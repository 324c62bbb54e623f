"""The shop-order test tables in the shape of prescribing facts and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns in use, declared: a scan needs no look at the files to know them.
SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "part": "p_partkey bigint, p_brand string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_regionkey int",
    "events": "event_id bigint, event_type string",
}
INPUT_TABLES = ("lineitem", "part", "supplier", "nation")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name))


def prescribing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as facts: ship date, supplier, brand of the part, quantity."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_shipdate").alias("month"),
        F.col("l_suppkey").alias("pct"),
        F.col("p_brand").alias("bnf_code"),
        F.col("l_quantity").cast("bigint").alias("items"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as areas; the balance decides the type, the region the panel."""
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    return suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select(
        F.col("s_suppkey").alias("code"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") >= 0, "CCG").otherwise("PCT").alias("org_type"),
        (F.col("n_regionkey") == 3).alias("is_london"),
    )
