"""The functions a plain SQL text needs beyond Spark's own."""

from __future__ import annotations

from pyspark.sql import SparkSession

IEEE_DIVIDE = """
CREATE OR REPLACE TEMPORARY FUNCTION ieee_divide(x DOUBLE, y DOUBLE) RETURNS DOUBLE
RETURN CASE WHEN y = 0 THEN x * double('Infinity') ELSE x / y END
"""


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``ieee_divide`` callable from ``spark.sql``; Catalyst inlines its body."""
    spark.sql(IEEE_DIVIDE)
