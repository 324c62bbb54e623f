import datetime
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from areashare.sources.tables import AREA_SCHEMA, PRESCRIBING_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("areashare-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="areashare-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _first_of(year, month):
    return datetime.datetime(year, month, 1)


@pytest.fixture(scope="session")
def rx(spark):
    """Hand-made facts; the answers are in the tests that use them."""
    dec, jan, feb = _first_of(2011, 12), _first_of(2012, 1), _first_of(2012, 2)
    rows = [
        (dec, "A01", "0208020Z0AAAAAA", 100),  # before the start
        (jan, "A01", "0208020Z0AAAAAA", 30),
        (jan, "A01", "0208020V0AAABAB", 70),
        (jan, "A01", "0301010R0AAAAAA", 999),  # in neither code set
        (jan, "B02", "0208020V0AAABAB", 50),  # share 0
        (jan, "X99", "0208020X0AAAAAA", 10),  # wrong type of area
        (jan, "Z00", "0208020X0AAAAAA", 10),  # unknown area
        (feb, "A01", "0208020AAAAAAAA", 25),
        (feb, "A01", "0208020Y0AAAAAA", 25),
        (feb, "A01", "0208020V0AAABAB", 50),
        (feb, "B02", "0208020V0AAABAB", 0),  # 0/0
        (feb, "C03", "0208020X0AAAAAA", None),
    ]
    return spark.createDataFrame(rows, PRESCRIBING_SCHEMA)


@pytest.fixture(scope="session")
def areas(spark):
    rows = [
        ("A01", "Alpha", "CCG", True),
        ("B02", "Beta", "CCG", False),
        ("C03", "Gamma", "CCG", False),
        ("D04", "Delta", "CCG", False),
        ("X99", "Other", "PCT", False),
    ]
    return spark.createDataFrame(rows, AREA_SCHEMA)


@pytest.fixture(scope="session")
def measure(spark, rx, areas):
    from areashare.plans.report import DOAC_SHARE
    from areashare.sources.storage import scratch_table

    return scratch_table(DOAC_SHARE.build(rx, areas), "fixture")
