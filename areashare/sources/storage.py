"""Where intermediate tables go: the folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Where a session on one machine keeps such tables if it names no folder.
OWN_FOLDER = "spark.areashare.scratch.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir``.

    There is no fallback to a machine's own temporary folder, which is lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if folder:
        return folder.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def own_folder(spark: SparkSession) -> None:
    """Give a session on one machine that names no shared folder one of its own, as for tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    master = spark.conf.get("spark.master", "")
    if not named and (master == "local" or master.startswith("local[")):
        spark.conf.set(OWN_FOLDER, tempfile.mkdtemp(prefix="areashare-"))


# Files of a narrow table for each core, and at least so many.
FILES_PER_CORE, LEAST_FILES = 4, 32


def narrow_table(df: DataFrame, name: str) -> DataFrame:
    """A scratch table of a few numbers a row, in a few files for each core of the cluster at most.

    After a shuffle of many partitions that are not merged, such rows would be a small file in each of them, and a
    file costs more than its rows: on a local disk the file system starts two processes to set its rights and those of its
    checksums. Nothing is shuffled, and plans of fewer partitions stay as they are. Not for plans whose Python tasks tell
    themselves apart by their partition.
    """
    n = max(LEAST_FILES, FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    return scratch_table(df.coalesce(n), name)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage and pins the rows: later reads see the same rows and
    columns even if executors are lost in between. Like checkpoint files, the
    folder is left to the cluster's clean-up.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/areashare/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
