"""Sums kept per source file, so that a refresh reads only files that are new or have changed."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areashare.operators.measure import ShareMeasure
from areashare.sources.cache import MANIFEST, VERSION
from areashare.sources.storage import scratch_table
from areashare.sources.tables import PRESCRIBING_SCHEMA

FILE, STAMP = "__file", "__stamp"


def read_facts(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spark.read.schema(PRESCRIBING_SCHEMA).parquet(*files)


def _marked(df: DataFrame) -> DataFrame:
    """Rows of a file source with their file and its state."""
    stamp = F.xxhash64("_metadata.file_modification_time", "_metadata.file_size")
    return df.select("*", F.col("_metadata.file_path").alias(FILE), stamp.alias(STAMP))


def listing(spark: SparkSession, source: str) -> DataFrame:
    """Every file below ``source`` with its state; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    return _marked(files).select(FILE, STAMP)


@dataclass(frozen=True)
class PartialSums:
    """Per source file the sums of one measure, under ``path``.

    Each refresh adds a batch: the sums of the files it read, and which files, with their state. A
    batch counts once its manifest is written, after the data. What counts of all batches is
    decided by the files that are there when the sums are asked for: a changed file has another
    state and is read again, a removed one drops out. Two refreshes at once may both read a
    file; the last batch that has it counts.
    """

    share: ShareMeasure
    path: str
    read: Callable[[SparkSession, Sequence[str]], DataFrame] = read_facts

    @property
    def folder(self) -> str:
        key = hashlib.sha256(json.dumps([VERSION, repr(self.share)]).encode()).hexdigest()
        return f"{self.path.rstrip('/')}/{key}"

    def batches(self, spark: SparkSession) -> list[str]:
        """Names of the finished batches, the oldest first."""
        try:
            found = spark.read.text(f"{self.folder}/*/{MANIFEST}").collect()
        except AnalysisException:  # no such path: no batch
            return []
        return sorted(row.value for row in found)

    def _known(self, spark: SparkSession) -> DataFrame | None:
        """(file, state, batch) of all files that were read; of several batches the last."""
        names = self.batches(spark)
        if not names:
            return None
        files = spark.read.parquet(*[f"{self.folder}/{name}/files" for name in names])
        return files.groupBy(FILE, STAMP).agg(F.max("batch").alias("batch"))

    def _add(self, spark: SparkSession, files: DataFrame, sums: Callable[[], DataFrame]) -> None:
        batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        named = F.lit(batch).alias("batch")
        sums().select("*", named).write.parquet(f"{self.folder}/{batch}/sums")
        files.select(FILE, STAMP, named).write.parquet(f"{self.folder}/{batch}/files")
        line = spark.createDataFrame([(batch,)], "value string")
        line.coalesce(1).write.text(f"{self.folder}/{batch}/{MANIFEST}")

    def _read(self, spark: SparkSession, files: DataFrame) -> list[str]:
        known = self._known(spark)
        unread = files if known is None else files.join(known, [FILE, STAMP], "left_anti")
        unread = scratch_table(unread, "unread")
        # As many names as a scan of these files hands to the driver in any case.
        names = [row[0] for row in unread.select(FILE).collect()]
        if names:
            facts = _marked(self.read(spark, names))
            self._add(spark, unread, lambda: self.share.area_sums(facts, FILE, STAMP))
        return names

    def refresh(self, spark: SparkSession, source: str) -> list[str]:
        """Read the files below ``source`` that are new or have changed; their names."""
        return self._read(spark, scratch_table(listing(spark, source), "listing"))

    def _counted(self, spark: SparkSession, files: DataFrame) -> DataFrame | None:
        """The kept sums of just these files."""
        known = self._known(spark)
        if known is None:
            return None
        wanted = scratch_table(known.join(files, [FILE, STAMP], "left_semi"), "wanted")
        names = [row[0] for row in wanted.select("batch").distinct().collect()]
        if not names:
            return None
        kept = spark.read.parquet(*[f"{self.folder}/{name}/sums" for name in sorted(names)])
        return kept.join(wanted, [FILE, STAMP, "batch"], "left_semi")

    def sums(self, spark: SparkSession, source: str) -> DataFrame:
        """Numerator and denominator items per period and area, over the files that are there now.

        Refreshed first. Equal to a full pass over the files.
        """
        files = scratch_table(listing(spark, source), "listing")
        self._read(spark, files)
        share, kept = self.share, self._counted(spark, files)
        if kept is None:  # no files at all
            return share.area_sums(self.read(spark, [source]))
        return kept.groupBy(share.period, share.area).agg(
            F.sum(share.total_name).alias(share.total_name), F.sum(share.items).alias(share.items)
        )

    def build(self, spark: SparkSession, source: str, areas: DataFrame) -> DataFrame:
        """The measure table, from the kept sums."""
        return self.share.from_sums(self.sums(spark, source), areas)

    def compact(self, spark: SparkSession, source: str) -> None:
        """Put what counts of all batches into one, which is then the only one read."""
        files = scratch_table(listing(spark, source), "listing")
        kept, known = self._counted(spark, files), self._known(spark)
        if kept is not None:
            files = files.join(known, [FILE, STAMP], "left_semi")
            self._add(spark, files, lambda: kept.drop("batch"))
