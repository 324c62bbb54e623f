"""Query results written once and reused while their description is unchanged."""

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
from pyspark.sql import types as T

from areashare.sources.text import read_own_text, read_text_table, write_text_table

# Part of every fingerprint. Raise it when code changes what a description means.
VERSION = "2"


# What a finished build is known by. Readers of the data pass over such names.
MANIFEST = "_manifest"


def path_state(spark: SparkSession, path: str) -> str:
    """Path, and number, size and a digest of the files below: name, time and length of each."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("length", F.xxhash64("path", "modificationTime", "length").alias("file"))
    )
    row = files.agg(F.count("*"), F.sum("length"), F.expr("bit_xor(file)")).first()
    return f"{path} {' '.join(map(str, row))}"


def fingerprint(spark: SparkSession, spec: str, inputs: Sequence[str] = ()) -> str:
    """SHA-256 over the description of a result and the state of its input files."""
    parts = [VERSION, spec, *(path_state(spark, path) for path in inputs)]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


@dataclass(frozen=True)
class ResultCache:
    """Results under one folder, each in ``<fingerprint>-<build>``.

    Every build gets a folder of its own and counts only once its manifest is written, after the
    data. The manifest holds the schema, so that a kept result can be read without its source. A
    build that dies half way is never read, and a refresh leaves readers of the older data alone.
    """

    path: str
    format: str = "parquet"

    def __post_init__(self):
        if self.format not in ("parquet", "csv"):
            raise ValueError(f"unknown cache format {self.format}")

    def newest(self, spark: SparkSession, key: str) -> dict | None:
        """Manifest of the last finished build with this fingerprint."""
        try:
            found = spark.read.text(f"{self.path}/{key}-*/{MANIFEST}").collect()
        except AnalysisException:  # no such path: no build
            return None
        builds = [json.loads(row.value) for row in found]
        return max(builds, key=lambda build: build["built"], default=None)

    def _keep(self, spark: SparkSession, key: str, spec: str, df: DataFrame) -> dict:
        folder = f"{self.path}/{key}-{uuid.uuid4().hex}"
        if self.format == "parquet":
            df.write.parquet(folder)
        else:
            write_text_table(df, folder)
        manifest = {"folder": folder, "spec": spec, "built": time.time(), "schema": df.schema.json()}
        line = spark.createDataFrame([(json.dumps(manifest),)], "value string")
        line.coalesce(1).write.text(f"{folder}/{MANIFEST}")
        return manifest

    def _read(self, spark: SparkSession, manifest: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        if self.format == "parquet":
            return spark.read.schema(schema).parquet(manifest["folder"])
        return read_own_text(spark, manifest["folder"], schema)

    def get(
        self,
        spark: SparkSession,
        spec: str,
        build: Callable[[], DataFrame],
        inputs: Sequence[str] = (),
        refresh: bool = False,
    ) -> DataFrame:
        """The stored result for ``spec``, built first if missing or stale.

        ``inputs`` are the paths the result is computed from; naming them makes a
        change of the files count as a change of the description.
        """
        key = fingerprint(spark, spec, inputs)
        manifest = None if refresh else self.newest(spark, key)
        return self._read(spark, manifest or self._keep(spark, key, spec, build()))

    def adopt(
        self, spark: SparkSession, spec: str, source: str, schema: T.StructType, inputs: Sequence[str] = ()
    ) -> DataFrame:
        """Take a delimited text of others, say a made-up one, as the kept result for ``spec``."""
        key = fingerprint(spark, spec, inputs)
        return self._read(spark, self._keep(spark, key, spec, read_text_table(spark, source, schema)))


def cached_read(
    spark: SparkSession,
    sql: str,
    path: str,
    cache: bool = True,
    *,
    format: str = "parquet",
    inputs: Sequence[str] = (),
) -> DataFrame:
    """Run a SQL text and keep its result, or reuse the kept one.

    Without ``inputs`` the text alone decides whether a kept result still fits;
    ``cache=False`` runs the text again in any case.
    """
    return ResultCache(path, format).get(
        spark, sql, lambda: spark.sql(sql), inputs=inputs, refresh=not cache
    )
