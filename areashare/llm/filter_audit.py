"""What five filters remove in every order: counts by pattern of failures, contracted as a tensor."""

from __future__ import annotations

import hashlib
import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areashare.llm.tokens import as_bytes

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80  # percent of words
MAX_UPPER = 10  # percent of code points
UPPER = string.ascii_uppercase.encode()
SYMBOLS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")

FLAGS = "doc_id bigint, part string, fails int, digest binary"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{name} bigint" for name in COUNTS)

# What is taken along an axis, whose places are pass and fail.
PASS, FAIL, ALL = 0, 1, 2
TAKEN = np.array([[1, 0], [0, 1], [1, 1]])


def text_fails(text: bytes) -> int:
    """A bit for each filter that a text fails by itself."""
    words = text.split()
    n_upper = len(text) - len(text.translate(None, UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * n_upper > MAX_UPPER * len(text.decode())) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(2))
        fails = pa.array([text_fails(text) for text in texts], pa.int32())
        digests = pa.array([hashlib.sha256(text).digest() for text in texts])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), fails, digests], names=["doc_id", "part", "fails", "digest"]
        )


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and pattern of failures (a bit per filter) the documents, good and toxic ones.

    Texts travel as SHA-256 digests. Equal texts are counted per task before they meet, so that a group of
    copies is a few rows; only the first id of a group and its number of rows are set apart.
    """
    text = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    flags = text.mapInArrow(_flags, FLAGS)
    marks = labels.select(
        F.col("doc_id").cast("bigint").alias("_id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )
    marks = marks.where("_id IS NOT NULL").groupBy("_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    keys = ["digest", "part", "fails", "good", "toxic"]
    # Rows without an id have no label and no order: they are counted apart, whatever their number.
    unnamed = flags.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    unnamed = unnamed.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    named = flags.where("doc_id IS NOT NULL").join(marks.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    named = named.select(
        "doc_id",
        "digest",
        "part",
        "fails",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    rows = named.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    groups = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    n_first = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    groups = groups.withColumn("least", least).withColumn("n_first", n_first)
    split = F.array(
        F.struct(F.col("fails").alias("fails"), F.col("n_first").alias("n")),
        F.struct(F.col("fails").bitwiseOR(COPY).alias("fails"), (F.col("n") - F.col("n_first")).alias("n")),
    )
    groups = groups.select("part", F.explode(split).alias("s"), "good", "toxic")
    groups = groups.select("part", "s.fails", "good", "toxic", "s.n").unionByName(unnamed)
    n = F.col("n")
    return groups.groupBy("part", "fails").agg(
        F.sum(n).alias("total"),
        F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )


def _steps() -> tuple[list[str], np.ndarray]:
    """All orders, and per order and step the filter's number."""
    orders = list(itertools.permutations(range(len(FILTERS))))
    return ["".join(FILTERS[f] for f in order) for order in orders], np.array(orders)


def contract(tensor: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Sums of a 2x2x2x2x2 tensor with pass, fail or all taken along each axis, per row of ``taken``."""
    a, b, c, d, e = (TAKEN[axis] for axis in taken.T)
    return np.einsum("abcde,na,nb,nc,nd,ne->n", tensor, a, b, c, d, e)


def audit_part(total: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of a part, a row per order and step, from its three tensors."""
    _, orders = _steps()
    n = len(FILTERS)
    # Where in an order each filter stands, against each step.
    place = np.repeat(np.argsort(orders, axis=1), n, axis=0)
    step = np.tile(np.arange(n), len(orders))[:, None]
    upto = np.where(place <= step, PASS, ALL)
    here = np.where(place < step, PASS, np.where(place == step, FAIL, ALL))
    own = np.where(place == step, FAIL, ALL)
    alone = np.where(place == step, FAIL, PASS)
    removed = contract(total, here)
    by_filter = np.zeros(n, np.int64)
    np.add.at(by_filter, orders.ravel(), removed)
    return {
        "kept": contract(total, upto),
        "removed": removed,
        "redundant": contract(total, own) - removed,
        "unique_fails": contract(total, alone),
        "good_lost": contract(good, here),
        "toxic_lost": contract(toxic, here),
        "shapley": by_filter[orders.ravel()],
    }


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, orders = _steps()
    n = len(FILTERS)
    listed = pa.array(np.repeat(names, n))
    steps = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros((3, 2**n), np.int64)
            for cell in row["cells"]:
                counts[:, cell["fails"]] = cell["total"], cell["good"], cell["toxic"]
            # The lowest bit of a pattern is the last axis of the reshaped counts.
            tensors = counts.reshape(3, *[2] * n).transpose(0, *range(n, 0, -1))
            found = audit_part(*tensors)
            part = pa.array([row["part"]] * len(steps), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part, listed, steps, *[pa.array(found[name]) for name in COUNTS]],
                names=["part", "filter_order", "step", *COUNTS],
            )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter of ``FILTERS`` does at each step of each order, per part.

    A: under 100 words; B: under 80 % of the words distinct; C: over 10 % of the code points in A-Z; D: holds one of
    ``#$%&*|``; E: the same text as a smaller doc_id, removed or not. The part is ``lang``. Per part there are
    600 rows, zeros included: documents kept after the step, removed in it, failing its filter but
    removed earlier, failing its filter only; good and toxic documents removed in it; and the filter's removals
    summed over all orders.

    A null text is empty, a null ``lang`` the empty part. Every row counts; rows of one doc_id and text
    are no copies of each other, and a row without doc_id is neither a copy nor labelled. Of several labels
    of a document one that says good or toxic decides. Other columns are not read; an empty table gives
    an empty one. The 32 counts of a part are all that one task holds of it.
    """
    cells = F.collect_list(F.struct("fails", "total", "good", "toxic")).alias("cells")
    return failure_counts(docs, labels).groupBy("part").agg(cells).mapInArrow(_audit, AUDIT)
