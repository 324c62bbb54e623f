"""Quality rules: counts of a text, and how much its n-grams look like trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashare.llm.key_filter import key_filter, thinned
from areashare.llm.tokens import map_texts, parts

BUCKETS = 1 << 16
NGRAM = 3  # bytes
# Mean log-likelihood ratio of an n-gram below which a text is rejected.
THRESHOLD = -0.5
SMOOTHING = 0.5

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

RULES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, base_failed boolean, score double, kept boolean"
)


def ngram_buckets(text: bytes) -> np.ndarray:
    """The bucket of every n-gram of a text; a shorter text has none."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    n = len(data) - NGRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key = data[:n].copy()
    for i in range(1, NGRAM):
        key = (key << 8) | data[i : n + i]
    return ((key * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64)


def _counts(texts: DataFrame, name: str) -> np.ndarray:
    """How often each bucket occurs. Each task adds up its own; a row per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in parts(batch, batch.column("text")):
                for text in texts:
                    total += np.bincount(ngram_buckets(text), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", name])

    counted = map_texts(texts, count, f"bucket bigint, {name} bigint")
    total = np.zeros(BUCKETS)
    for row in counted.groupBy("bucket").agg(F.sum(name).alias(name)).collect():
        total[row.bucket] = row[name]
    return total


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Per bucket the log-likelihood ratio of the trusted against the raw multinomial.

    The raw counts are of all documents, straight from the scan; the trusted ones of all that ``trusted``
    names. Of the texts only those that a filter of fixed size lets by are shuffled to meet the trusted ids.
    """
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("_id")).where("_id IS NOT NULL").distinct()
    held = key_filter(ids.select(F.xxhash64("_id").alias("key")))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    likely = thinned(text.withColumn("key", F.xxhash64("doc_id")), "key", held)
    # One plan at every size.
    good = likely.join(ids.hint("merge"), F.col("doc_id") == F.col("_id")).select("text")
    raw, target = _counts(docs.select("text"), "raw"), _counts(good, "target")
    if not target.any():
        return np.zeros(BUCKETS)
    # Buckets the trusted text lacks are smoothed with the raw shares, not evenly: rare is not bad.
    used = max(1, np.count_nonzero(raw))
    prior = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    smooth = (target + SMOOTHING * used * prior) / (target.sum() + SMOOTHING * used)
    return np.log(smooth) - np.log(prior)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, group, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[group] > 1
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : n + i] |= again
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(b"".join(words).decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def judge(texts: list[bytes], ratio: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Columns of ``RULES`` after doc_id."""
    found = np.array([measure(text) for text in texts], np.int64).reshape(-1, 5)
    grams = (ratio[ngram_buckets(text)] for text in texts)
    score = np.array([gram.mean() if len(gram) else 0.0 for gram in grams])
    n_words, n_repeat = found[:, 0], found[:, 4]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    return [*np.ascontiguousarray(found.T), failed, score, ~failed & (score >= threshold)]


def _judge(ratio: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, batch.column(1)):
                found = [pa.array(x) for x in judge(texts, ratio, threshold)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *found],
                    names=[f.split()[0] for f in RULES.split(", ")],
                )

    return run


def _keep(ratio: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, batch.column("text")):
                yield part.filter(pa.array(judge(texts, ratio, threshold)[-1]))

    return run


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base_failed, score and kept for every row and whole text of ``docs``.

    ``trusted`` names by doc_id the documents to look like. The score is the mean, over all byte n-grams of the
    text, of the log-likelihood ratio between the trusted and the raw multinomial; 0 for a text without
    n-grams, and for all if no trusted document has text. A text is kept unless it fails a base rule or
    scores below ``threshold``. Null counts as empty: no words, rejected. Repeated rows are judged
    alike; a null doc_id is never trusted; other columns are not read. An empty table gives an empty one.
    """
    text = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_texts(text, _judge(ratios(docs, trusted), threshold), RULES)


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    return map_texts(docs, _keep(ratios(docs, trusted), threshold), docs.schema)
