"""Toxicity from subword bags: averaged embeddings under a linear softmax, trained together."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashare.llm.tokens import as_bytes

WORD = re.compile(r"\w+")
BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
# Words averaged together; a text is as toxic as its worst window.
WINDOW = 1
# Labelled rows fitted on at most, those with the smallest hashes of their ids,
# and the characters a text may have to be fitted on. Scores have no such bounds.
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 200_000
# Windows in a fit: all of toxic texts up to half of these, the rest from others.
SAMPLE_WINDOWS = 100_000
EPOCHS = 25
DECAY = 1e-5
# The worst windows of a toxic text that each further fit takes.
WORST = (8, 3, 1)
# Words kept per worker; past that the table starts again.
KEPT_WORDS = 300_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str) -> list[int]:
    """Buckets of a word's character n-grams and of the word itself, with marked ends."""
    data = f"<{word}>".encode()
    found = [data] + [data[i : i + n] for n in GRAMS for i in range(len(data) - n + 1)]
    return [zlib.crc32(gram) % BUCKETS for gram in found]


def windows(n_words: int) -> np.ndarray:
    """Where windows begin; every word is in one of them."""
    return np.arange(0, n_words, WINDOW)


@dataclass
class Model:
    """Per bucket the difference of the two classes' logits; its mean over a window's n-grams,
    averaged by word, and ``bias`` make a window's logit; ``slope`` and ``shift`` turn
    the greatest of a text into its score."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def word_logits(self, words: list[str], kept: dict[str, float]) -> np.ndarray:
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for word in dict.fromkeys(words):
            if word not in kept:
                kept[word] = float(self.weight[grams_of(word)].mean())
        return np.fromiter(map(kept.__getitem__, words), np.float64, len(words))

    def logits(self, words: list[str], kept: dict[str, float]) -> np.ndarray:
        """Logits of a text's windows, without the bias."""
        if not words:
            return np.empty(0)
        begins = windows(len(words))
        sums = np.add.reduceat(self.word_logits(words, kept), begins)
        return sums / np.diff(begins, append=len(words))

    def worst(self, words: list[str], kept: dict[str, float]) -> float:
        """The greatest logit of a text's windows; a text without words has the bias alone."""
        return self.bias + (float(self.logits(words, kept).max()) if words else 0.0)

    def worst_begins(self, words: list[str], kept: dict[str, float], n: int) -> list[int]:
        """Where the ``n`` windows with the greatest logits begin, the greatest first."""
        order = np.argsort(-self.logits(words, kept), kind="stable")[:n]
        return (order * WINDOW).tolist()

    def score(self, words: list[str], kept: dict[str, float]) -> float:
        z = self.slope * self.worst(words, kept) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.step, self.state = rate, 0, {}

    def update(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        t = self.step
        value -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def _bags(split: list[list[str]], places: list[tuple[int, int]]) -> list[list[str]]:
    return [split[doc][at : at + WINDOW] for doc, at in places]


def _softmax_fit(bags: list[list[str]], y: np.ndarray, rng: np.random.Generator) -> Model:
    """Embeddings and linear softmax, trained jointly on labelled windows."""
    # Every word once: its n-grams, and the words of each window.
    number: dict[str, int] = {}
    of_window = np.array([number.setdefault(w, len(number)) for bag in bags for w in bag])
    n_words = np.array([len(bag) for bag in bags])
    window_at = np.cumsum(n_words) - n_words
    grams = [grams_of(word) for word in number]
    n_grams = np.array([len(g) for g in grams])
    gram = np.array([x for g in grams for x in g])
    gram_at = np.cumsum(n_grams) - n_grams
    word_of = np.repeat(np.arange(len(grams)), n_grams)
    in_window = np.repeat(np.arange(len(bags)), n_words)
    # Both classes weigh the same.
    share_1 = y.mean()
    weight = np.where(y == 1, 0.5 / share_1, 0.5 / (1 - share_1)) / len(y)

    # An n-gram that no window has stays at zero and says nothing.
    embedding = np.zeros((BUCKETS, DIMENSIONS))
    head = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    target = np.column_stack([1 - y, y])
    adam = _Adam(0.05)
    for _ in range(EPOCHS):
        adam.step += 1
        word = np.add.reduceat(embedding[gram], gram_at, axis=0) / n_grams[:, None]
        mean = np.add.reduceat(word[of_window], window_at, axis=0) / n_words[:, None]
        logit = mean @ head + bias
        share = np.exp(logit - logit.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        error = (share - target) * weight[:, None]
        to_mean = error @ head.T / n_words[:, None]
        to_embedding = np.empty_like(embedding)
        for d in range(DIMENSIONS):
            to_word = np.bincount(of_window, to_mean[in_window, d], len(grams)) / n_grams
            to_embedding[:, d] = np.bincount(gram, to_word[word_of], BUCKETS)
        adam.update("head", head, mean.T @ error)
        adam.update("bias", bias, error.sum(axis=0))
        adam.update("embedding", embedding, to_embedding + DECAY * embedding)
    return Model(embedding @ (head[:, 1] - head[:, 0]), float(bias[1] - bias[0]))


def fit(texts: list[str], toxic: np.ndarray, seed: int = 0) -> Model:
    """A model of windows, then slope and shift of whole texts.

    Only texts are labelled. At first windows carry their text's label; from then on a toxic text is held to
    be toxic for its worst windows alone, fewer from fit to fit, and other texts for none, their worst included.
    """
    rng = np.random.default_rng(seed)
    same: dict[str, str] = {}  # one string per word
    split = [[same.setdefault(word, word) for word in words_of(text)] for text in texts]
    count = np.array([len(windows(len(words))) for words in split], np.int64)
    if len(set(toxic[count > 0].tolist())) < 2:
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 30.0 if share > 0.5 else -30.0)

    def drawn(label: int) -> list[tuple[int, int]]:
        docs = np.flatnonzero(toxic == label)
        upto = np.cumsum(count[docs])
        some = rng.permutation(upto[-1])[: SAMPLE_WINDOWS // 2]
        doc = np.searchsorted(upto, some, side="right")
        begin = (some - upto[doc] + count[docs][doc]) * WINDOW
        return list(zip(docs[doc].tolist(), begin.tolist()))

    clean, chosen = drawn(0), drawn(1)
    for n in (*WORST, 0):
        y = np.repeat([0.0, 1.0], [len(clean), len(chosen)])
        model = _softmax_fit(_bags(split, clean + chosen), y, rng)
        kept: dict[str, float] = {}
        if n:
            worst = {0: [], 1: []}
            for d, words in enumerate(split):
                label = int(toxic[d])
                found = model.worst_begins(words, kept, n if label else 1)
                worst[label] += [(d, at) for at in found]
            chosen = worst[1]
            clean = clean + worst[0]
    worst = np.array([model.worst(words, kept) for words in split])

    scale = worst.std() or 1.0
    x = np.column_stack([(worst - worst.mean()) / scale, np.ones(len(worst))])
    line = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ line)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        line -= np.linalg.solve(hessian, x.T @ (p - toxic) + 1e-3 * line)
    model.slope = float(line[0] / scale)
    model.shift = float(line[1] - line[0] * worst.mean() / scale)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents: labels has doc_id and toxic (0 or 1).

    Rows without a doc_id or label are passed over; of a doc_id with several labels the greatest counts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    # At most ``rows`` ids and labels go to every task.
    found = text.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    found = found.dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda row: row.doc_id)
    return fit([row.text for row in found], np.array([int(row.toxic) for row in found], np.int64))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for batch in batches:
            scores = []
            for text in as_bytes(batch.column(1)):
                scores.append(model.score(words_of(text.decode()), kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row and whole text, from 0 to 1.

    A word is the mean of its character n-grams' vectors, so a misspelt or unseen word is near
    those it shares n-grams with. Windows of words are averaged and classified, the worst of them
    scores the text. A null or empty text is scored like one without words. Repeated rows score
    alike; other columns are not read. An empty table gives an empty one.
    """
    text = docs.select(F.col("doc_id").cast("bigint"), "text")
    return text.mapInArrow(_score(model), "doc_id bigint, score double")
