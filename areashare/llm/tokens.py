"""Token ids of whole texts, with the ids of a word worked out once per worker.

The tokenizer never joins anything across ASCII white space: it turns white space
into one space, lower-cases character by character, and its pattern takes no
white space. So the ids of a text are those of its words, one after the other.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Words kept per worker; past that, those not met twice since the last time go.
KEPT_WORDS = 500_000
# Bytes of text encoded at a time, one longer text apart.
SLICE_BYTES = 1 << 20
# Rows of a batch of texts.
TEXTS_PER_BATCH = 1000
# What special tokens begin with, which are found in a text as it stands.
SPECIAL = "<|"
# Stands between words that are encoded together; has an id of its own as a word.
BETWEEN = "\u2605"
# Words that the tokenizer leaves as they stand and takes in one piece: lower-case letters, none of which composes.
PLAIN = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"
# A piece of letters ends at a mark in any case: one word less for each of its endings. ASCII marks before white
# space never compose with a letter and open no contraction.
ENDING = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-/:-@\[-`{-~]+\s)"


def split_words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, in lower case as far as ASCII goes, as the tokenizer has it too, each
    distinct word once; and how many words each text has."""
    column = pa.array(texts, pa.binary()).cast(pa.string())
    lower = pc.ascii_lower(column)
    lower = pc.replace_substring_regex(lower, ENDING, r"\1 \2")
    special = pc.match_substring(column, SPECIAL)
    if pc.any(special).as_py():
        lower = pc.if_else(special, column, lower)
    lists = pc.ascii_split_whitespace(lower)
    words = lists.flatten()
    # White space at the ends leaves empty words there.
    real = pc.not_equal(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return words.filter(real).dictionary_encode(), np.diff(upto[offsets - offsets[0]])


class _Numbers(dict):
    """Numbers for words in the order in which they are first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number


class WordEncoder:
    """Ids of texts from a tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for plain words alone, which need no normalizer and no pattern.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = self.plain.model.end_of_word_suffix
        self.last = np.zeros(self.plain.get_vocab_size(), bool)
        self.last[[n for token, n in self.plain.get_vocab().items() if token.endswith(suffix)]] = True
        (self.between,) = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.number = _Numbers()
        self.pool = np.empty(0, np.uint32)
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.met = np.empty(0, np.int64)

    def _forget(self) -> None:
        stay = np.flatnonzero(self.met > 1)
        words = list(self.number)
        self.number = _Numbers()
        self.number.update((words[i], n) for n, i in enumerate(stay.tolist()))
        size = self.size[stay]
        upto = np.cumsum(size)
        self.pool = self.pool[np.repeat(self.begin[stay] - upto + size, size) + np.arange(size.sum())]
        self.begin, self.size, self.met = upto - size, size, np.zeros_like(size)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [one.ids for one in found]

    def _learn(self, words: list[bytes]) -> None:
        """Encode words in one go, which costs half of encoding them one by one.

        Plain words end where a token ends a word; between others stands a word of its own.
        """
        plain = pc.match_substring_regex(pa.array(words, pa.binary()).cast(pa.string()), PLAIN)
        plain = plain.to_numpy(zero_copy_only=False)
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        pool, held = [self.pool], len(self.pool)
        if plain.any():
            joined = b" ".join(itertools.compress(words, plain)).decode()
            (ids,) = self.plain.encode_batch_fast([joined], add_special_tokens=False)
            flat = np.array(ids.ids, np.uint32)
            ends = np.flatnonzero(self.last[flat]) + 1
            size[plain] = np.diff(ends, prepend=0)
            begin[plain] = held + ends - size[plain]
            pool, held = [*pool, flat], held + len(flat)
        others = np.flatnonzero(~plain).tolist()
        texts = [words[i].decode() for i in others]
        odd = [BETWEEN in text or SPECIAL in text for text in texts]
        alone = list(itertools.compress(texts, odd))
        if others:
            (joined,) = self._ids([f" {BETWEEN} ".join("" if o else text for o, text in zip(odd, texts))])
            flat = np.array(joined, np.uint32)
            ends = np.append(np.flatnonzero(flat == self.between), len(flat))
            size[others] = np.diff(ends, prepend=-1) - 1
            begin[others] = held + ends - size[others]
            pool, held = [*pool, flat], held + len(flat)
        for i, ids in zip(itertools.compress(others, odd), self._ids(alone)):
            begin[i], size[i] = held, len(ids)
            pool.append(np.array(ids, np.uint32))
            held += len(ids)
        self.pool = np.concatenate(pool)
        self.begin = np.concatenate([self.begin, begin])
        self.size = np.concatenate([self.size, size])

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, each text closed by ``end_id``, and where each text ends."""
        if len(self.number) > KEPT_WORDS:
            self._forget()
        words, n_words = split_words(texts)
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        slots = slots[words.indices.to_numpy()]
        if self.number.fresh:
            self._learn(self.number.fresh)
            self.number.fresh = []
        self.met = np.bincount(slots, minlength=len(self.size)) + np.pad(
            self.met, (0, len(self.size) - len(self.met))
        )
        size = self.size[slots]
        upto = np.concatenate([[0], np.cumsum(size)])
        ends = upto[np.cumsum(n_words)]
        at = np.repeat(self.begin[slots] - upto[:-1], size) + np.arange(upto[-1])
        ids = np.insert(self.pool[at], ends, np.uint32(end_id))
        return ids, ends + np.arange(1, len(texts) + 1)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return WordEncoder(path)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_BYTES``; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLICE_BYTES:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over rows with whole texts.

    The session's limit of rows in a batch, 10,000 if nobody sets one, comes down to ``TEXTS_PER_BATCH`` and stays
    there: a batch stands in Python and, in vectors that double as they grow, outside of the heap of the JVM.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXTS_PER_BATCH:
        conf.set(key, str(TEXTS_PER_BATCH))
    return rows.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, column: pa.Array) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in parts of about ``SLICE_BYTES`` of the texts in ``column``, with these as UTF-8, null as empty.

    A longer text is a part of its own. So a worker holds a few of a batch's texts a second time, not all of them.
    """
    size = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy().astype(np.int64) + 1
    upto, begin = np.cumsum(size), 0
    while begin < len(upto):
        end = int(np.searchsorted(upto, upto[begin] - size[begin] + SLICE_BYTES, "right"))
        n = max(1, end - begin)
        yield batch.slice(begin, n), as_bytes(column.slice(begin, n))
        begin += n


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8, null as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def ids_crc32(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
