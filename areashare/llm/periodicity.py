"""Periodic runs of words: a harmonic grid of places, extended by longest common extensions."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashare.llm.tokens import as_bytes

MIN_LENGTH = 24  # words
MIN_EXPONENT = 3  # repetitions of the period
COVER = 64
# Words looked at together; a longer text is looked at alone.
BATCH_WORDS = 1 << 18
# Places of the grid held at a time.
GRID = 1 << 20

RUNS = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def difference_cover(modulus: int) -> np.ndarray:
    """Residues of which, for every distance, two lie that distance apart."""
    step = math.isqrt(modulus)
    return np.unique(np.r_[np.arange(step), np.arange(step, modulus + step, step) % modulus])


class CommonExtension:
    """How far the words from two places on agree, for many pairs of places at once.

    Only suffixes at places whose residue is in the cover are sorted. Two places meet after at most
    ``modulus`` words at such suffixes, so a query compares those words one by one and, where they
    agree, adds the least of the common prefixes that lie between the two in the order,
    from a sparse table. ``words`` must begin and end with values that occur once.
    """

    def __init__(self, words: np.ndarray, modulus: int = COVER) -> None:
        cover = difference_cover(modulus)
        self.modulus, self.n, self.per_block = modulus, len(words), len(cover)
        self.words = np.concatenate([words, np.full(2 * modulus, -1, words.dtype)])
        self.slot = np.full(modulus, -1, np.int64)
        self.slot[cover] = np.arange(len(cover))
        inside = np.zeros(2 * modulus, bool)
        inside[cover] = inside[cover + modulus] = True
        shifted = np.lib.stride_tricks.sliding_window_view(inside, modulus)[:modulus]
        self.shift = np.array([(shifted[a] & shifted).argmax(axis=1) for a in range(modulus)])
        blocks = -(-self.n // modulus)
        places = (np.arange(blocks)[:, None] * modulus + cover).ravel()
        self.places = places[places < self.n]
        levels = self._sort()
        order = np.empty(len(self.places), np.int64)
        order[self.rank] = np.arange(len(order))
        self._table(self._neighbours(order, levels))

    def _sort(self) -> list[np.ndarray]:
        """Rank of every sampled suffix; also its rank by ``modulus``, twice that, ... words."""
        count = len(self.places)
        self.rank = np.zeros(count, np.int64)
        tied = np.arange(count)
        for offset in range(0, self.modulus, 2):
            at = self.places[tied] + offset
            first, second = self.words[at].astype(np.int64), self.words[at + 1].astype(np.int64)
            pair = (first << 32) | (second & 0xFFFFFFFF)
            tied = self._split(tied, pair)
        levels, stride = [self.rank.astype(np.int32)], self.per_block
        while len(tied):
            ahead = tied + stride
            key = np.where(ahead < count, levels[-1][np.minimum(ahead, count - 1)], -1)
            tied = self._split(tied, key)
            levels.append(self.rank.astype(np.int32))
            stride *= 2
        return levels

    def _split(self, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Order suffixes of one rank by a further key; those still tied."""
        if not len(tied):
            return tied
        by = np.lexsort((key, self.rank[tied]))
        tied, key = tied[by], key[by]
        rank = self.rank[tied]
        other = np.r_[True, rank[1:] != rank[:-1]]
        apart = other | np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(apart, at, 0))
        self.rank[tied] = rank + begin - np.maximum.accumulate(np.where(other, at, 0))
        alone = apart & np.r_[apart[1:], True]
        return tied[~alone]

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sampled suffix shares with the one before it in the order."""
        left, right = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(left), np.int64)
        count = len(self.places)
        for k in range(len(levels) - 1, -1, -1):
            level, size = levels[k], self.per_block << k
            inside = np.flatnonzero((left < count) & (right < count))
            same = inside[level[left[inside]] == level[right[inside]]]
            common[same] += self.modulus << k
            left[same] += size
            right[same] += size
        a, b = self.places[order[:-1]] + common, self.places[order[1:]] + common
        common += self._compare(a, b, np.full(len(a), self.modulus))
        return np.r_[0, common]

    def _table(self, common: np.ndarray) -> None:
        self.table = [common.astype(np.int32)]
        size = 1
        while 2 * size <= len(common):
            last = self.table[-1]
            self.table.append(np.r_[np.minimum(last[:-size], last[size:]), last[-size:]])
            size *= 2
        self.table = np.array(self.table)

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from places on, one by one, at most so many."""
        found = most.astype(np.int64)
        live = np.flatnonzero(most > 0)
        for step in range(int(most.max(initial=0))):
            same = self.words[a[live] + step] == self.words[b[live] + step]
            found[live[~same]] = step
            live = live[same]
            live = live[most[live] > step + 1]
            if not len(live):
                break
        return found

    def _rank(self, place: np.ndarray) -> np.ndarray:
        block, residue = np.divmod(place, self.modulus)
        return self.rank[block * self.per_block + self.slot[residue]]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` and from ``b`` on; a place is never paired with itself."""
        shift = self.shift[a % self.modulus, b % self.modulus]
        found = self._compare(a, b, shift)
        met = np.flatnonzero(found == shift)
        one, two = self._rank(a[met] + shift[met]), self._rank(b[met] + shift[met])
        low, high = np.minimum(one, two) + 1, np.maximum(one, two)
        k = np.frexp((high - low + 1).astype(float))[1] - 1
        least = np.minimum(self.table[k, low], self.table[k, high + 1 - (1 << k)])
        found[met] += least
        return found


def _grid(
    size: np.ndarray, min_length: int, min_exponent: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and place in it for every place of the grid, in parts.

    A run of period p agrees with itself p words on over at least ``max(min_length - p, (min_exponent
    - 1) * p)`` words. Places that far apart hit each such stretch.
    """
    periods = np.where(size >= min_length, size // min_exponent, 0)
    text = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(min_length - period, (min_exponent - 1) * period)
    step = np.maximum(step, 1)
    counts = (size[text] - period - 1) // step + 1
    upto = np.cumsum(counts)
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - counts[begin] + GRID, "right")))
        part = np.repeat(np.arange(begin, end), counts[begin:end])
        nth = np.arange(len(part)) - (upto[part] - counts[part] - (upto[begin] - counts[begin]))
        yield text[part], period[part], nth * step[part]
        begin = end


def _hits(
    words: np.ndarray, begin: np.ndarray, size: np.ndarray, min_length: int, min_exponent: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and place in ``words`` of the grid's places that agree a few words around."""
    least = np.maximum(min_length - np.arange(1, min_length + 1), 1)
    half = max(1, int(np.maximum(least, (min_exponent - 1) * np.arange(1, min_length + 1)).min()) // 2)
    padded = np.concatenate([np.full(half, -1), words, np.full(half, -1)])
    for text, period, place in _grid(size, min_length, min_exponent):
        place = place + begin[text]
        live = np.flatnonzero(words[place] == words[place + period])
        a = place[live] + half
        b = a + period[live]
        ahead, back = np.ones(len(a), bool), np.ones(len(a), bool)
        for step in range(1, half):
            ahead &= padded[a + step] == padded[b + step]
            back &= padded[a - step] == padded[b - step]
        live = live[ahead | back]
        yield text[live], period[live], place[live]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each between marks that occur once; where each begins; sizes."""
    parts: list[np.ndarray] = [np.array([-2])]
    for k, text in enumerate(texts):
        parts += [text, np.array([-3 - k])]
    size = np.array([len(text) for text in texts], np.int64)
    begin = np.cumsum(size + 1) - size
    return np.concatenate(parts).astype(np.int32), begin, size


def find_runs(
    texts: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[np.ndarray]:
    """Per text of word numbers its runs as rows (start, length, period) by start, then period."""
    found = [np.empty((0, 3), np.int64)] * len(texts)
    words, begin, size = _joined(texts)
    hit = [text for text, _, _ in _hits(words, begin, size, min_length, min_exponent)]
    hit = np.unique(np.concatenate(hit)) if hit else np.empty(0, np.int64)
    if not len(hit):
        return found
    # Texts without a place that agrees cannot hold a run: the others are sorted.
    words, begin, size = _joined([texts[k] for k in hit])
    ahead, back = CommonExtension(words), CommonExtension(words[::-1])
    rows = [np.empty((0, 4), np.int64)]
    for text, period, place in _hits(words, begin, size, min_length, min_exponent):
        forth = ahead(place, place + period)
        behind = back(len(words) - place, len(words) - place - period)
        length = behind + forth + period
        row = np.stack([text, place - behind - begin[text], length, period], axis=1)
        long = length >= np.maximum(min_length, min_exponent * period)
        rows.append(np.unique(row[long], axis=0))
    # A stretch also has the multiples of its period; the smallest comes first.
    row = np.unique(np.concatenate(rows), axis=0)
    first = np.r_[True, (row[1:, :3] != row[:-1, :3]).any(axis=1)][: len(row)]
    row = row[first]
    row = row[np.lexsort((row[:, 3], row[:, 1], row[:, 0]))]
    bounds = np.searchsorted(row[:, 0], np.arange(len(hit) + 1))
    for k, a, b in zip(hit, bounds[:-1], bounds[1:]):
        found[k] = row[a:b, 1:]
    return found


def repeated(n_words: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word is in some run behind that run's first period."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:-1] > 0


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_WORDS:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def _runs(min_length: int, min_exponent: int, rewrite: Rewrite | None):
    def look(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
        number: dict[bytes, int] = {}
        fresh = itertools.count()
        numbers = [np.fromiter(map(number.setdefault, t, fresh), np.int64, len(t)) for t in texts]
        runs = find_runs(numbers, min_length, min_exponent)
        collapsed = []
        for words, found in zip(texts, runs):
            if len(found):
                words = itertools.compress(words, (~repeated(len(words), found)).tolist())
            collapsed.append(b" ".join(words))
        return runs, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            # White space stands for at least as many words as there are, whatever the text.
            for begin, end in _batches([len(text) // 2 + 1 for text in texts]):
                words = [text.split() for text in texts[begin:end]]
                if rewrite:
                    words = [rewrite(i, w) for i, w in zip(ids[begin:end], words)]
                runs, collapsed = look(words)
                flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
                values = pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(RUN))
                bounds = np.cumsum([0, *map(len, runs)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """doc_id, all runs and the collapsed text of every row, from its whole text.

    Words are what ASCII white space separates, compared byte by byte. A run is a longest stretch of words in
    which words one period apart are equal, with the smallest such period, at least ``min_length`` words
    and ``min_exponent`` (2 or more) periods long; runs are ordered by start, then period. The collapsed text has the words
    outside runs and the first period of each run, between single spaces. ``rewrite`` may change a
    text's words first. A null text or one without words has no runs and collapses to an empty text. Repeated
    rows are looked at one by one, a null doc_id stays null, other columns are not read; an empty table
    gives an empty one.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError(f"no run of {min_length} words and {min_exponent} periods")
    text = docs.select(F.col("doc_id").cast("bigint"), "text")
    return text.mapInArrow(_runs(min_length, min_exponent, rewrite), RUNS)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents with their tail made periodic, by their number."""
    if doc_id is None or not words:
        return words
    group, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    start = group % n
    period = 1 + (n - start) // (3 + group % 8)
    tail = words[start : start + period]
    return words[:start] + (tail * (1 + (n - start) // len(tail)))[: n - start]


def run_digests(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs`` the number of runs, the one of the greatest exponent, and digests."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    # Runs stand in order, so that the first of equal exponents stays.
    best = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best),
    )
    found = found.select("doc_id", "runs", best.alias("best"), listed.alias("listed"), "collapsed")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
