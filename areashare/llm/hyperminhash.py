"""Near-duplicates by HyperMinHash: compressed registers, bands of them, estimates, full sets."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashare.llm.key_filter import key_filter, thinned
from areashare.llm.simhash import components
from areashare.llm.tokens import as_bytes, map_texts, parts
from areashare.sources.storage import narrow_table, scratch_table

SHINGLE = 3
PERCENT = 85
# Registers are bytes, a band is eight of them.
REGISTERS = 384
BAND = 8
ZEROS, MANTISSA = 4, 4  # bits of a register
EMPTY = 0xFF
# A pair goes to verification unless its estimate is so many deviations too low.
DEVIATIONS = 4.5
# Classes of a band compared with each other at a time, and pairs held for it.
BLOCK = 1024
HELD_PAIRS = 1 << 13
# Words whose hashes a worker keeps.
KEPT_WORDS = 1 << 18

SETS = "doc_id bigint, key bigint, n_shingles bigint, digest binary, registers binary"


class _Hashes(dict):
    """XXH64 of words, each worked out once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    length = min(shingle, len(words))
    count = len(words) - length + 1
    mixed = np.full(count, length, np.uint64)
    for i in range(length):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
    # The finaliser of SplitMix64, a fixed function.
    mixed ^= mixed >> np.uint64(30)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(27)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Per bucket the leading zeros and next bits of its least hash, in a byte."""
    found = np.full(REGISTERS, EMPTY, np.uint8)
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    least = shingles[first] * np.uint64(REGISTERS) | np.uint64(1)
    zeros = 64 - np.frexp(least.astype(float))[1]
    part = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    value = np.minimum(zeros, (1 << ZEROS) - 1) << MANTISSA | part.astype(np.int64)
    found[bucket[first].astype(np.int64)] = np.minimum(value, EMPTY - 1)
    return found


@functools.lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """Per bucket all buckets in an order of its own, drawn once for all."""
    rng = np.random.default_rng(1)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)], np.int16)


def densified(row: np.ndarray) -> np.ndarray:
    """Registers with each empty one taken from the first bucket in its order that is not.

    Equal chances of two sets' buckets to agree hold for these too, so that bands of small sets, whose
    buckets are mostly empty, ask for as much likeness as those of large ones.
    """
    held = row != EMPTY
    if held.all() or not held.any():
        return row
    full, gaps = row.copy(), np.flatnonzero(~held)
    # Most find one early on.
    for tried in (16, REGISTERS):
        donors = _donors()[gaps, :tried]
        there = held[donors]
        first = there.argmax(axis=1)
        at = np.arange(len(gaps))
        found = there[at, first]
        full[gaps[found]] = row[donors[at, first][found]]
        gaps = gaps[~found]
    return full


def band_values(matrix: np.ndarray) -> np.ndarray:
    """The bands of rows of registers, each as one number."""
    full = np.array([densified(row) for row in matrix], np.uint8).reshape(-1, REGISTERS)
    return full.view(np.uint64)


# Rates of elements per bucket for which collisions are tabled: halves of powers of two.
RATES = 2.0 ** (np.arange(-40, 61) / 2)


@functools.lru_cache(maxsize=1)
def _collisions() -> np.ndarray:
    """Chance that buckets of two unlike sets hold the same register, by the sets' rates.

    The least of a bucket's hashes falls in a cell of the unit interval as the first event of
    a Poisson process of that rate does.
    """
    cells = []
    for zeros in range(1 << ZEROS):
        low = 0.0 if zeros == (1 << ZEROS) - 1 else 2.0 ** -(zeros + 1)
        cells.append(np.linspace(low, 2.0**-zeros, (1 << MANTISSA) + 1))
    bounds = np.array(cells)
    rate = RATES[:, None, None]
    chance = (np.exp(-rate * bounds[:, :-1]) - np.exp(-rate * bounds[:, 1:])) / -np.expm1(-rate)
    chance = chance.reshape(len(RATES), -1)
    return chance @ chance.T


def _rate(size: np.ndarray) -> np.ndarray:
    at = np.rint(2 * np.log2(np.maximum(size, 1) / REGISTERS)).astype(int) + 40
    return np.clip(at, 0, len(RATES) - 1)


def corrected(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Estimated similarity of pairs of rows of registers, without the equal ones of unlike hashes."""
    in_a, in_b = a != EMPTY, b != EMPTY
    equal, both = ((a == b) & in_a).sum(axis=1), (in_a & in_b).sum(axis=1)
    used = np.maximum((in_a | in_b).sum(axis=1), 1)
    # Of the registers that both hold, those of unlike hashes collide by chance.
    chance = _collisions()[_rate(size_a), _rate(size_b)]
    return (equal - chance * both) / (used * (1 - chance))


def may_link(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int = PERCENT
) -> np.ndarray:
    """Whether pairs of rows of registers may be as similar, by sizes and the corrected estimate."""
    wanted = percent / 100
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    in_a, in_b = a != EMPTY, b != EMPTY
    used = np.maximum((in_a | in_b).sum(axis=1), 1)
    estimate = corrected(a, b, size_a, size_b)
    # The registers in use are so many draws without replacement from the union.
    union = (size_a + size_b) / (1 + wanted)
    left = np.maximum(0.1, 1 - used / np.maximum(union, used))
    deviation = np.sqrt(wanted * (1 - wanted) / used * left)
    return (100 * small >= percent * large) & (estimate >= wanted - DEVIATIONS * deviation)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection reaches ``percent`` * union of two full sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in (text for _, texts in parts(batch, batch.column(2)) for text in texts):
                found = shingle_set(text, shingle)
                sizes.append(len(found))
                digests.append(hashlib.sha256(found.tobytes()).digest()[:16])
                sketches.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "key", "n_shingles", "digest", "registers"],
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both."""
    text = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def shingle_classes(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Every row with the size and digest of its set, and the distinct sets that are not empty.

    A class of equal sets has a number, its smallest doc_id, size and registers, and the key
    of one row that has the set.
    """
    rows = scratch_table(map_texts(_keyed(docs), _sets(shingle), SETS), "sets")
    found = (
        rows.where("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("row"),
            F.first("n_shingles").alias("size"),
            F.first("registers").alias("registers"),
        )
    )
    found = found.select(
        F.monotonically_increasing_id().alias("c"),
        "digest",
        F.col("row.doc_id").alias("least"),
        F.col("row.key").alias("key"),
        "size",
        "registers",
    )
    return rows.select("doc_id", "n_shingles", "digest"), scratch_table(found, "classes")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = REGISTERS // BAND
    salt = np.random.default_rng(2).integers(0, 2**63, n, np.uint64)
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            # An odd factor keeps values of one band apart, the salt those of different bands.
            value = (band_values(_matrix(part.column("registers"))) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
            rows = np.repeat(np.arange(part.num_rows), n)
            band = np.tile(np.arange(n, dtype=np.int32), part.num_rows)
            ids = part.select(["c", "least"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.ravel().view(np.int64)), pa.array(band), *ids.columns],
                names=["bucket", "band", "c", "least"],
            )


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, band, c, least) of every band of a class."""
    schema = "bucket bigint, band int, c bigint, least bigint"
    return classes.select("c", "least", "registers").mapInArrow(_bands, schema)


def _screen(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, HELD_PAIRS):
                part = batch.slice(begin, HELD_PAIRS)
                a, b = _matrix(part.column("registers_u")), _matrix(part.column("registers_v"))
                sizes = part.column("size_u").to_numpy(), part.column("size_v").to_numpy()
                yield part.select(["u", "v"]).filter(pa.array(may_link(a, b, *sizes, percent)))

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _renamed(df: DataFrame, suffix: str, key: str, *columns: str) -> DataFrame:
    return df.select(F.col("c").alias(key), *[F.col(c).alias(f"{c}_{suffix}") for c in columns])


def screened(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose sizes and corrected estimates allow the similarity."""
    sketches = [_renamed(classes, side, side, "size", "registers").hint("merge") for side in "uv"]
    held = pairs.join(sketches[1], "v").where(F.col("size_v") > 0).join(sketches[0], "u")
    size_u, size_v = F.col("size_u"), F.col("size_v")
    near = F.lit(100) * F.least(size_u, size_v) >= F.lit(percent) * F.greatest(size_u, size_v)
    return held.where(near).mapInArrow(_screen(percent), "u bigint, v bigint")


def _verify(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for part, others in parts(batch, batch.column("text_v")):
                ids, ones = part.column("u").to_pylist(), part.column("text_u")
                same = []
                for i, (u, other) in enumerate(zip(ids, others)):
                    if u != last:
                        last, held = u, shingle_set(as_bytes(ones.slice(i, 1))[0], shingle)
                    same.append(similar(held, shingle_set(other, shingle), percent))
                yield part.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    return run


def verified(
    docs: DataFrame, pairs: DataFrame, classes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The pairs whose full sets are as similar. Only texts that some pair needs are shuffled."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct()
    needed = narrow_table(classes.select("c", "key").join(needed.hint("merge"), "c"), "needed")
    held = key_filter(needed.select("key"))
    texts = thinned(_keyed(docs).select("key", "text"), "key", held)
    # A row that repeats is one text.
    texts = texts.groupBy("key").agg(F.first("text").alias("text")).hint("merge").join(needed, "key")
    texts = scratch_table(texts.select("c", "text"), "texts")
    one, other = (_renamed(texts, side, side, "text").hint("merge") for side in "uv")
    # Sorted by u last, so that a text that many are compared with is cut up once.
    both = pairs.join(other, "v").join(one, "u")
    return narrow_table(map_texts(both, _verify(shingle, percent), "u bigint, v bigint"), "links")


def _block_pairs(batch: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidates among the rows of each group: every two, vectorised over groups."""
    group = batch.column("group").to_numpy()
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    first = np.repeat(begin, np.diff(np.r_[begin, len(group)]))
    columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("c", "root", "size", "band", "block", "alone")}
    sketch = _matrix(batch.column("registers"))
    before = np.arange(len(group)) - first
    upto = np.cumsum(before)
    row = 0
    while row < len(group):
        end = max(row + 1, int(np.searchsorted(upto, upto[row] - before[row] + HELD_PAIRS, "right")))
        b = np.repeat(np.arange(row, end), before[row:end])
        a = first[b] + np.arange(len(b)) - np.repeat(upto[row:end] - before[row:end] - upto[row] + before[row], before[row:end])
        row = end
        # Rows of one block meet where it is alone, those of two blocks where these are together.
        go = columns["root"][a] != columns["root"][b]
        go &= columns["alone"][b] | (columns["block"][a] != columns["block"][b])
        small, large = np.sort([columns["size"][a], columns["size"][b]], axis=0)
        a, b = a[go & (100 * small >= percent * large)], b[go & (100 * small >= percent * large)]
        a_size, b_size = columns["size"][a], columns["size"][b]
        go = may_link(sketch[a], sketch[b], a_size, b_size, percent)
        a, b = a[go], b[go]
        # A pair that several bands share counts in the first of them.
        used, at = np.unique(np.r_[a, b], return_inverse=True)
        value = band_values(sketch[used])
        shared = value[at[: len(a)]] == value[at[len(a) :]]
        go = shared.argmax(axis=1) == columns["band"][b]
        u, v = columns["c"][a[go]], columns["c"][b[go]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            group = held.column("group").to_numpy()
            # The last group may go on in the next batch.
            end = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if end:
                yield from _block_pairs(held.slice(0, end).combine_chunks().to_batches()[0], percent)
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from _block_pairs(held.combine_chunks().to_batches()[0], percent)

    return run


def across(buckets: DataFrame, roots: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Screened pairs of classes that share a bucket but, so far, no component.

    Buckets whose classes are all tied already are done. In the others all classes of different components
    are compared by their registers, in blocks of ``BLOCK``: a bucket of more is dealt out as pairs
    of blocks, so that no task holds a whole one and no pair is left out.
    """
    member = buckets.join(roots.hint("merge"), "c")
    open_ = member.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")
    )
    open_ = open_.where("low < high").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = member.join(open_.hint("merge"), "bucket").withColumn(
        "block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    )
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least("block", k).alias("low"), F.greatest("block", k).alias("high")),
    )
    dealt = member.select("bucket", "band", "c", "root", "block", F.explode(others).alias("pair"))
    dealt = dealt.join(classes.select("c", "size", "registers").hint("merge"), "c").select(
        F.xxhash64("bucket", "pair.low", "pair.high").alias("group"),
        "c",
        "root",
        "size",
        "band",
        "block",
        (F.col("pair.low") == F.col("pair.high")).alias("alone"),
        "registers",
    )
    dealt = dealt.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_across(percent), "u bigint, v bigint").distinct()


def minhash_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A text's set holds its distinct shingles of ``shingle`` words, lower-cased in A-Z and split at ASCII white space; one
    with fewer words is one shingle, one without words has none and is linked with nothing. Texts are
    linked if 100 * intersection reaches ``percent`` * union of their sets, and a component is named by its
    smallest doc_id, whose rows are kept.

    Equal sets are one class. Classes that share a band of eight registers are candidates: at the
    similarity of 0.85 a pair shares none of 48 bands with a chance of 2e-7. First the classes of a bucket are
    compared with the one of the smallest doc_id there, which ties most of them; then those that are still
    in different components, with each other. The estimate only spares work: links are those of the full
    sets, of 64-bit hashes of shingles.

    Null counts as empty. Repeated rows are in one class; a null doc_id names a component only if there is no other,
    and is kept there. Other columns are not read; an empty table gives an empty one.
    """
    rows, classes = shingle_classes(docs, shingle)
    cut = bands(classes)
    # Without a doc_id a class comes last.
    order = F.struct(F.col("least").isNull(), "least", "c")
    full = cut.groupBy("bucket").agg(F.min(order).alias("hub"), F.count("*").alias("n")).where("n > 1")
    full = full.select("bucket", F.col("hub.c").alias("hub"))
    buckets = scratch_table(cut.drop("least").join(full.hint("merge"), "bucket"), "buckets")
    stars = buckets.where("hub != c").select(F.col("hub").alias("u"), F.col("c").alias("v")).distinct()
    stars = narrow_table(screened(stars, classes, percent), "pairs")
    links = verified(docs, stars, classes, shingle, percent)
    roots = _roots(links, classes)
    pairs = narrow_table(across(buckets.drop("hub"), roots, classes, percent), "pairs")
    more = verified(docs, pairs, classes, shingle, percent)
    roots = _roots(links.unionByName(more), classes)
    least = classes.select("c", "digest", "least").join(roots.hint("merge"), "c")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.select("digest", "root").join(named.hint("merge"), "root").select("digest", "component_id")
    found = rows.join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _roots(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, root) of every class."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = components(edges)
    found = classes.select("c").join(tied.hint("merge"), F.col("c") == F.col("node"), "left")
    return narrow_table(found.select("c", F.coalesce("root", "c").alias("root")), "roots")
