"""SimHash near-duplicates: fingerprints, a multi-index of them, and their components."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areashare.llm.tokens import map_texts, parts
from areashare.sources.storage import narrow_table, scratch_table

BITS = 64
SEGMENTS = 2
SHINGLE = 3
SEED = 42
DISTANCE = 2
# Fingerprints under one value of a segment beyond which its keys get further bits.
CROWD = 64
# Shingle hashes whose bits are counted at a time.
COUNTED = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if over half of the shingles' hashes have it set; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(count)),
        np.uint64,
        count,
    )
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, count, COUNTED):
        part = hashes[begin : begin + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (text for _, some in parts(batch, batch.column(1)) for text in some)
            found = [fingerprint(text, shingle, seed) for text in texts]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], names=["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit integer, for every row and whole text."""
    text = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_texts(text, _fingerprints(shingle, seed), "doc_id bigint, bits bigint")


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("bigint")


def _whole(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def _changes(bits: Iterable[int], radius: int) -> list[int]:
    """Every change of at most ``radius`` of ``bits``, none first."""
    bits = list(bits)
    return [_whole(some) for k in range(radius + 1) for some in itertools.combinations(bits, k)]


def _segments(segments: int) -> list[range]:
    """The bits of each segment."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [range(begin, end) for begin, end in zip(cuts, cuts[1:])]


def _places(segments: int, radius: int) -> Column:
    """Where to look: each segment's number and the values in the ball around its own value.

    Of two values that differ one alone has the highest of the differing bits, and that one looks for the
    other; the other's change is null.
    """
    places = []
    for number, bits in enumerate(_segments(segments)):
        own = F.col("bits").bitwiseAND(_long(_whole(bits)))
        for change in _changes(bits, radius):
            highest = _long(1 << change.bit_length() >> 1)
            value = own.bitwiseXOR(_long(change))
            value = F.when(own.bitwiseAND(highest) != 0, value) if change else value
            places.append(F.struct(F.lit(number).cast("tinyint").alias("segment"), value.alias("value")))
    return F.array(*places)


def _further(segments: int) -> Column:
    """Further keys under a crowded value: the ball of half the distance around the bits outside of the segment."""
    keys = F.array(_long(0))
    for number, bits in enumerate(_segments(segments)):
        outside = [b for b in range(BITS) if b not in bits]
        rest = F.col("bits").bitwiseAND(_long(_whole(outside)))
        ball = F.array(*[rest.bitwiseXOR(_long(c)) for c in _changes(outside, (DISTANCE + 1) // 2)])
        keys = F.when(F.col("crowded") & (F.col("segment") == number), ball).otherwise(keys)
    return keys


def candidates(distinct: DataFrame, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Pairs (u, v), u > v, of fingerprints that the index brings together, some several times.

    Each fingerprint is entered once in each segment's table, under its value there, and looks in each table under all
    values within ``DISTANCE // segments`` bits: of two within ``DISTANCE`` bits, one segment differs by no
    more than that. Where a value has more than ``crowd`` fingerprints, both sides add further keys, the ball of half
    the distance around the other bits, which two within the distance share; so what a key brings together
    is bounded, and whoever looks meets at most ``crowd`` under any other value.
    """
    # Each row becomes many: few files of fingerprints are much work.
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("bits").repartition(n, "bits")
    entries = spread.select("bits", F.inline(_places(segments, 0)))
    looks = spread.select("bits", F.inline(_places(segments, DISTANCE // segments))).where("value is not null")
    crowded = entries.groupBy("segment", "value").count().where(F.col("count") > crowd)
    crowded = narrow_table(crowded.select("segment", "value", F.lit(True).alias("crowded")), "crowded")

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        marked = rows.join(crowded, ["segment", "value"], "left")
        return marked.select("segment", "value", F.explode(_further(segments)).alias("rest"), F.col("bits").alias(name))

    met = keyed(looks, "a").join(keyed(entries, "b"), ["segment", "value", "rest"]).where("a != b")
    return met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def links(distinct: DataFrame, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """All links (u, v), u > v, of fingerprints within two bits of each other: candidates whose whole distance is."""
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    return candidates(distinct, segments, crowd).where(near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), u > v; the root is the smallest node.

    Alternating stars: each round ties larger neighbours to the smallest one known and then each
    node's smaller neighbours to the smallest of them, until every node is tied to its root alone. Rounds
    grow with the logarithm of the longest chain. Neighbours are joined, never gathered, and a
    round's edges are written to the shared folder. ``edges`` are read twice: better a table than a plan of much work.
    """
    edges = edges.select("u", "v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # Larger neighbours of u go to the smallest node around u.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        after = narrow_table(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        # Stars only: no node is both a root and tied to another one, and none is tied twice.
        n, tied = after.agg(F.count("*"), F.count_distinct("u")).first()
        roots = after.select(F.col("v").alias("u")).distinct()
        if n == tied and after.join(roots, "u", "left_semi").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after


def classes(distinct: DataFrame) -> DataFrame:
    """(bits, root) of every distinct fingerprint; the root names its component."""
    distinct = narrow_table(distinct.select("bits").distinct(), "fingerprints")
    roots = components(narrow_table(links(distinct), "edges"))
    rooted = distinct.join(roots, distinct.bits == roots.node, "left")
    return narrow_table(rooted.select("bits", F.coalesce("root", "bits").alias("root")), "components")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    A component holds all documents that links of at most two differing bits connect, and is named by its
    smallest doc_id. Texts are lower-cased in A-Z and split at ASCII white space; a text with fewer words
    than a shingle is one shingle, one without words, or null, has fingerprint zero and is linked like
    any other. Repeated rows get the same component; a null doc_id names a component only if
    there is no other. An empty table gives an empty one; other columns are not read.
    """
    marked = scratch_table(fingerprints(docs, shingle, seed), "fingerprints")
    rooted = classes(marked)
    least = marked.groupBy("bits").agg(F.min("doc_id").alias("least"))
    least = least.join(rooted, "bits").groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(named, "bits").select(
        "doc_id",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def _with_bits(at: int, shingle: int, seed: int):
    """Rows with their fingerprints; the text is field ``at`` of the row, so that it is handed over once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, batch.column("_row").field(at)):
                found = [fingerprint(text, shingle, seed) for text in texts]
                bits = pa.array(np.array(found, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, bits], names=["_row", "_id", "_bits"])

    return run


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the smallest doc_id.

    Of several rows with that doc_id one stays, a null doc_id only if there is no other; the rest is
    as in ``simhash_groups``. Rows are written once with their fingerprints and a number, so that
    the choice is made on numbers alone.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    packed = docs.select(row, F.col("doc_id").cast("bigint").alias("_id"))
    at = [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([packed.schema["_row"], packed.schema["_id"], T.StructField("_bits", T.LongType())])
    rows = map_texts(packed, _with_bits(at, shingle, seed), schema)
    rows = scratch_table(rows.withColumn("_nth", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("_id").isNull(), "_id", "_nth")
    first = rows.groupBy(F.col("_bits").alias("bits")).agg(F.min(order).alias("first"))
    first = first.join(classes(first), "bits").groupBy("root").agg(F.min("first").alias("first"))
    kept = first.select(F.col("first._nth").alias("_nth"))
    return rows.join(kept, "_nth", "left_semi").select("_row.*")
