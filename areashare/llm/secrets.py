"""Secret scans: all rules in one pass over the bytes of a text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashare.llm.automaton import RuleSet, spans_in_characters
from areashare.llm.tokens import as_bytes, slices

# The base rules, in the order of their kinds. A run of 32 hex digits and more is
# the longest run of hex digits wherever that is long enough.
HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = {
    "assign": (HEAD + r"[A-Za-z0-9+/_.=-]+", True),
    "access": (r"AKIA[A-Z0-9]+", False),
    "hex": (r"[0-9a-f]{32,}", False),
}
# Further kinds, and the bytes that a match of theirs has at least.
ADDED = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False),
    "signed_token": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False),
    "host_token": (r"gh[opsur]_[A-Za-z0-9]+", False),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]+", False),
    "login_url": (r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@", False),
}
LEAST = {"access": 16, "hex": 32, "signed_token": 40, "host_token": 40, "chat_token": 20, "login_url": 12}
ASSIGNED = 8

SPANS = "doc_id bigint, spans array<struct<kind: string, start: bigint, `end`: bigint>>"


@functools.lru_cache(maxsize=1)
def rules() -> RuleSet:
    return RuleSet(BASE | ADDED)


@functools.lru_cache(maxsize=1)
def head() -> RuleSet:
    return RuleSet({"head": (HEAD, True)})


def _kept(kind: str, text: bytes, begin: int, end: int) -> bool:
    if kind == "assign":
        return end - head().longest(0, text, begin) >= ASSIGNED
    return end - begin >= LEAST.get(kind, 0)


def spans_of(texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """Per text its spans (kind, start, end) in code points, by start, then in the order of kinds."""
    order = {kind: i for i, kind in enumerate(rules().names)}
    out = []
    for text, found in zip(texts, rules().find_all(texts)):
        spans = []
        for kind, places in found.items():
            good = [place for place in places if _kept(kind, text, *place)]
            spans += [(kind, a, b) for a, b in spans_in_characters(text, good)]
        out.append(sorted(spans, key=lambda s: (s[1], order[s[0]])))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for begin, end in slices(texts):
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in spans]
                for spans in spans_of(texts[begin:end])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, end - begin), pa.array(found, kind)],
                names=["doc_id", "spans"],
            )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of the secrets in every whole text.

    Rules are compiled once per worker into one minimal automaton, whose transition array takes all rules
    through the bytes of a text at once. Places are code points, the end exclusive; spans are ordered by start,
    then by the order of the rules. Matches of one rule do not overlap, those of different rules may. A text
    without secrets, empty or null, has no spans. Every row gives a row, repeated ones too; other columns
    are not read.
    """
    text = docs.select(F.col("doc_id").cast("bigint"), "text")
    return text.mapInArrow(_scan, SPANS)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    one = F.transform(
        spans,
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(one, ",")


def secret_digests(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as one text."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE)
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    return spans.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
