"""Codes of any mix of lengths as sorted ranges that a scan can prune on."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from areashare.functions.codes import code_prefix

# Ranges that are handed to the scan, however many codes there are.
PUSHED_RANGES = 16
# The last code point, and the first and last of those that no text holds.
LAST, SURROGATES = 0x10FFFF, (0xD800, 0xDFFF)

Range = tuple[str, str | None]


def after_prefix(prefix: str) -> str | None:
    """The least text above all that start with ``prefix``; None if there is none."""
    kept = prefix.rstrip(chr(LAST))
    if not kept:
        return None
    point = ord(kept[-1]) + 1
    return kept[:-1] + chr(SURROGATES[1] + 1 if SURROGATES[0] <= point <= SURROGATES[1] else point)


def _position(text: str, width: int) -> int:
    """Where a text of at most ``width`` characters stands in the order of all."""
    return functools.reduce(lambda at, c: at * (LAST + 2) + c, [*(ord(c) + 1 for c in text), *[0] * (width - len(text))], 0)


@dataclass(frozen=True)
class PrefixSet:
    """Codes of any lengths; a code belongs if it starts with one of them.

    Codes under a shorter one of the set add nothing and are left out. A NULL code gives NULL.
    """

    codes: tuple[str, ...]

    def __post_init__(self):
        if not self.codes:
            raise ValueError("a prefix set needs at least one code")
        if not all(self.codes):
            raise ValueError("a prefix set cannot hold an empty code")
        kept: list[str] = []
        for code in sorted(set(self.codes)):
            # Sorted, whatever starts with a code comes right after it.
            if not kept or not code.startswith(kept[-1]):
                kept.append(code)
        object.__setattr__(self, "codes", tuple(kept))

    @classmethod
    def of(cls, *codes: str) -> PrefixSet:
        return cls(codes)

    def __or__(self, other: PrefixSet) -> PrefixSet:
        return PrefixSet(self.codes + other.codes)

    def __len__(self) -> int:
        return len(self.codes)

    def ranges(self, at_most: int | None = None) -> list[Range]:
        """Disjoint sorted ranges [from, to) of all codes that belong; to None is open.

        Neighbours without a gap are one range. Beyond ``at_most`` ranges the smallest gaps are closed, so that
        the ranges hold more than the codes that belong, never less.
        """
        found: list[Range] = []
        for code in self.codes:
            if found and found[-1][1] == code:
                found[-1] = (found[-1][0], after_prefix(code))
            else:
                found.append((code, after_prefix(code)))
        if at_most is None or len(found) <= at_most:
            return found
        width = max(map(len, self.codes))
        gaps = [
            (_position(below[0], width) - _position(above[1], width), number)
            for number, (above, below) in enumerate(zip(found, found[1:]))
        ]
        open_gaps = sorted(number for _, number in sorted(gaps)[len(gaps) - at_most + 1 :])
        starts, ends = [0, *(n + 1 for n in open_gaps)], [*open_gaps, len(found) - 1]
        return [(found[a][0], found[b][1]) for a, b in zip(starts, ends)]

    def matches(self, code: Column, pushed: int = PUSHED_RANGES) -> Column:
        """Whether a code belongs: ``pushed`` ranges on the bare column for the scan, lookups by length to decide."""
        within, belongs = F.lit(False), F.lit(False)
        for low, high in self.ranges(max(1, pushed)):
            within |= (code >= low) & (code < high) if high is not None else code >= low
        by_length: dict[int, list[str]] = {}
        for member in self.codes:
            by_length.setdefault(len(member), []).append(member)
        for length, members in by_length.items():
            belongs |= code_prefix(code, length).isin(*members)
        return within & belongs
