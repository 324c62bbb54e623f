"""Hierarchical code sets: first-n-characters prefixes and membership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_prefix(code: Column, length: int) -> Column:
    """The first ``length`` characters of a code."""
    return F.substring(code, 1, length)


@dataclass(frozen=True)
class CodeSet:
    """Codes of one common length, matched against the start of longer codes."""

    codes: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "codes", tuple(dict.fromkeys(self.codes)))
        if not self.codes:
            raise ValueError("a code set needs at least one code")
        if not all(self.codes):
            raise ValueError("a code set cannot hold an empty code")
        # A shorter code would match more than IN does, a longer one never would.
        if len({len(code) for code in self.codes}) != 1:
            raise ValueError(f"codes differ in length: {self.codes}")

    @classmethod
    def of(cls, *codes: str) -> CodeSet:
        return cls(codes)

    @property
    def length(self) -> int:
        return len(self.codes[0])

    def __or__(self, other: CodeSet) -> CodeSet:
        return CodeSet(self.codes + other.codes)

    def __len__(self) -> int:
        return len(self.codes)

    def matches(self, code: Column) -> Column:
        """``substring(code, 1, length) IN codes`` in a form Parquet can prune on.

        A function around the column hides it from the scan. The range of the codes, in terms of
        the bare column, is pushed for any number of them; a hash lookup decides.
        """
        lowest, highest = min(self.codes), max(self.codes)
        in_range = (code >= lowest) & ((code < highest) | code.startswith(highest))
        return in_range & code_prefix(code, self.length).isin(*self.codes)
