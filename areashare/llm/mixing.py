"""Mixing to target weights: token weights raked to marginals, documents sampled to match."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashare.sources.storage import narrow_table

WHITE_SPACE = r"[\x20\x09-\x0D]+"
# Raking goes through so many rounds at least, and on until no share is further than this from its target, or until
# the last of them: targets that contradict each other are never met.
ROUNDS = 6
DEVIATION = 1e-3
LAST_ROUND = 60
SEED = "mix-1"
# Marginal shares are raised to these powers and rescaled: below 1, large values give way.
TEMPERATURES = {"source": 0.8, "lang": 0.9, "topic": 0.95}
# Share of the tokens asked for that rare cells may lack, in the query and in the pipeline.
SHORT = 0.01
# Forms of text, by the first pattern found; the last holds the rest.
TOPICS = (
    ("table", r" \| "),
    ("shout", r"!! .*!!"),
    ("licence", r"(?i)licen[sc]e|copyright"),
    ("contact", r"[A-Za-z0-9.]+@[A-Za-z0-9]+\."),
)
# What a match holds one of, in lower case; patterns are tried on such texts alone.
HELD = {"table": (" | ",), "shout": ("!! ",), "licence": ("licen", "copyright"), "contact": ("@",)}


def topic_of(text: Column) -> Column:
    """The form of a text as its topic; null counts as empty."""
    found = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        held = functools.reduce(Column.__or__, [F.lower(text).contains(part) for part in HELD[name]])
        found = F.when(held & text.rlike(pattern), name).otherwise(found)
    return F.coalesce(found, F.lit("prose"))


def tokens_of(text: Column) -> Column:
    """Words, at least 1, so that every document weighs something."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")
    return F.greatest(F.lit(1), F.size(words)).cast("bigint")


def _with_sums(cells: DataFrame, name: str, value: Column, into: str) -> DataFrame:
    """``cells`` with the sum of ``value`` over all with the same ``name``.

    Summed before the shuffle and joined back, so that the cells of a common value stay in many tasks.
    """
    sums = cells.groupBy(F.col(name).alias("_value")).agg(F.sum(value).alias(into))
    return cells.join(sums, F.col(name).eqNullSafe(F.col("_value"))).drop("_value")


def tempered_targets(cells: DataFrame, temperatures: Mapping[str, float]) -> DataFrame:
    """``cells`` with the share of tokens that each dimension's value is to have."""
    sums = cells
    for name in temperatures:
        sums = _with_sums(sums, name, F.col("tokens").cast("double"), f"target_{name}")
    parts = {
        name: F.pow(F.col(f"target_{name}"), F.lit(power)) for name, power in temperatures.items()
    }
    # A value's cells hold all its tokens, so that each value counts once.
    totals = sums.agg(
        *[F.sum(part * F.col("tokens") / F.col(f"target_{name}")).alias(name) for name, part in parts.items()]
    ).first()
    return sums.withColumns(
        {f"target_{name}": part / F.lit(totals[name] or 1.0) for name, part in parts.items()}
    )


def given_targets(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """``cells`` with given shares: per dimension a table of its name and ``target``.

    A value without a target gets none of the tokens.
    """
    for name, target in targets.items():
        wanted = target.select(F.col(name).alias("_value"), F.col("target").cast("double").alias("_target"))
        cells = cells.join(wanted, F.col(name).eqNullSafe(F.col("_value")), "left")
        share = F.coalesce("_target", F.lit(0.0)).alias(f"target_{name}")
        cells = cells.select(*[c for c in cells.columns if c[0] != "_"], share)
    return cells


def marginals(raked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per dimension and value its target and the share of the tokens that the weights give it, both of 1.

    ``weight`` may be a probability as well: then these are the shares to expect of the sample.
    """
    asked = F.col("tokens") * F.col("weight")
    total = raked.agg(F.sum(asked).alias("total"))
    per_value = [
        raked.groupBy(F.lit(name).alias("dimension"), F.col(name).alias("value")).agg(
            F.max(f"target_{name}").alias("target"), F.sum(asked).alias("held")
        )
        for name in names
    ]
    reached = F.when(F.col("total") > 0, F.col("held") / F.col("total")).otherwise(0.0)
    # The total is one row.
    found = functools.reduce(DataFrame.unionByName, per_value)
    return found.select("dimension", "value", "target", "held").withColumn("total", total.scalar()).select(
        "dimension", "value", "target", reached.alias("reached")
    )


def rake(
    cells: DataFrame, names: Sequence[str], rounds: int = ROUNDS, deviation: float = DEVIATION
) -> DataFrame:
    """Iterative proportional fitting: ``cells`` with a weight such that the tokens
    times the weights have the target shares in every dimension.

    A round goes through the dimensions and scales the cells of each value to its target. What is summed per
    value are cells, one row for each combination with the values of the other dimensions; documents
    stay where they are. A round is one plan, and its cells are written down. After ``rounds`` of them it goes on while some
    share is more than ``deviation`` from its target and a round still takes a hundredth off the greatest
    deviation, up to ``LAST_ROUND``.
    """
    before = float("inf")
    raked = cells.withColumn("weight", F.lit(1.0))
    for done in range(1, max(rounds, LAST_ROUND) + 1):
        for name in names:
            raked = _with_sums(raked, name, F.col("tokens") * F.col("weight"), "_held")
            factor = F.when(F.col("_held") > 0, F.col(f"target_{name}") / F.col("_held")).otherwise(0.0)
            raked = raked.withColumn("weight", F.col("weight") * factor).drop("_held")
        raked = narrow_table(raked, "raked")
        if done >= rounds:
            apart = marginals(raked, names).agg(F.max(F.abs(F.col("reached") - F.col("target")))).first()[0]
            if apart is None or apart <= deviation or apart > 0.99 * before:
                break
            before = apart
    return raked


def level(raked: DataFrame, short: float) -> float:
    """The weight from which on documents all stay.

    Cells above it hold fewer tokens than their weights ask for. It is the least weight at which what they lack is
    ``short`` of all tokens asked for; with 0 it is the greatest weight. What is lacking falls with the level along a
    convex line, so that Newton's steps rise to it; each is an aggregate over the cells.
    """
    asked = F.sum(F.col("tokens") * F.col("weight"))
    top, total = raked.agg(F.max("weight"), asked).first()
    if not top or not short:
        return top or 1.0
    found = 0.0
    while True:
        held, tokens = raked.where(F.col("weight") > found).agg(asked, F.sum("tokens")).first()
        risen = (held - short * total) / tokens if tokens else found
        if risen <= found * (1 + 1e-12):
            return found
        found = risen


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; null counts as an id of its own."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _mark(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id"),
        F.col("source"),
        F.col("lang"),
        topic_of(F.col("text")).alias("topic"),
        tokens_of(F.col("text")).alias("tokens"),
    )


def calibrate(
    marked: DataFrame,
    temperatures: Mapping[str, float] = TEMPERATURES,
    targets: Mapping[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    short: float = 0.0,
) -> DataFrame:
    """The cells of ``marked`` documents: source, lang, topic, tokens, their targets, and the probability as ``weight``."""
    names = list(TEMPERATURES)
    cells = narrow_table(marked.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cells")
    aimed = given_targets(cells, targets) if targets else tempered_targets(cells, temperatures)
    # Written down, as the sums of a round read it several times over.
    raked = rake(narrow_table(aimed, "targets"), names, rounds)
    top = level(raked, short)
    return raked.withColumn("weight", F.least(F.lit(1.0), F.round(F.col("weight") / F.lit(top), 9)))


def mix_shares(docs: DataFrame, **how) -> DataFrame:
    """What ``mix`` called alike aims at and reaches: dimension, value, target and reached share of tokens.

    Reached shares are those to expect of the sample, with rare cells that are taken whole. A value of NULL is a row like
    any other; an empty table gives no rows.
    """
    return marginals(calibrate(_mark(docs), **how), list(TEMPERATURES))


def mix(
    docs: DataFrame,
    temperatures: Mapping[str, float] = TEMPERATURES,
    targets: Mapping[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    seed: str = SEED,
    short: float = 0.0,
) -> DataFrame:
    """Every row with its topic, tokens, probability and whether it is sampled.

    Columns: doc_id, source, lang, topic, tokens, probability, sampled, and ``row``, the input row. Token
    weights are raked to the marginals of source, lang and topic; probabilities are the weights divided by
    the greatest of them, so that documents of the most wanted cell all stay, and the expected tokens
    have the target shares. A rare cell of great weight so decides how much of the rest stays. With ``short``, such
    cells are taken whole and the rest is weighed as if they met their targets, until they lack that share of
    all tokens asked for; see ``level``. The expected tokens then differ from the target shares by no more than
    ``short`` / (1 - ``short``). ``targets`` replace the tempered shares, see ``given_targets``. A null source or lang is a value like any other, a null text counts as empty and weighs one
    token. Repeated rows, and all with one doc_id in one cell, stay or go together. An empty
    table gives an empty one.
    """
    marked = _mark(docs)
    names = list(TEMPERATURES)
    cells = calibrate(marked, temperatures, targets, rounds, short)
    shares = cells.select(
        *[F.col(name).alias(f"_{name}") for name in names], F.col("weight").alias("probability")
    )
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in names]
    return marked.join(shares, same[0] & same[1] & same[2]).select(
        "row",
        "doc_id",
        *names,
        "tokens",
        "probability",
        (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"),
    )
