"""Exact deduplication, line deduplication and mixing."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from areashare.llm import line_dedup, mixing
from areashare.llm.exact_dedup import exact_dedup

DOCS = "doc_id bigint, text string, source string, lang string, digest string, n bigint"


def docs(spark, *rows):
    return spark.createDataFrame([(i, text, "s", "en", "x", 1) for i, text in rows], DOCS)


def deduped(spark, tmp_path, df, **how):
    path = str(tmp_path / "docs.parquet")
    df.write.mode("append").parquet(path)
    found = exact_dedup(spark, path, **how)
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=lambda r: (r[0] is None, r)
    )


EQUAL = (
    (5, "a b"), (3, "ab"), (9, "a \n b"), (1, None), (2, ""), (7, " \t"), (4, "é"), (4, "é"), (None, "ab"), (6, "a b"),
)
EXPECTED = [
    (1, 7, 3, False), (2, 7, 3, False), (3, 9, 4, False), (4, 4, 2, False), (4, 4, 2, True),
    (5, 9, 4, False), (6, 6, 1, True), (7, 7, 3, True), (9, 9, 4, True), (None, 9, 4, False),
]


def test_equal_texts(spark, tmp_path):
    assert deduped(spark, tmp_path, docs(spark, *EQUAL)) == EXPECTED


def test_colliding_digests_are_told_apart_by_bytes(spark, tmp_path):
    found = deduped(spark, tmp_path, docs(spark, *EQUAL), digest=lambda text: F.lit("same"))
    assert found == EXPECTED


def test_state_is_kept_between_calls(spark, tmp_path):
    state = str(tmp_path / "state")
    assert deduped(spark, tmp_path, docs(spark, (2, "a")), state_dir=state) == [(2, 2, 1, True)]
    later = deduped(spark, tmp_path, docs(spark, (1, "a"), (3, "b")), state_dir=state)
    assert later == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]


def test_nothing_to_dedup(spark, tmp_path):
    assert deduped(spark, tmp_path, docs(spark).limit(0)) == []


def cut(spark, rows, **how):
    found = line_dedup.line_dedup(docs(spark, *rows), **how)
    assert found.columns[:-1] == docs(spark).columns
    return sorted(((r.doc_id, r.text, r.n_lines_removed) for r in found.collect()), key=lambda r: (r[0] is None, r))


def test_a_shared_run_of_lines_goes_wherever_it_stands(spark):
    run = [f"shared line number {i}" for i in range(60)]
    rows = [
        (1, "\n".join(["head one", *run, "tail one"])),
        (2, "\n".join(["other head", "more", *run, "tail two"])),
    ]
    first, second = cut(spark, rows)
    assert first == (1, rows[0][1], 0)
    # All but what stands before the first and behind the last common bound.
    assert second[2] >= 45 and second[1].startswith("other head\nmore\n") and second[1].endswith("tail two")


def test_a_long_line_is_a_passage_and_a_short_one_is_not(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), "only a few words"
    found = cut(spark, [(2, f"{short}\n{long}\nb"), (1, f"a\n{long}\n{short}")], divisor=1)
    assert found == [(1, f"a\n{long}\n{short}", 0), (2, f"{short}\nb", 1)]


def test_runs_of_short_lines_go_whole_in_any_surroundings(spark):
    rows, expected = [], []
    for n, blank in ((2, False), (3, True), (4, False), (5, True), (40, False), (60, True)):
        run = [" ".join(f"r{n}w{i}x{k}" for k in range(-(-50 // n))) for i in range(n)]
        run = [line for pair in zip(run, [""] * n) for line in pair][:-1] if blank else run
        for k in range(1, 7):
            head, tail = [f"head {n} {k} {i}" for i in range(k)], [f"tail {n} {k}"]
            rows.append((100 * n + k, "\n".join([*head, *run, *tail])))
            expected.append((*rows[-1], 0) if k == 1 else (100 * n + k, "\n".join([*head, *tail]), len(run)))
    assert cut(spark, rows) == expected


def test_lines_that_share_a_hash_are_told_apart_by_bytes(spark, monkeypatch):
    real = F.xxhash64
    # All lines collide, and all keys with them.
    weak = lambda *columns: real(*columns) if "text" in str(columns[0]) else F.lit(7).cast("bigint")
    a, b = " ".join(["a"] * 60), " ".join(["b"] * 60)
    monkeypatch.setattr(line_dedup.F, "xxhash64", weak)
    assert cut(spark, [(1, a), (2, b), (3, a)], divisor=1) == [(1, a, 0), (2, b, 0), (3, "", 1)]


def test_a_run_goes_with_a_short_tail_and_not_below_fifty_words(spark):
    long, short = " ".join(f"w{i}" for i in range(55)), " ".join(f"v{i}" for i in range(24))
    rows = [(1, f"a\n{long}\ntail\nb"), (2, f"c\n{long}\ntail\nd"), (3, f"e\n{short}\n{short}\n{short}"), (4, f"f\n{short}\ng")]
    found = cut(spark, rows, divisor=10**9)
    assert found == [(1, rows[0][1], 0), (2, "c\nd", 2), (3, rows[2][1], 0), (4, rows[3][1], 0)]


def test_lines_of_odd_rows(spark):
    long = " ".join(["word"] * 60)
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, long), (4, long), (None, long), (5, long)]
    assert cut(spark, rows, divisor=1) == [
        (1, None, 0), (2, "", 0), (3, " \n \n", 0), (4, long, 0), (4, long, 0), (5, "", 1), (None, "", 1),
    ]
    assert cut(spark, []) == []


def test_colliding_keys_are_told_apart_by_bytes(spark, monkeypatch):
    real = F.xxhash64

    def weak(*columns):
        # Hashes of arrays of line hashes, which are the keys, all collide.
        return F.lit(7).cast("bigint") if "slice" in str(columns[0]) else real(*columns)

    a, b = " ".join(["a"] * 60), " ".join(["b"] * 60)
    monkeypatch.setattr(line_dedup.F, "xxhash64", weak)
    assert cut(spark, [(1, a), (2, b), (3, a)], divisor=1) == [(1, a, 0), (2, b, 0), (3, "", 1)]


def test_a_text_of_many_lines(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(50_000))
    ((_, kept, removed),) = cut(spark, [(1, text)])
    assert removed > 30_000 and len(kept.split("\n")) == 50_000 - removed


MIXED = "doc_id bigint, text string, source string, lang string, topic string, weight double"


def test_weights_meet_the_marginals(spark):
    rows = [
        (i, "word " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}", None if i % 4 else "en", "x", 0.0)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, MIXED)
    found = mixing.mix(df, rounds=30).toPandas()
    assert len(found) == 400 and set(found.topic) == {"prose"}
    expected = found.tokens * found.probability
    for name, power in mixing.TEMPERATURES.items():
        tokens = found.groupby(name, dropna=False).tokens.sum() ** power
        share = expected.groupby(found[name].fillna("none")).sum() / expected.sum()
        tokens.index = tokens.index.fillna("none")
        for value, wanted in (tokens / tokens.sum()).items():
            assert share[value] == pytest.approx(wanted, abs=1e-3)
    assert found.probability.max() == 1 and found[found.probability == 1].sampled.all()


def test_given_targets(spark):
    rows = [(i, "a b", "abc"[i % 3], "de" if i % 2 else "en", "x", 0.0) for i in range(600)]
    df = spark.createDataFrame(rows, MIXED)
    targets = {
        "source": spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, target double"),
        "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, target double"),
        "topic": spark.createDataFrame([("prose", 1.0)], "topic string, target double"),
    }
    found = mixing.mix(df, targets=targets).groupBy("source").agg(F.max("probability"), F.count_if("sampled"))
    shares = {r[0]: r[1:] for r in found.collect()}
    assert shares["a"] == (1.0, 200) and shares["c"] == (0.0, 0)
    assert shares["b"][0] == pytest.approx(1 / 3) and 40 < shares["b"][1] < 95


def test_a_stray_row_hardly_changes_the_pipelines_mix(spark):
    import corpus_pipeline

    rows = [(i, "word " * 300, f"s{i % 4}", "en" if i % 3 else "de", "x", 0.0) for i in range(1200)]
    stray = [(5000, "word", None, "en", "x", 0.0), (5001, "word " * 300, "new", None, "x", 0.0)]
    kept = []
    for extra in ([], stray[:1], stray):
        df = spark.createDataFrame(rows + extra, MIXED)
        kept.append({r.doc_id for r in corpus_pipeline.mix_sources(spark, df, "").collect()})
        assert kept[-1] >= {r[0] for r in extra}
        found = mixing.mix(df, short=mixing.SHORT).toPandas()
        expected, wanted = found.tokens * found.probability, found.groupby("source", dropna=False).tokens.sum() ** 0.8
        share = expected.groupby(found.source, dropna=False).sum() / expected.sum()
        assert (share - wanted / wanted.sum()).abs().max() < 0.0102
    assert all(len(kept[0] ^ other) < 0.05 * len(kept[0]) for other in kept[1:])


def test_the_query_stands_a_stray_row(spark, tmp_path):
    from areashare.llm.queries import op9_mixing

    rows = [(i, "word " * (200 + i % 90), f"s{i % 4}", "en" if i % 3 else "de", "x", 0.0) for i in range(1200)]
    kept = []
    for extra in ([], [(5000, "word", None, "en", "x", 0.0)]):
        folder = tmp_path / str(len(extra))
        table = spark.createDataFrame(rows + extra, MIXED).withColumn("n_chars", F.length("text").cast("bigint"))
        table.write.parquet(str(folder / "documents.parquet"))
        kept.append({r.doc_id for r in op9_mixing(spark, str(folder)).where("sampled").collect()})
    assert 5000 in kept[1] and len(kept[0] ^ kept[1]) < 0.05 * len(kept[0])


def test_target_and_reached_shares(spark):
    # Dimensions that hang together, so that a round undoes part of the one before.
    rows = [(i, "word " * (1 + i % 5), f"s{i * i % 11 % 3}", "de" if i % 4 > i % 3 else None, "x", 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, MIXED)
    found = mixing.mix_shares(df).collect()
    assert {(r.dimension, r.value) for r in found} >= {("source", "s0"), ("lang", None), ("topic", "prose")}
    for name, power in mixing.TEMPERATURES.items():
        own = [r for r in found if r.dimension == name]
        tokens = mixing._mark(df).groupBy(name).agg(F.sum("tokens")).collect()
        total = sum(t[1] ** power for t in tokens)
        assert {r.value: pytest.approx(r.target) for r in own} == {t[0]: t[1] ** power / total for t in tokens}
        assert sum(r.reached for r in own) == pytest.approx(1)
        assert all(abs(r.reached - r.target) <= mixing.DEVIATION + 1e-6 for r in own)
    assert mixing.mix_shares(spark.createDataFrame([], MIXED)).collect() == []


def test_raking_against_brute_force(spark):
    rng = random.Random(9)
    cells = [(f"s{a}" if a else None, f"l{b}", f"t{c}", rng.randint(1, 500)) for a in range(5) for b in range(4) for c in range(3) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    names = list(mixing.TEMPERATURES)
    targets = []
    for d, power in enumerate(mixing.TEMPERATURES.values()):
        sums = collections.Counter()
        for cell in cells:
            sums[cell[d]] += cell[3]
        whole = sum(n**power for n in sums.values())
        targets.append({value: n**power / whole for value, n in sums.items()})
    weights = [1.0] * len(cells)
    for _ in range(8):
        for d in range(3):
            held = collections.Counter()
            for cell, w in zip(cells, weights):
                held[cell[d]] += cell[3] * w
            weights = [w * targets[d][cell[d]] / held[cell[d]] for cell, w in zip(cells, weights)]
    found = mixing.rake(mixing.tempered_targets(df, mixing.TEMPERATURES), names, rounds=8, deviation=1.0).collect()
    assert {tuple(r)[:3]: pytest.approx(r.weight, rel=1e-9) for r in found} == {c[:3]: w for c, w in zip(cells, weights)}


def test_contradicting_targets_come_to_an_end(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAST_ROUND", 3)
    df = spark.createDataFrame([("a", "x", 5, 0.9, 0.2), ("b", "y", 5, 0.1, 0.8)], "s string, l string, tokens bigint, target_s double, target_l double")
    found = mixing.rake(df, ["s", "l"], rounds=2).collect()
    assert sorted(r.weight * r.tokens for r in found) == [pytest.approx(0.2), pytest.approx(0.8)]


def test_topics_and_tokens(spark):
    texts = {
        "a | b": ("table", 3),
        "!! no!!": ("shout", 2),
        "!! no !": ("prose", 3),
        " LICENCE\t\x0bof use ": ("licence", 3),
        "CopyRight\u00a0me": ("licence", 1),
        "a@b.": ("contact", 1),
        "@ b.": ("prose", 2),
        "": ("prose", 1),
        " \r\n ": ("prose", 1),
        None: ("prose", 1),
    }
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    found = df.select("text", mixing.topic_of(F.col("text")), mixing.tokens_of(F.col("text"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == texts


def test_mixing_odd_rows(spark):
    rows = [(None, None, None, None, None, None), (1, "", "s", "en", "x", 1.0), (1, "", "s", "en", "x", 1.0)]
    found = mixing.mix(spark.createDataFrame(rows, MIXED)).collect()
    assert [r.tokens for r in found] == [1, 1, 1] and found[0].row.asDict().keys() == {*"doc_id text source lang topic weight".split()}
    assert len({(r.doc_id, r.sampled) for r in found}) == 2
    assert mixing.mix(spark.createDataFrame([], MIXED)).collect() == []


def test_no_python_in_native_plans(spark, tmp_path):
    from helpers import plan

    docs(spark, *EQUAL).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    for found in (
        line_dedup.line_dedup(df),
        mixing.mix(df),
        mixing.mix_shares(df),
        exact_dedup(spark, str(tmp_path / "docs")),
    ):
        assert "Python" not in plan(found) and "Arrow" not in plan(found)
