"""The filter audit and periodic runs."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from areashare.llm import filter_audit, periodicity

DOCS = "doc_id bigint, text string, lang string, fails string, part string, runs int"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words[: rng.choice([90, 400])], k=rng.choice([0, 30, 99, 100, 140])))
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.3:
            text += rng.choice(["#", " é|", " "])
        rows.append((i, text, rng.choice(["en", "fr", None, ""])))
    rows += [(200 + i, rows[i][1], "en") for i in range(0, 60, 2)]
    rows += [(7, rows[7][1], "en"), (7, rows[7][1], "fr"), (8, "another", "en"), (None, rows[1][1], "en"), (None, None, None), (3, None, "de")]
    return [(*row, "x", "y", 1) for row in rows]


def brute_audit(rows, labels):
    good = {i for i, quality, _, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad, _ in labels if bad == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails = "A" * (len(words) < 100)
        fails += "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (i is not None and i > least[text])
        docs.append((lang or "", fails, i in good, i in toxic))
    found = []
    for part in {d[0] for d in docs}:
        inside = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = inside
            for step, own in enumerate(order, 1):
                gone = [d for d in left if own in d[1]]
                left = [d for d in left if own not in d[1]]
                shapley[own] += len(gone)
                failing = sum(own in d[1] for d in inside)
                alone = sum(d[1] == own for d in inside)
                counts = (len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone))
                rows.append((part, "".join(order), step, *counts))
        found += [(*row, shapley[row[1][row[2] - 1]]) for row in rows]
    return sorted(found)


def test_filter_audit(spark):
    rows = corpus()
    labels = [(i, i % 2, int(i % 5 == 0), "z") for i in range(0, 90)]
    labels += [(1, 0, 0, "z"), (2, 1, None, "z"), (None, 1, 1, "z"), (999, 1, 1, "z"), (3, None, 1, "z")]
    found = filter_audit.filter_audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in found.collect()) == brute_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(docs, labels).collect() == []
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None, "", "", 0)], DOCS), labels).collect()
    assert len(one) == 600 and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}


def test_contraction_takes_pass_fail_or_all():
    tensor = np.arange(32).reshape([2] * 5)
    taken = np.array([[0, 1, 2, 2, 0], [2] * 5])
    assert filter_audit.contract(tensor, taken).tolist() == [tensor[0, 1, :, :, 0].sum(), tensor.sum()]


def brute_runs(x, min_length, min_exponent):
    found = {}
    for p in range(1, len(x) // min_exponent + 1):
        i = 0
        while i < len(x) - p:
            j = i
            while j < len(x) - p and x[j] == x[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, min_exponent * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodicity, "GRID", rng.choice([60, 1 << 20]))
    for _ in range(30):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 5, 30, 100, 300]), rng.choice([1, 2, 3, 50])
            text = [rng.randrange(k) for _ in range(n)]
            if n > 60 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                text = [text[i] if i < a else text[a + (i - a) % p] for i in range(n)]
            texts.append(text)
        bounds = rng.choice([(24, 3), (4, 2), (1, 2), (10, 4)])
        found = periodicity.find_runs([np.array(t, np.int64) for t in texts], *bounds)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(t, *bounds) for t in texts]


@pytest.mark.parametrize("modulus", [4, 16, 64, 100])
def test_cover_has_every_distance(modulus):
    cover = periodicity.difference_cover(modulus).tolist()
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))
    assert modulus < 64 or len(cover) < modulus // 3


def test_common_extensions():
    rng = np.random.default_rng(1)
    words = np.r_[-2, np.tile(rng.integers(0, 3, 90), 7), rng.integers(0, 2, 400), -3].astype(np.int32)
    lce = periodicity.CommonExtension(words)
    a, b = rng.integers(0, len(words), (2, 4000))
    a, b = a[a != b], b[a != b]
    for i, j, n in zip(a, b, lce(a, b)):
        most = len(words) - max(i, j)
        differ = np.flatnonzero(words[i : i + most] != words[j : j + most])
        assert n == (differ[0] if len(differ) else most)


def expected_row(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 24, 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(listed), sha(kept))


def test_run_digests(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        k = rng.choice([2, 5, 400])
        words = [f"{rng.choice('éab')}{rng.randrange(k)}" for _ in range(rng.choice([1, 20, 200, 600]))]
        if rng.random() < 0.4:
            part = words[: rng.randint(1, 20)]
            words += part * rng.randint(3, 9) + words[:30] + part * 5
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(9, rows[9][1]), (None, " ".join(["a"] * 40)), (5000, None), (5001, " \n"), (5002, "x " * 70000)]
    df = spark.createDataFrame([(*row, "en", "", "", 1) for row in rows], DOCS)
    found = periodicity.run_digests(periodicity.periodic_runs(df, rewrite=periodicity.planted)).collect()
    key = lambda r: [(v is not None, v) for v in r]
    assert sorted((tuple(r) for r in found), key=key) == sorted((expected_row(*r) for r in rows if r[0] != 5002), key=key) + [
        r for r in map(tuple, found) if r[0] == 5002
    ]
    (long,) = [r for r in found if r.doc_id == 5002]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 70000, 1)


def test_periodic_runs_of_nothing(spark):
    assert periodicity.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        periodicity.periodic_runs(spark.createDataFrame([], DOCS), min_exponent=1)
