"""HyperMinHash: registers, estimates, bands and the components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from areashare.llm import hyperminhash, key_filter, simhash, tokens

DOCS = "doc_id bigint, text string, digest string, c bigint, least int, n_shingles string"


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").split(" ") if w]
    if len(words) < 3:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def brute_groups(rows, percent=85):
    sets = [brute_set(text) for _, text in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=sorted)
    root = dict(zip(distinct, distinct))

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    component = [least.get(find(s)) if s else i for (i, _), s in zip(rows, sets)]
    return sorted(((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, component)), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)] + ["É", "ß"]
    rows = []
    for _ in range(n):
        text = rng.choices(words, k=rng.choice([1, 2, 3, 9, 40, 300]))
        for _ in range(rng.choice([1, 1, 1, 3, 12])):
            other = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n", " \t "]).join(other))
    rows = [(1000 - i, rng.choice([text, text.upper() if "ß" not in text and "É" not in text else text])) for i, text in enumerate(rows)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), rows[0], rows[0], (None, rows[5][1]), (None, "quite alone here"), (None, None)]
    return rows


def groups(spark, rows, **how):
    df = spark.createDataFrame([(i, text, "x", 1, 2, "y") for i, text in rows], DOCS)
    return sorted((tuple(r) for r in hyperminhash.minhash_groups(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_full_sets(spark, seed):
    rows = corpus(seed)
    assert groups(spark, rows) == brute_groups(rows)


def test_classes_that_the_hub_does_not_reach(spark, monkeypatch):
    """Chains of texts, each like the next only, in one bucket that is dealt out in blocks."""
    monkeypatch.setattr(hyperminhash, "BLOCK", 4)
    rng = random.Random(4)
    text = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((500 - rng.randrange(10) * 40 - i, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(200)] = f"b{rng.random()}"
    found = groups(spark, rows)
    assert found == brute_groups(rows)
    assert len({r[2] for r in found}) < 5


def test_other_settings(spark):
    rows = corpus(3, 25)
    found = groups(spark, rows, percent=60)
    assert found == brute_groups(rows, 60)


def test_nothing(spark):
    assert groups(spark, []) == []
    assert groups(spark, [(1, None)]) == [(1, 0, 1, True)]


def some_sets(similarity, n, rng):
    shared = rng.integers(0, 2**64, int(n * similarity), np.uint64)
    rest = rng.integers(0, 2**64, (2, (n - len(shared)) // 2), np.uint64)
    return [np.unique(np.r_[shared, r]) for r in rest]


def test_registers_are_leading_zeros_and_mantissa():
    top = 2**64 // hyperminhash.REGISTERS
    held = hyperminhash.registers(np.sort(np.array([top // 2, top // 4 + top // 8 + 9, top * 5 // 2 + 9], np.uint64)))
    # Three eighths of the first bucket, not its half; half of the third.
    assert held[0] >> 4 == 1 and held[0] & 15 == 8 and held[2] == 0
    assert (np.delete(held, [0, 2]) == hyperminhash.EMPTY).all()


@pytest.mark.parametrize("n", [60, 500, 20000])
@pytest.mark.parametrize("similarity", [0.0, 0.5, 0.9])
def test_estimates_are_corrected_for_collisions(n, similarity):
    rng = np.random.default_rng(n)
    pairs = [some_sets(similarity, n, rng) for _ in range(60)]
    real = np.mean([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in pairs])
    held = [np.array([hyperminhash.registers(s[i]) for s in pairs]) for i in (0, 1)]
    sizes = [np.array([len(s[i]) for s in pairs]) for i in (0, 1)]
    found = hyperminhash.corrected(*held, *sizes).mean()
    plain = np.mean([(x == y)[(x != 255) | (y != 255)].mean() for x, y in zip(*held)])
    assert abs(found - real) < 0.015
    # Without the correction it is too high, the more so the more buckets are in use.
    assert plain > found and (n < 20000 or similarity > 0.8 or plain - real > 0.008)


def test_bands_miss_no_pair_at_the_threshold():
    rng = np.random.default_rng(7)
    missed = refused = 0
    for n in [7, 20, 60, 200, 1000] * 60:
        a, b = some_sets(0.86, n, rng)
        if not hyperminhash.similar(a, b):
            continue
        held = np.array([hyperminhash.registers(a), hyperminhash.registers(b)])
        one, other = hyperminhash.band_values(held)
        missed += not (one == other).any()
        refused += not hyperminhash.may_link(held[:1], held[1:], np.array([len(a)]), np.array([len(b)]))[0]
    assert (missed, refused) == (0, 0)


def test_unlike_small_sets_share_few_bands():
    rng = np.random.default_rng(8)
    pairs = [some_sets(0.3, 60, rng) for _ in range(100)]
    shared = 0
    for a, b in pairs:
        one, other = hyperminhash.band_values(np.array([hyperminhash.registers(a), hyperminhash.registers(b)]))
        shared += (one == other).any()
    assert shared < 15


def test_key_filter_lets_all_keys_by(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    held = key_filter.key_filter(keys)
    rows = spark.range(100000).selectExpr("id", "xxhash64(id) AS key")
    found = {r.id for r in key_filter.thinned(rows, "key", held).collect()}
    assert found >= set(range(5000)) and len(found) < 5100
    nothing = key_filter.key_filter(keys.limit(0))
    assert key_filter.thinned(rows, "key", nothing).count() == 0


def test_few_texts_of_a_batch_are_held_twice(monkeypatch):
    texts = [f"w{i} a b c d e f g".encode() for i in range(40)]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array([*texts, None, b"x" * 300])], names=["n", "t"])
    found = list(tokens.parts(batch.slice(1), batch.slice(1).column("t")))
    assert [text for _, part in found for text in part] == [*texts[1:], b"", b"x" * 300]
    assert [n for part, _ in found for n in part.column("n").to_pylist()] == list(range(1, 42))
    assert all(len(part) == 1 or sum(map(len, part)) <= 100 for _, part in found)
    assert not list(tokens.parts(batch.slice(0, 0), batch.slice(0, 0).column("t")))
    # Each of these goes through a batch part by part.
    ids = pa.array([1] * 20 + [2] * 20)
    pairs = [ids, pa.array(range(40)), pa.array([texts[0]] * 20 + [texts[39]] * 20), pa.array(texts)]
    pairs = pa.RecordBatch.from_arrays(pairs, names=["u", "v", "text_u", "text_v"])
    found = list(hyperminhash._verify(3, 85)(iter([pairs])))
    assert len(found) > 1
    assert [r for part in found for r in part.column("v").to_pylist()] == [0, 39]
    rows = pa.StructArray.from_arrays([pa.array(range(40)), pa.array(texts).cast(pa.string())], names=["doc_id", "text"])
    rows = pa.RecordBatch.from_arrays([rows, pa.array(range(40))], names=["_row", "_id"])
    found = list(simhash._with_bits(1, 3, 42)(iter([rows])))
    assert len(found) > 1
    bits = [b % (1 << 64) for part in found for b in part.column("_bits").to_pylist()]
    assert bits == [simhash.fingerprint(text) for text in texts]
