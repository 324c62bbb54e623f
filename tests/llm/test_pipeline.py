"""The pipeline's stages, and its rows against the stages' brute-force versions."""

import collections
import random
import zlib

import corpus_pipeline
from test_free import brute_components, brute_fingerprint, ids_of

from areashare.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [a + b for a in "ka lo mi ne ru sa to vi".split() for b in "bam del fis gor hun jat".split()]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = words(70)
    texts = [words(rng.randint(80, 300)) for _ in range(60)]
    texts += [f"{words(90)}\n{shared}\n{words(60)}" for _ in range(5)]  # a passage that repeats
    texts += [texts[3] + " end", texts[4]]  # a near and an exact copy
    texts += ["%%% &&& " * 60 for _ in range(6)] + ["too short", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    return str(tmp_path), rows, shared


def test_pipeline(spark, tmp_path):
    sf_dir, rows, shared = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in after["quality_rules"]} == set(range(67))
    # The passage stays in its first document alone, the exact copy loses its only line.
    cut = {r.doc_id: r.text for r in after["line_dedup"]}
    assert [i for i, text in cut.items() if shared in text] == [60] and cut[66] == "" and len(cut) == 67
    prints = {i: brute_fingerprint(text) for i, text in cut.items()}
    assert {r.doc_id for r in after["simhash_near_dedup"]} == set(brute_components(prints).values())
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "simhash_near_dedup")), short=mixing.SHORT).collect()
    assert {r.doc_id for r in after["mixing"]} == {r.doc_id for r in mixed if r.sampled}
    expected = collections.Counter()
    for r in after["mixing"]:
        ids = ids_of(r.text)
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected[(r.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in after["best_fit_packing"]) == expected

    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(tuple(r)[:5] for r in run) == expected
