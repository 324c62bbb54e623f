import datetime
import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from areashare.plans.report import DOAC_SHARE
from areashare.sources.partials import FILE, PartialSums, listing


def put(df, path, name):
    """``df`` as one file."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


@pytest.fixture
def facts(rx, tmp_path):
    path = str(tmp_path / "facts")
    for i in range(10):
        put(rx.where(F.expr(f"pmod(xxhash64(bnf_code, items, month), 10) = {i}")), path, f"d{i}")
    return path


def full(spark, path, areas):
    everything = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows(DOAC_SHARE.build(everything, areas))


def test_only_new_files_are_read(spark, rx, areas, facts, tmp_path):
    store = PartialSums(DOAC_SHARE, str(tmp_path / "sums"))
    n = listing(spark, facts).count()
    assert len(store.refresh(spark, facts)) == n
    assert store.refresh(spark, facts) == []
    more = rx.withColumn("items", F.col("items") + 5).limit(6)
    put(more, facts, "d10")
    assert rows(store.build(spark, facts, areas)) == full(spark, facts, areas)
    # The eleventh file alone was read, as the sums of that batch say.
    first, second = store.batches(spark)
    read = spark.read.parquet(f"{store.folder}/{second}/sums").select(FILE).distinct().collect()
    assert [os.path.basename(os.path.dirname(r[0])) for r in read] == ["d10"]
    known = spark.read.parquet(f"{store.folder}/{second}/files").count()
    assert known == 1 and spark.read.parquet(f"{store.folder}/{first}/files").count() == n


def test_removed_and_changed_files(spark, rx, areas, facts, tmp_path):
    store = PartialSums(DOAC_SHARE, str(tmp_path / "sums"))
    extra = rx.withColumn("items", F.lit(1000).cast("bigint"))
    put(extra, facts, "gone")
    before = rows(store.build(spark, facts, areas))
    assert before == full(spark, facts, areas)
    put(extra.limit(0), facts, "gone")  # the file there now holds no rows
    after = rows(store.build(spark, facts, areas))
    assert after == full(spark, facts, areas) != before
    put(extra.withColumn("items", F.lit(7).cast("bigint")), facts, "gone")
    assert rows(store.build(spark, facts, areas)) == full(spark, facts, areas)


def test_an_unfinished_batch_does_not_count(spark, areas, facts, tmp_path):
    store = PartialSums(DOAC_SHARE, str(tmp_path / "sums"))
    expected = rows(store.build(spark, facts, areas))
    (batch,) = store.batches(spark)
    # As if a refresh had died before its manifest, and another had read all files a second time.
    spark.read.parquet(f"{store.folder}/{batch}/sums").write.parquet(f"{store.folder}/zzz/sums")
    spark.read.parquet(f"{store.folder}/{batch}/files").write.parquet(f"{store.folder}/zzz/files")
    assert rows(store.build(spark, facts, areas)) == expected
    files = listing(spark, facts)
    store._add(spark, files, lambda: spark.read.parquet(f"{store.folder}/{batch}/sums").drop("batch"))
    assert len(store.batches(spark)) == 2
    assert rows(store.build(spark, facts, areas)) == expected


def test_compacted(spark, rx, areas, facts, tmp_path):
    store = PartialSums(DOAC_SHARE, str(tmp_path / "sums"))
    store.refresh(spark, facts)
    put(rx, facts, "more")
    expected = rows(store.build(spark, facts, areas))
    store.compact(spark, facts)
    assert store.refresh(spark, facts) == []
    found = store._counted(spark, listing(spark, facts))
    assert found.select("batch").distinct().count() == 1
    assert rows(store.build(spark, facts, areas)) == expected == full(spark, facts, areas)


def test_another_measure_has_sums_of_its_own(spark, areas, facts, tmp_path):
    import dataclasses

    store = PartialSums(DOAC_SHARE, str(tmp_path / "sums"))
    later = dataclasses.replace(store, share=dataclasses.replace(DOAC_SHARE, since=datetime.date(2012, 2, 1)))
    store.refresh(spark, facts)
    assert later.batches(spark) == [] and later.refresh(spark, facts)


def test_no_files(spark, areas, tmp_path):
    (tmp_path / "facts").mkdir()
    store = PartialSums(DOAC_SHARE, str(tmp_path / "sums"))
    assert store.build(spark, str(tmp_path / "facts"), areas).isEmpty()
