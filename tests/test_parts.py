import os

from helpers import plan, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areashare.operators import read_panels, replace_panels, write_panels
from areashare.sources import read_text_parts, read_text_table

SCHEMA = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("items", T.LongType()), T.StructField("day", T.DateType())]
)


def test_every_line_is_accepted_or_rejected(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text('code,items,day\n0E1,5,2012-01-01\n,7,\n"x,y",3,2012-02-01\n012,many,2012-01-01\n')
    (path / "b.csv").write_text("code,items,day\nA,1.5,soon\nB,1\nC,1,2012-01-01,more\nD,,2012-01-01\n")
    accepted, rejected = read_text_parts(spark, str(path), SCHEMA)
    assert [(r.code, r["items"], str(r.day)) for r in accepted.orderBy("items", "code").collect()] == [
        ("D", None, "2012-01-01"), ("x,y", 3, "2012-02-01"), ("0E1", 5, "2012-01-01"), (None, 7, "None"),
    ]
    found = {(os.path.basename(r.file), r.row, r.reason) for r in rejected.collect()}
    assert found == {
        ("a.csv", "012,many,2012-01-01", "items is no bigint: many"),
        ("b.csv", "A,1.5,soon", "items is no bigint: 1.5; day is no date: soon"),
        ("b.csv", "B,1", "another number of fields"),
        ("b.csv", "C,1,2012-01-01,more", "another number of fields"),
    }
    clean = tmp_path / "clean"
    clean.mkdir()
    (clean / "c.csv").write_text('code,items,day\n0E1,5,2012-01-01\n,7,\n"x,y",3,2012-02-01\nD,,2012-01-01\n')
    assert rows(accepted) == rows(read_text_table(spark, str(clean), SCHEMA))
    assert accepted.count() + rejected.count() == 8


def files(path, panel):
    return sorted(os.listdir(f"{path}/panel={panel}"))


def test_a_panel_is_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "panels")
    layer = spark.createDataFrame(
        [("A", 1.0, "london"), ("B", 2.0, "rest"), ("C", None, "rest")], "code string, shade double, panel string"
    )
    write_panels(layer, path)
    before = files(path, "rest"), files(path, "london")
    replace_panels(layer.where("panel = 'london'").withColumn("shade", F.lit(9.0)), path)
    assert files(path, "rest") == before[0] and files(path, "london") != before[1]
    assert rows(read_panels(spark, path)) == [("A", 9.0, "london"), ("B", 2.0, "rest"), ("C", None, "rest")]
    london = read_panels(spark, path, "london")
    assert rows(london) == [("A", 9.0, "london")]
    assert len({r[0] for r in london.select(F.input_file_name()).collect()}) == 1
    assert "PartitionFilters" in plan(london)
