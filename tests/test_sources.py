import pytest
from pyspark.sql import functions as F

from conftest import rows
from creel.sources import tables as IO


def test_delimited(spark, tmp_path):
    (tmp_path / "t.txt").write_text("TA_CODE;ope_pop_id;R\nANG;7;0.5\nTRF;;1.25\n")
    got = IO.read_delimited(spark, str(tmp_path / "t.txt"), "TA_CODE string, ope_pop_id int, R double", ";", {"TA_CODE": "code_espece", "ope_pop_id": "pop_id"})
    assert rows(got, "code_espece") == [("ANG", 7, 0.5), ("TRF", None, 1.25)]


def test_snapshots(spark, tmp_path):
    for name, v in (("tables_2021", 1), ("tables_2022", 2), ("other_2023", 3)):
        spark.range(v).write.parquet(str(tmp_path / name))
    assert IO.read_latest(spark, str(tmp_path), "^tables").count() == 2
    assert IO.read_latest(spark, f"file:{tmp_path}/", "_20").count() == 2  # last by name
    assert IO.latest_snapshot(spark, str(tmp_path), "_20", by="modified").endswith("other_2023")
    with pytest.raises(FileNotFoundError):
        IO.read_latest(spark, str(tmp_path), "^nothing")


def test_write_and_read_tables(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("annee"))
    paths = IO.write_tables({"captures": df, "small": df.limit(1)}, str(tmp_path), {"captures": ["annee"]})
    assert (tmp_path / "captures.parquet" / "annee=1").exists()
    back = IO.read_tables(spark, str(tmp_path), ["captures", "small"])
    assert back["captures"].count() == 100 and back["small"].count() == 1 and set(paths) == {"captures", "small"}


def test_layers_and_materialise(spark, tmp_path):
    df = spark.createDataFrame([("e1", 1.0, 2.0, "x")], "IDD string, x double, y double, nom string")
    df.write.parquet(str(tmp_path / "pts"))
    assert rows(IO.read_points(spark, str(tmp_path / "pts"), {"code_exutoire": "IDD"}, "x", "y")) == [("e1", 1.0, 2.0)]
    again = IO.materialise(df)
    assert rows(again) == rows(df) and again.schema.names == df.schema.names
    assert IO.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
