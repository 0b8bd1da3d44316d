"""Array files: rows by ranges, ragged round trips, and jobs that fail."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.sources.arrays import ArrayFiles


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(ArrayFiles)


def read(spark, path, **options):
    return spark.read.format("array_files").options(**options).load(str(path))


@pytest.mark.parametrize("array", [np.arange(1000), np.arange(12, dtype=np.float32).reshape(4, 3), np.zeros((0, 2)), np.arange(7, dtype=np.uint8), np.zeros(0, np.int32)])
def test_files_by_ranges(spark, tmp_path, array):
    np.save(tmp_path / "a.npy", array)
    df = read(spark, tmp_path / "a.npy", rows=3)
    assert df.rdd.getNumPartitions() == max(1, -(-len(array) // 3))
    found = sorted(map(tuple, df.collect()))
    assert found == [(i, v.tolist()) for i, v in enumerate(array)]


@pytest.mark.parametrize("array", [np.array(["a"]), np.zeros((2, 2, 2)), np.asfortranarray(np.ones((2, 3))), np.array(3)])
def test_other_arrays_are_errors(spark, tmp_path, array):
    np.save(tmp_path / "a.npy", array)
    with pytest.raises(Exception, match="no table of numbers"):
        read(spark, tmp_path / "a.npy")


def test_a_cut_file_is_an_error(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(100))
    os.truncate(tmp_path / "a.npy", 500)
    with pytest.raises(Exception, match="372 bytes"):
        read(spark, tmp_path / "a.npy")


@pytest.mark.parametrize("kind", ["long", "double"])
def test_ragged_round_trip(spark, tmp_path, kind):
    rows = [(i, [x * 3 for x in range(i % 5)]) for i in range(50)]
    df = spark.createDataFrame(rows, "row long, values array<long>").select("row", F.col("values").cast(f"array<{kind}>")).repartition(3)
    df.write.format("array_files").option("rows", 4).mode("append").save(f"file://{tmp_path}/t")
    back = read(spark, f"file://{tmp_path}/t")
    assert back.schema["values"].dataType.elementType.simpleString() == {"long": "bigint"}.get(kind, kind)
    assert sorted((r["row"], r["values"]) for r in back.collect()) == rows
    assert all(p["rows"] <= 4 for p in json.loads((tmp_path / "t" / "_index.json").read_text())["parts"])
    with pytest.raises(Exception, match="committed already"):
        df.write.format("array_files").mode("append").save(f"file://{tmp_path}/t")


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 100, 1, 1).select(F.col("id").alias("row"), F.when(F.col("id") == 77, F.raise_error(F.lit("stop")).cast("array<long>")).otherwise(F.array("id")).alias("values"))
    with pytest.raises(Exception, match="stop"):
        rows.write.format("array_files").option("rows", 5).mode("append").save(str(tmp_path / "t"))
    assert [p for p in (tmp_path / "t").glob("*")] == []
    with pytest.raises(Exception, match="never committed"):
        read(spark, tmp_path / "t")
    null = spark.createDataFrame([(1, [None])], "row long, values array<long>")
    with pytest.raises(Exception, match="no nulls"):
        null.write.format("array_files").mode("append").save(str(tmp_path / "t"))
    with pytest.raises(Exception, match="array files hold"):
        spark.range(3).write.format("array_files").mode("append").save(str(tmp_path / "u"))
