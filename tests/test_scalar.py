import math

from pyspark.sql import functions as F

from pathloom.functions import scalar as s


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*x):
    return F.array(*[F.lit(v).cast("long") for v in x]) if x else F.array().cast("array<long>")


def test_arrays(spark):
    assert one(spark, s.interior(arr(1, 2, 3)), s.interior(arr(1, 2)), s.joined(arr(1, 2), arr(2, 3)), s.padded(arr(5), 3)) == ([2], [], [1, 2, 3], [5, -1, -1])
    assert one(spark, s.place(arr(7, 8), F.lit(8)), s.place(arr(7), F.lit(9)), s.is_simple(arr(1, 1)), F.size(s.replicated(F.lit(0.5)))) == (1, None, False, 48)


def test_texts(spark):
    assert one(spark, s.is_sha256(F.lit("a" * 64)), s.is_sha256(F.lit("g" * 64)), s.is_blank(F.lit(" ")), s.checkpoint_number(F.lit("checkpoint-12.json")), s.checkpoint_number(F.lit("x"))) == (True, False, True, 12, None)
    assert one(spark, s.at_key(F.lit('{"a":{"b":3}}'), "a.b"), s.duration_text(F.lit(3723.4)), s.percent(F.lit(0.1234)), s.percent(F.lit(None).cast("double")), s.interval_text(F.lit(0.1), F.lit(0.2)), s.mebibytes(F.lit(2048))) == ("3", "1h 02m 03s", "12.34%", "—", "[10.00, 20.00]", "2.0 MiB")


def test_groups(spark):
    rows = spark.createDataFrame([(1, 0.0, True), (1, 0.0, True), (1, 9.0, False)], "g long, x double, ok boolean")
    found = [r[0] for r in rows.select(s.log_loss("x", ["g"], "ok").alias("l")).where("l is not null").collect()]
    assert all(math.isclose(x, math.log(2)) for x in found) and len(found) == 2
    z = spark.createDataFrame([(1, 1.0), (1, 3.0)], "g long, x double").select(s.standardised("x", ["g"])).collect()
    assert sorted(r[0] for r in z) == [-1, 1]
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"a": 3},)], "m map<string,long>")
    assert {r["key"]: r["n"] for r in s.summed_counters(maps, "m").collect()} == {"a": 4, "b": 2}
    summary = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 1.5), (1, None)], "sample_count long, f double")
    assert s.range_faults(summary, ["f"]).count() == 3
    left, right = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string"), spark.createDataFrame([("a", "1"), ("c", "2")], "name string, sha256 string")
    assert sorted(r[0] for r in s.changed_files(left, right).collect()) == ["b", "c"]
