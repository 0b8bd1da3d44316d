"""Reports, artifact checks and real-cost paths by hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from pathloom.functions import scalar
from pathloom.operators import paths, reports, validate
from pathloom.sources import records

ATTEMPT = "task string, attempt long, wall double, user double, system double, peak_kib long, exit int, lost boolean"


def test_attempt_timing(spark):
    rows = [("a", 1, 5.0, 1.0, 0.5, 70, 1, None), ("a", 2, 7.0, 2.0, 0.5, 90, 0, False), ("b", 1, None, None, None, None, None, True), ("b", 2, 3.0, 1.0, 0.25, 10, 0, False), ("c", 1, None, None, None, None, None, True)]
    found = {r["task"]: r.asDict() for r in reports.attempt_timing(spark.createDataFrame(rows, ATTEMPT)).collect()}
    assert found["a"] == {"task": "a", "attempts": 2, "lost_attempts": 0, "timing_complete": True, "wall": 12.0, "known_wall": 12.0, "final_wall": 7.0, "wasted": 5.0, "user": 3.0, "system": 1.0, "peak_kib": 90, "exit": 0}
    assert (found["b"]["wall"], found["b"]["known_wall"], found["b"]["wasted"], found["b"]["timing_complete"]) == (None, 3.0, 0.0, False)
    assert (found["c"]["known_wall"], found["c"]["final_wall"], found["c"]["peak_kib"]) == (0.0, None, None)
    assert reports.attempt_timing(spark.createDataFrame([], ATTEMPT)).count() == 0


def test_throughput_progress_and_samples(spark):
    t = reports.throughput(spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "seconds double, search double"), ["search"]).first()
    assert tuple(t) == (2, 2.0, 0.5, 2.0, 4.0)
    assert tuple(reports.throughput(spark.createDataFrame([], "seconds double"), []).first()) == (0, None, None)
    shards = spark.createDataFrame([(1, 0, 10, 5.0), (1, 1, 30, 15.0), (2, 0, 0, 0.0)], "run int, shard int, n long, seconds double")
    found = {(r["run"], r["shard"]): tuple(r)[2:] for r in reports.progress(shards).collect()}
    assert found == {(1, 0): (10, 40, 0.25, 15.0), (1, 1): (40, 40, 1.0, 0.0), (2, 0): (0, 0, None, None)}
    ids = spark.createDataFrame([("c",), ("a",), ("b",)], "sample_id string")
    assert [r[0] for r in reports.latency_sample(ids, 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        reports.latency_sample(ids, 0)
    p = reports.percentiles(spark.createDataFrame([(1,), (2,), (4,), (None,)], "x int"), "x", {"p50": 0.5, "p75": 0.75}).first()
    assert tuple(p) == (3, 2.0, 3.0)
    rows = spark.createDataFrame([(1, 0.5, 0.3), (2, 0.7, 0.4), (3, 0.7, 0.2), (4, 0.7, 0.2)], "epoch int, accuracy double, loss double")
    assert reports.chosen_checkpoint(rows).first()["epoch"] == 3


def test_methods():
    assert reports.method_faults(["a", "b"], ["a", "b"]) == []
    assert reports.method_faults(["a", "b"], ["b", "a"]) == ["another order"]
    assert reports.method_faults(["a", "b"], ["a", "c", "c"]) == ["missing b", "extra c", "extra c", "repeated c"]


def test_endpoint_and_artifact_faults(spark):
    end = "array<struct<node:long,offset:long>>"
    rows = [(1, [(0, 0)], [(4, 0)]), (2, [], [(1, 0)]), (3, [(5, 0)], [(1, 0)]), (4, [(0, 1)], [(1, 0)]), (5, None, [(1, 0)]), (6, [(0, 0)], [(-1, 0)])]
    found = validate.endpoint_faults(spark.createDataFrame(rows, f"qid long, sources {end}, targets {end}"), 5).collect()
    assert {r["qid"]: r["fault"] for r in found} == {2: "empty", 3: "out_of_range", 4: "nonzero_offset", 5: "empty", 6: "out_of_range"}
    arcs = spark.createDataFrame([(0, 0, 1, 2.0), (1, 0, 2, 3.0), (2, 1, 2, 4.0), (3, 2, 0, 1.0)], "coord long, prev long, next long, w0 double")
    art = spark.createDataFrame([(0, 0, 1, 2.0), (1, 0, 2, 3.5), (2, 2, 1, 4.0), (9, 0, 0, 1.0)], "coord long, prev long, next long, initial double")
    assert {r["coord"]: r["fault"] for r in validate.artifact_faults(arcs, art).collect()} == {1: "baseline", 2: "transition", 3: "missing", 9: "unknown"}


def test_real_cost_paths(spark):
    arcs = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 1, 3), (3, 2, 3)], "coord long, prev long, next long")
    one = {0: 0.5, 1: 0.25, 2: 0.5, 3: 0.5}
    rows = [(3, c, w) for c, w in one.items()] + [(2, c, 9.0 if c == 1 else 0.0) for c in one]
    costs = spark.createDataFrame(rows, "dst long, coord long, w double")
    pairs = spark.createDataFrame([(0, 3), (0, 3), (0, 2), (3, 3), (1, 2)], "src long, dst long")
    found = {(r["src"], r["dst"]): (r["distance"], r["nodes"]) for r in paths.real_cost_paths(arcs, costs, pairs).collect()}
    assert found == {(0, 3): (0.75, [0, 2, 3]), (0, 2): (9.0, [0, 2]), (3, 3): (0.0, [3]), (1, 2): (None, None)}
    tie = spark.createDataFrame([(3, c, 0.5) for c in one], "dst long, coord long, w double")
    assert paths.real_cost_paths(arcs, tie, pairs.where("src = 0 and dst = 3")).first()["nodes"] == [0, 1, 3]
    for bad in (None, -1.0, float("nan")):
        broken = spark.createDataFrame([(3, c, bad if c == 2 else 1.0) for c in one], "dst long, coord long, w double")
        with pytest.raises(Exception, match="bad cost of coordinate 2"):
            paths.real_cost_paths(arcs, broken, pairs.where("dst = 3")).collect()


def test_times_and_loss(spark):
    texts = ["2026-01-02T03:04:05Z", "2026-01-02T05:04:05+02:00", "2026-01-02 03:04:05", "yesterday", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.iso_time(F.col("t")).cast("long").alias("s"), scalar.age_seconds(F.col("t"), F.timestamp_seconds(F.lit(1767323046))).alias("age")).collect()
    assert [r["s"] for r in rows] == [1767323045] * 3 + [None, None] and [r["age"] for r in rows] == [1.0] * 3 + [None, None]
    d = spark.range(1).select(*(scalar.duration_text(F.lit(x)) for x in (3723.4, 185.0, 4.6, -3.0)), scalar.duration_text(F.lit(None).cast("double"))).first()
    assert tuple(d) == ("1h 02m 03s", "3m 05s", "5s", "0s", None)
    x = spark.range(1).select(*(scalar.weighted_bce(F.lit(a), F.lit(b), F.lit(w)) for a, b, w in ((0.0, 1, 2.0), (800.0, 0, 1.0), (-800.0, 0, 1.0)))).first()
    assert math.isclose(x[0], 2 * math.log(2)) and tuple(x)[1:] == (800.0, 0.0)


def test_documents(spark, tmp_path):
    text = records.receipt_text("m", "1", "d", "a" * 64, {"k": 1}, "r", {"python": "3"})
    assert records.receipt(text)["method"] == {"name": "m", "version": "1"}
    with pytest.raises(ValueError):
        records.receipt_text("m", "1", "d", "short", {}, "r", {"python": "3"})
    (tmp_path / "a").write_bytes(b"x")
    row = records.artifact_files(spark, {"weights": str(tmp_path / "a")}).first()
    assert (row["role"], row["bytes"], row["sha256"][:8]) == ("weights", 1, "2d711642")
    assert records.expanded("${A}/x", {"A": "${B}", "B": "b"}) == "b/x"
    with pytest.raises(KeyError):
        records.expanded("${C}", {})
    with pytest.raises(ValueError):
        records.expanded("${A}", {"A": "${A}."})
    assert records.lacking_fields({"a": {"b": 1}}, {"a.b": 1, "a.c": 1, "a": 2}) == ["a.c", "a"]
