"""The overlay and what is built on it, and the ledger of shards, against plain searches and uninterrupted runs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.operators import graph, lipschitz, overlay, paths, tables, validate
from pathloom.streaming.ledger import Ledger, assigned


def grid(width, seed, weights):
    """(arcs, metric, places) of the line graph of a grid with one-way streets and dead ends."""
    rng = np.random.default_rng(seed)
    tail, d = np.repeat(np.arange(width**2), 4), np.tile(np.arange(4), width**2)
    x, y = tail % width + np.array([1, -1, 0, 0])[d], tail // width + np.array([0, 0, 1, -1])[d]
    ok = (x >= 0) & (x < width) & (y >= 0) & (y < width) & (rng.random(len(d)) < 0.65)
    edges = pd.DataFrame({"edge": np.flatnonzero(ok), "tail": tail[ok], "head": (y * width + x)[ok], "w": rng.integers(1, weights, ok.sum())})
    both = edges.merge(edges, left_on="head", right_on="tail", suffixes=("", "_to"))
    arcs = pd.DataFrame({"coord": np.arange(len(both)), "prev": both.edge, "next": both.edge_to, "w": both.w_to})
    return arcs, pd.DataFrame({"node": edges.edge, "x": (edges["tail"] % width).astype(float), "y": (edges["tail"] // width).astype(float)})


@pytest.mark.parametrize(("width", "leaf", "bits", "levels"), [(5, 100, 3, 1), (9, 30, 1, 3)])
def test_overlay_equals_searches(spark, monkeypatch, width, leaf, bits, levels):
    monkeypatch.setattr(tables, "CHUNK", 7)  # tables go to several tasks
    arcs, places = grid(width, width, 4)  # small weights: many ties
    rng = random.Random(1)
    nodes = places.node.tolist()
    asked = [(i, *p) for i, p in enumerate({(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)} | {(nodes[0], nodes[0])})]
    graph, metric = spark.createDataFrame(arcs.drop(columns="w")), spark.createDataFrame(arcs[["coord", "w"]])
    queries = spark.createDataFrame(asked, "qid long, s long, t long").select("qid", F.array("s").alias("sources"), F.array("t").alias("targets"))
    oracle = overlay.OverlayOracle(spark.createDataFrame(places), leaf, bits)
    key = lambda r: (r.qid, r.distance, r.nodes and tuple(r.nodes), tuple(r.coords) if r.coords is not None else None)
    found = sorted(map(key, oracle.shortest_paths(graph, metric, queries).collect()))
    assert oracle._cells[1] == levels
    assert found == sorted(map(key, paths.DijkstraOracle().shortest_paths(graph, metric, queries).collect()))
    assert any(r[1] is None for r in found) and any(r[1] == 0 for r in found)
    net = oracle.customised(graph, spark.createDataFrame(arcs[["coord"]].assign(w=arcs.w * 7)))
    far = {r.qid: r.distance for r in overlay.distances(net, queries.select("qid", F.col("sources")[0].alias("s"), F.col("targets")[0].alias("t"))).collect()}
    assert far == {q: d and 7 * d for q, d, *_ in found}
    own = paths.Graph(*(arcs[c].to_numpy() for c in ("coord", "prev", "next", "w")))
    for s in nodes[:2]:
        reached = overlay.distances_from(net, spark.createDataFrame([(s,)], "s long")).collect()
        assert {(r.node, r.distance) for r in reached} == {(v, 7 * d) for v, d in own.search([s], {-1})[0].items()}


def test_overlay_rejects(spark):
    arcs, places = grid(4, 0, 9)
    graph, metric, own = spark.createDataFrame(arcs.drop(columns="w")), arcs[["coord", "w"]], spark.createDataFrame(places)
    for bad in (metric.iloc[1:], metric.assign(w=[0, *metric.w[1:]]), metric.assign(w=[2**31 - 1, *metric.w[1:]])):
        with pytest.raises(Exception, match="bad weight"):
            overlay.OverlayOracle(own).customised(graph, spark.createDataFrame(bad))
    with pytest.raises(Exception, match="no place"):
        overlay.cells(own.withColumn("x", F.when(F.col("node") > places.node[0], F.col("x"))))
    with pytest.raises(Exception, match="no cell"):
        overlay.OverlayOracle(own.where(f"node <> {arcs.prev[0]}")).customised(graph, spark.createDataFrame(metric))
    oracle = overlay.OverlayOracle(own)
    with pytest.raises(Exception, match="one of sources"):
        oracle.shortest_paths(graph, spark.createDataFrame(metric), spark.createDataFrame([(1, [1, 2], [3])], "qid long, sources array<long>, targets array<long>")).collect()


def test_lipschitz_equals_floyd(spark):
    rng = np.random.default_rng(4)
    n = 40
    places = pd.DataFrame({"node": np.arange(n), "lat": 47 + rng.random(n) / 50, "lon": 8 + rng.random(n) / 50})
    edges = pd.DataFrame({"edge_id": np.arange(120), "tail": rng.integers(0, n - 1, 120), "head": rng.integers(0, n - 1, 120)})  # the last node is unreached
    a, b = np.radians(places[["lat", "lon"]].to_numpy())[edges["tail"]].T, np.radians(places[["lat", "lon"]].to_numpy())[edges["head"]].T
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(np.sin((b[0] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(b[0]) * np.sin((b[1] - a[1]) / 2) ** 2, 1)))
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for u, v, w in zip(edges["tail"], edges["head"], km):
        d[u, v] = min(d[u, v], w)
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    spots, streets = spark.createDataFrame(places), spark.createDataFrame(edges)
    anchors = lipschitz.choose_anchors(spots, 3, 9)
    assert anchors.collect() == lipschitz.choose_anchors(spots.repartition(7), 3, 9).collect()
    found = lipschitz.embed(streets, spots, anchors).toPandas()
    assert len(found) == 3 * n
    for anchor, own in found.groupby("anchor"):
        v = np.where(np.isfinite(d[:, anchor]), 1 / (d[:, anchor] + 1), 0)
        assert np.allclose(own.sort_values("node").value, (v - v.mean()) / v.std(), atol=1e-4)
    with pytest.raises(ValueError, match="41 anchors of 40 nodes"):
        lipschitz.choose_anchors(spots, 41, 9)


def rows(spark, n=95):
    return spark.createDataFrame([(i * 3, f"trip:{i}", [i, i + 1, i + 2]) for i in range(n)], "k long, sample_id string, edges array<long>").repartition(5)


def shorter(df):
    return df.withColumn("edges", F.slice("edges", 1, 2))


def contents(run):
    return {r.shard: r.sha256 for r in run.states().collect()}


def test_assigned(spark):
    found = sorted((r.k, r.shard) for r in assigned(rows(spark), 10, "k").collect())
    assert found == [(i * 3, i // 10) for i in range(95)]
    with pytest.raises(Exception, match="duplicate key"):
        assigned(rows(spark).union(rows(spark)), 10, "k").collect()


def test_ledger_makes_again_what_fails(spark, tmp_path):
    whole = Ledger(spark, f"file://{tmp_path}/whole", {"v": 1})
    plan = whole.plan(rows(spark), 10, "k")
    assert [r.n for r in plan.orderBy("shard").collect()] == [10] * 9 + [5]
    assert {r.state for r in whole.states().collect()} == {"missing"}
    assert whole.run(shorter) == 10 and whole.run(shorter) == 0
    assert [(r.sample_id, r.edges) for r in whole.result().orderBy("shard", "pos").collect()] == [(f"trip:{i}", [i, i + 1]) for i in range(95)]

    run, calls = Ledger(spark, f"file://{tmp_path}/run", {"v": 1}), []
    run.plan(rows(spark).repartition(3), 10, "k")

    def stops(df):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return shorter(df)

    with pytest.raises(KeyboardInterrupt):
        run.run(stops, per_commit=3)
    assert sorted(r.shard for r in run.states().where("state = 'valid'").collect()) == [0, 1, 2, 3, 4, 5]
    (tmp_path / "run" / "parts" / "attempt=9" / "shard=7").mkdir(parents=True)  # parts of a run that was killed before its commit
    (tmp_path / "run" / "parts" / "attempt=9" / "shard=7" / "part-0.txt").write_text("half")
    again = Ledger(spark, f"file://{tmp_path}/run", {"v": 1})
    again.plan(rows(spark), 10, "k")
    assert again.run(shorter) == 4 and contents(again) == contents(whole)

    files = {r.shard: tmp_path / "run" / r.file for r in again.commits().collect()}
    files[2].unlink()
    files[6].write_bytes(files[6].read_bytes().replace(b"trip:60", b"trip:61"))
    files[6].with_name(f".{files[6].name}.crc").unlink()
    assert {r.shard: r.state for r in again.states().where("state <> 'valid'").collect()} == {2: "missing", 6: "damaged"}
    with pytest.raises(Exception, match="shard [26] is"):
        again.result().collect()
    assert again.run(shorter) == 2 and contents(again) == contents(whole)
    assert {r.shard for r in again.commits().where("attempt >= 11").collect()} == {2, 6}
    assert again.result().count() == 95


def test_ledger_rejects(spark, tmp_path):
    run = Ledger(spark, f"file://{tmp_path}/run", {"v": 1})
    run.plan(rows(spark), 10, "k")
    with pytest.raises(ValueError, match="another configuration"):
        Ledger(spark, f"file://{tmp_path}/run", {"v": 2})
    with pytest.raises(ValueError, match="planned for other rows"):
        run.plan(shorter(rows(spark)), 10, "k")
    with pytest.raises(ValueError, match="other ids"):
        run.run(lambda df: shorter(df).where("sample_id <> 'trip:5'"))
    with pytest.raises(ValueError, match="no predictions"):
        run.run(lambda df: df.withColumn("edges", F.slice("edges", 1, 0)))
    with pytest.raises(ValueError, match="no predictions"):
        run.run(lambda df: df.withColumn("edges", F.array(F.lit(2**32))))
    assert run.commits().count() == 0


def test_large_networks_stay_tables(spark, monkeypatch):
    """What a large network's trips and transitions are made by: joins and blocks, with the results of the small one's way."""
    rng = np.random.default_rng(3)
    ends = pd.DataFrame({"edge_id": np.arange(60), "tail": rng.integers(0, 12, 60), "head": rng.integers(0, 12, 60), "baseline": rng.integers(1, 9, 60).astype(float)})
    edges = spark.createDataFrame(ends)
    lists = [None, [], [3], [0, None], [-1, 0], [0, 60]] + [[int(x)] for x in rng.integers(0, 60, 3)]
    for _ in range(400):
        route = [int(rng.integers(0, 60))]
        while rng.random() < 0.7:
            on = np.flatnonzero(ends["tail"] == ends["head"][route[-1]])
            route.append(int(rng.choice(on)) if len(on) and rng.random() < 0.9 else int(rng.integers(0, 60)))
        lists += [route, route]  # equal rows
    own = spark.createDataFrame([(f"t{i % 7}", x) for i, x in enumerate(lists)], "sample_id string, edges array<long>")
    key = lambda df: sorted(map(str, df.collect()))
    for options in ({}, {"cycles": True, "min_edges": 3}, {"split_empty": False, "min_edges": 1}):
        monkeypatch.setattr(validate, "BROADCAST_EDGES", 200_000)
        small = key(validate.classify(own, edges, **options))
        monkeypatch.setattr(validate, "BROADCAST_EDGES", 59)
        monkeypatch.setattr(validate, "edge_ends", None)  # nothing is fetched
        assert key(validate.classify(own, edges, **options)) == small
        monkeypatch.undo()
    monkeypatch.setattr(graph, "BLOCK_BITS", 2)
    found = [tuple(r) for r in graph.transitions(edges).orderBy("coord").select("coord", "prev", "next").collect()]
    both = ends.merge(ends, left_on="head", right_on="tail").sort_values(["edge_id_x", "edge_id_y"])
    assert found == [(i, *p) for i, p in enumerate(zip(both.edge_id_x.tolist(), both.edge_id_y.tolist()))]
