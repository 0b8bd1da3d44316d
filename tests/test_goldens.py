"""Operators against hand-made networks with known results."""

import json
import math
import pickle
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.functions import archive
from pathloom.operators import evaluate, fit, graph, paths, predict, shortcuts, stats, validate
from pathloom.schema import FitOptions
from pathloom.sources import records, shapes, sinks


def net(spark, tail, head, weight, x=None, y=None):
    edges = spark.createDataFrame([(i, t, h, float(w)) for i, (t, h, w) in enumerate(zip(tail, head, weight))], "edge_id long, tail long, head long, baseline double")
    n = max(tail + head) + 1
    nodes = spark.createDataFrame([(i, float((x or range(n))[i]), float((y or [0] * n)[i])) for i in range(n)], "node_id long, x float, y float")
    return nodes, edges


@pytest.fixture(scope="module")
def n1(spark):
    return net(spark, [0, 1, 2, 1, 4], [1, 2, 3, 4, 3], [2, 3, 5, 1, 1], [0, 1, 2, 3, 2], [0, 0, 0, 0, 1])


@pytest.fixture(scope="module")
def n2(spark):
    return net(spark, [0, 1, 0, 2], [1, 3, 2, 3], [5, 5, 2, 2], [0, 1, 1, 2], [0, 0, 1, 0])


def trips(spark, *routes):
    return spark.createDataFrame([(f"t{i}", list(r)) for i, r in enumerate(routes)], "sample_id string, edges array<long>")


def test_line_graph(n1):
    rows = graph.transitions(n1[1], 0.5, 2.0).orderBy("coord").collect()
    assert [(r["prev"], r["next"]) for r in rows] == [(0, 1), (0, 3), (1, 2), (3, 4)]
    assert [r["w0"] for r in rows] == [3, 1, 5, 1] and [r["lo"] for r in rows] == [1.5, 0.5, 2.5, 0.5] and [r["hi"] for r in rows] == [6, 2, 10, 2]


def test_coordinates_counts_groups(spark, n1):
    own, arcs = validate.accepted(trips(spark, [0, 1, 2], [0, 1, 2], [0, 3, 4]), n1[1]), graph.transitions(n1[1])
    assert {r["sample_id"]: r["coords"] for r in graph.coordinates(own, arcs, 4).collect()}["t0"] == [0, 2]
    assert [r["n"] for r in stats.observed_counts(own, arcs, 4).orderBy("coord").collect()] == [2, 1, 2, 1]
    groups = stats.od_groups(own)
    assert [tuple(r) for r in groups.collect()] == [(0, 3, 3)]
    r = graph.endpoints(groups, n1[1]).first()
    assert r["sources"] == [0] and r["targets"] == [2, 4]
    back = graph.decode(graph.coordinates(own, arcs, 4), arcs, 4).collect()
    assert {r["sample_id"]: r["edges"] for r in back} == {"t0": [0, 1, 2], "t1": [0, 1, 2], "t2": [0, 3, 4]} and all(r["connected"] for r in back)


def test_bound_limit(spark):
    _, edges = net(spark, [0, 1], [1, 0], [1, 2147483647])
    with pytest.raises(Exception, match="limit"):
        graph.transitions(edges, 1.0, 1.0).collect()


def test_reject_reasons(spark):
    _, edges = net(spark, [0, 1, 0, 2, 1], [1, 3, 2, 3, 0], [5, 5, 2, 2, 1])
    found = validate.classify(trips(spark, [0, 1], [], [0], [0, 99], [0, 3], [0, 4]), edges).orderBy("sample_id").collect()
    assert [r["reason"] for r in found] == ["accepted", "empty", "too_short", "out_of_bounds", "discontinuous", "cyclic"]
    assert (found[0]["src"], found[0]["dst"]) == (0, 3) and found[1]["src"] is None


def test_classify_odd_lists(spark, n1):
    rows = [("a", None, 7), ("b", [0, None], 8), ("c", [-1, 0], 9), ("d", [0, 1], None), ("d", [0, 1], 1)]
    found = validate.classify(spark.createDataFrame(rows, "sample_id string, edges array<long>, n long"), n1[1])
    assert found.columns == ["sample_id", "edges", "n", "reason", "src", "dst"]
    got = [(r["sample_id"], r["n"], r["reason"], r["src"], r["dst"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted([("a", 7, "empty", None, None), ("b", 8, "out_of_bounds", None, None), ("c", 9, "out_of_bounds", None, None), ("d", None, "accepted", 0, 2), ("d", 1, "accepted", 0, 2)], key=str)
    assert validate.classify(trips(spark), n1[1]).count() == 0
    assert [r["reason"] for r in validate.classify(trips(spark, [0, 1]), n1[1].where("edge_id < 0")).collect()] == ["out_of_bounds"]
    assert [r["reason"] for r in validate.classify(trips(spark, []), n1[1], split_empty=False).collect()] == ["too_short"]


@pytest.mark.parametrize("cycles", [False, True])
def test_classify_equals_a_loop(cycles):
    rng = np.random.default_rng(5)
    tails, heads = rng.integers(0, 6, 24), rng.integers(0, 6, 24)
    lists = []
    for _ in range(3000):
        route = [int(rng.integers(0, 24))] if rng.random() < 0.97 else []
        while route and rng.random() < 0.7:
            on = np.flatnonzero(tails == heads[route[-1]])
            route.append(int(rng.choice(on)) if len(on) and rng.random() < 0.9 else int(rng.integers(0, 24)))
        if route and rng.random() < 0.1:
            route[int(rng.integers(0, len(route)))] = 24
        lists.append(route)

    def one(route):
        if not route:
            return "empty"
        if len(route) < 2:
            return "too_short"
        if max(route) >= 24:
            return "out_of_bounds"
        if any(heads[a] != tails[b] for a, b in zip(route, route[1:])):
            return "discontinuous"
        seen = [tails[route[0]], *heads[route]]
        return "cyclic" if not cycles and len(set(seen)) < len(seen) else "accepted"

    found = validate.first_fault(pa.array(lists, pa.list_(pa.int64())).slice(500), tails, heads, 2, cycles, True).to_pylist()
    assert [r["reason"] for r in found] == [one(x) for x in lists[500:]]
    assert {r["reason"] for r in found} >= {"accepted", "empty", "too_short", "out_of_bounds", "discontinuous"}
    assert all((r["src"], r["dst"]) == ((tails[x[0]], heads[x[-1]]) if r["reason"] == "accepted" else (None, None)) for r, x in zip(found, lists[500:]))


def test_pair_keys(spark):
    ids = [0, 1, 2**31 - 1, 2**31, 2**32 - 1]
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids], "a long, b long")
    assert pairs.select(paths.pair_key("a", "b")).distinct().count() == len(ids) ** 2


def test_five_edge_filter(spark):
    _, edges = net(spark, [0, 1, 2, 3, 4, 0, 3], [1, 2, 3, 4, 5, 1, 0], [1] * 7)
    found = validate.classify(trips(spark, [], [1, 99], [0, 1, 2, 3, 99], [0, 2, 3, 4, 4], [0, 1, 2, 6, 0], [0, 1, 2, 3, 4]), edges, min_edges=5).orderBy("sample_id").collect()
    assert [r["reason"] for r in found] == ["empty", "too_short", "out_of_bounds", "discontinuous", "cyclic", "accepted"]


def test_baseline(spark):
    own = spark.createDataFrame([(0.0001,), (0.0015,), (1.2344,)], "x double").select(validate.scaled_baseline(F.col("x")).alias("b"))
    assert [r["b"] for r in own.collect()] == [1, 2, 1234]
    for bad in (0.0, float("nan"), None):
        with pytest.raises(Exception, match="bad length"):
            spark.createDataFrame([(bad,)], "x double").select(validate.scaled_baseline(F.col("x"))).collect()


def test_network_checks(spark, n1):
    validate.check_network(*n1)
    with pytest.raises(ValueError, match="edge 0: bad head"):
        validate.check_network(n1[0], spark.createDataFrame([(0, 0, 999, 1.0)], n1[1].schema))
    with pytest.raises(ValueError, match="no edges"):
        validate.check_network(n1[0], n1[1].where("false"))
    rows = spark.createDataFrame([(0, 0), (0, 1)], "fid long, ord long")
    with pytest.raises(ValueError, match="duplicate fid 0 at 0 and 1"):
        validate.check_ids(rows)
    with pytest.raises(ValueError, match="fid 7 at record 0"):
        validate.check_ids(spark.createDataFrame([(7, 0)], "fid long, ord long"))
    nodes = spark.createDataFrame([(0, 40), (1, 20), (2, 80)], "node_id long, osmid long")
    own = graph.resolve(spark.createDataFrame([(0, 40, 20, 1.25), (1, 20, 80, 2.25)], "fid long, u long, v long, length double"), nodes).orderBy("edge_id").collect()
    assert [(r["tail"], r["head"]) for r in own] == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="no head node 999"):
        graph.resolve(spark.createDataFrame([(0, 40, 999, 1.0)], "fid long, u long, v long, length double"), nodes).collect()


def search(spark, edges, metric, source, target):
    arcs = graph.transitions(edges)
    own = spark.createDataFrame([(i, w) for i, w in enumerate(metric)], "coord long, w long")
    asked = graph.endpoints(spark.createDataFrame([(source, target, 1)], "src long, dst long, n long"), edges).select(F.lit(0).cast("long").alias("qid"), "sources", "targets")
    found = paths.DijkstraOracle().shortest_paths(arcs, own, asked)
    assert paths.validate_paths(found, asked, arcs, own).first()["valid"]
    r = found.first()
    return r["distance"], r["nodes"], r["coords"]


def test_paths(spark, n1):
    assert search(spark, n1[1], [3, 1, 5, 1], 0, 3) == (2, [0, 3, 4], [1, 3])
    assert search(spark, n1[1], [2, 1, 2, 2], 0, 3) == (3, [0, 3, 4], [1, 3])
    _, n4 = net(spark, [0, 1, 0, 2], [1, 3, 2, 3], [1, 5, 1, 2])
    assert search(spark, n4, [5, 2], 0, 3) == (2, [2, 3], [1])
    assert search(spark, n4, [3, 3], 0, 3) == (3, [0, 1], [0])
    _, n5 = net(spark, [0, 1], [1, 2], [7, 11])
    assert search(spark, n5, [11], 0, 1) == (0, [0], [])
    with pytest.raises(ValueError, match="coordinate 1: bad weight 0"):
        search(spark, n4, [5, 0], 0, 3)


def test_relational_distances(spark, n1):
    arcs = graph.transitions(n1[1])
    metric = predict.length_metric(arcs)
    found = paths.relational_distances(arcs, metric, spark.createDataFrame([(0,)], "source long"))
    assert {r["node"]: r["distance"] for r in found.collect()} == {0: 0, 1: 3, 3: 1, 2: 8, 4: 2}


def test_regret_and_regularizer():
    assert fit.regret(np.array([5.0, 5, 2, 2]), np.array([2, 2, 0, 0]), 8.0, 2) == (20, 12, 6, 0.6)
    assert math.isclose(fit.regularizer(np.array([2.0, 5]), np.array([1.0, 3]), 4.0), 13 / 9)
    assert fit.regret(np.array([]), np.array([]), 0.0, 0) == (0, 0, 0, 0) and fit.regularizer(np.array([]), np.array([]), 1.0) == 0


def test_step():
    w = np.array([5.0, 2.0])
    new, info = fit.step(w, w, np.array([0.5, 0.2]), np.array([50.0, 20.0]), np.array([2, 0]), np.array([0, 2]), 2, FitOptions(0.5, 0.1), 0)
    assert new.tolist() == [0.5, 4.0] and info == {"eta": 0.5, "max_abs_delta": 4.5, "max_abs_parameter_delta": 1.0, "projected": 1}


def test_quantize():
    assert fit.quantize(np.array([0.2, 2.5, 0.49999999999999994])).tolist() == [1, 3, 1]
    with pytest.raises(ValueError):
        fit.quantize(np.array([0.0]))


def test_fit_snapshots_resume(spark, n2, tmp_path):
    own = validate.accepted(trips(spark, [0, 1], [0, 1]), n2[1])
    model, _ = fit.fit(n2[1], own, FitOptions(0.5, 0.1, 0.1, 10.0, 1))
    assert [r["weight"] for r in model.orderBy("coord").collect()] == [0.5, 4.0]
    fitter, clocks = fit.Fitter(n2[1], own, FitOptions(0.5, 0.1, 0.1, 10.0, 5)), []

    def keep(state, found):
        clocks.append(state.completed)
        if state.completed == 2:
            sinks.save_state(spark, str(tmp_path / "a"), state, found.objective)

    whole, _ = fitter.fit(2, keep)
    assert clocks == [0, 2, 4, 5]
    state, _ = sinks.load_state(spark, str(tmp_path / "a"))
    assert np.array_equal(fitter.resume(state)[0].weights, whole.weights)
    state.topology = "other"
    with pytest.raises(ValueError, match="topology"):
        fitter.resume(state)


def rows(spark, routes):
    return spark.createDataFrame(list(routes.items()), "sample_id string, edges array<long>")


def test_evaluation(spark):
    truth, guess = rows(spark, {"a": [1, 2, 3], "b": [7, 8]}), rows(spark, {"a": [1, 2, 4, 5], "b": [7, 8]})
    r = evaluate.macro(evaluate.route_metrics(evaluate.align(truth, guess))).first()
    assert r["sample_count"] == 2 and r["exact_match"] == 0.5 and r["edge_precision"] == 0.75
    assert math.isclose(r["edge_recall"], 5 / 6) and math.isclose(r["edge_f1"], 11 / 14) and math.isclose(r["edge_jaccard"], 0.7)
    r = evaluate.macro(evaluate.route_metrics(evaluate.align(rows(spark, {"a": [1, 1, 2]}), rows(spark, {"a": [2, 1]})))).first()
    assert [r[c] for c in evaluate.METRICS] == [0, 1, 1, 1, 1]
    for guess, fault in (({"a": [1]}, "missing id b"), ({"a": [1], "b": [1], "c": [1]}, "extra id c")):
        with pytest.raises(Exception, match=fault):
            evaluate.align(truth, rows(spark, guess)).collect()
    assert [tuple(r) for r in evaluate.misaligned(truth, rows(spark, {"a": [1], "c": [1]})).orderBy("kind").collect()] == [("c", "extra"), ("b", "missing")]


def test_paired_interval(spark):
    truth = {"a": [1, 2], "b": [3, 4], "c": [5, 6]}
    own = evaluate.route_metrics(evaluate.align(rows(spark, truth), rows(spark, {"a": [1, 2], "b": [3], "c": [5, 7]})))
    other = evaluate.route_metrics(evaluate.align(rows(spark, truth), rows(spark, truth)))
    assert evaluate.endpoint_failures(own).first()["failures"] == 2 and evaluate.endpoint_failures(other).first()["failures"] == 0
    r = evaluate.paired_interval(other, own, ["edge_f1"]).first()
    assert r["n"] == 3 and r["mean"] > 0


def test_markov(spark):
    _, n6 = net(spark, [0, 1, 1, 2], [1, 3, 2, 3], [1] * 4)
    arcs = graph.transitions(n6)
    counts = spark.createDataFrame([(0, 9), (1, 1), (2, 0)], "coord long, n long")
    assert [r["cost"] for r in stats.markov_costs(arcs, counts, 1.0).orderBy("coord").collect()] == [18232, 179176, 1]


def test_associations_and_candidates(spark):
    own = trips(spark, [0, 1, 2, 3], [0, 2, 3])
    da = stats.associations(own)
    assert {(r["src"], r["dst"]): r["n"] for r in da.collect()} == {(0, 1): 1, (0, 2): 2, (0, 3): 2, (1, 2): 1, (1, 3): 1, (2, 3): 2}
    pool = stats.candidate_pool(spark.createDataFrame([(0, 3)], "src long, dst long"), da)
    assert [(r["edge"], r["strength"]) for r in pool.orderBy("rank").collect()] == [(2, 2), (1, 1)]
    counts = spark.createDataFrame([(0, 0, 100), (0, 3, 100), (3, 3, 99), (0, 1, 5), (1, 3, 5)], "src long, dst long, n long")
    one = trips(spark, [0, 1, 2, 3])
    r = stats.candidate_rows(one, stats.candidate_pool(spark.createDataFrame([(0, 3)], "src long, dst long"), counts, 3)).first()
    assert r["candidates"] == [0, 3, 1] and r["labels"] == [0, 0, 1] and math.isclose(r["weights"][2], math.e)


def test_planner(spark):
    near = {0: [1, 2], 1: [3], 2: [4], 3: [5], 4: [5], 5: []}
    da = {(i, 5): 4 for i in (1, 2, 3, 4)}
    assert predict.Planner(near, da, {1: 0.1, 2: 0.9}).leg(0, 5) == [0, 2, 4, 5]
    assert predict.Planner(near, {}, {1: 0.1, 2: 0.9}).leg(0, 5) == [0, 1, 3, 5]
    assert predict.Planner(near, da).leg(0, 5) == [0, 1, 3, 5]
    assert predict.Planner({}, {}).leg(0, 2) == [0]
    trap = {0: [1], 1: [0, 2], 2: [1]}  # all ways of 1 are used the second time, and the counts name 2
    assert predict.Planner(trap, {(2, 9): 5}, cap=5).leg(0, 9) == [0, 1, 2, 1, 0]
    assert predict.Planner(trap, {(2, 9): 5}, {0: 0.1, 2: 0.9}, cap=5).leg(0, 9) == [0, 1, 2, 1, 0]
    assert predict.Planner({0: [1], 1: [2]}, {}, cap=2).via(0, 1, 2) == [0, 1, 2]


def test_contraction_and_shortcuts(spark):
    # Node 0 has fewer arcs than node 1 but for the one to itself, which stays with an active node.
    active, sparse, order, cuts = shortcuts.contract([[0, 1], [2], [1]], 0.34)
    assert order == [0] and sparse == [[], [2], [1]] and cuts == []
    assert shortcuts.contract([[0], [0]], 0.0)[1] == [[0], [0]]
    with pytest.raises(ValueError):
        shortcuts.contract([[1], [0]], 1.0)
    active, sparse, order, cuts = shortcuts.contract([[2], [0], []], 0.34)
    assert order == [0] and active == [False, True, True] and sparse == [[], [2], []] and cuts == [(1, 2)]
    on, pair = spark.createDataFrame([(1,), (2,)], "edge long"), spark.createDataFrame([(1, 2)], "prev long, next long")
    assert [r["path"] for r in shortcuts.observations(trips(spark, [1, 0, 2]), on, pair).collect()] == [[1, 0, 2]]
    seen = spark.createDataFrame([(1, 9, [1, 4, 9], 1), (1, 9, [1, 5, 9], 1)], "src long, dst long, path array<long>, n long")
    assert shortcuts.medoids(seen).first()["path"] == [1, 4, 9]
    seen = spark.createDataFrame([(1, 9, [1, 4, 9], 1), (1, 9, [1, 5, 9], 3)], "src long, dst long, path array<long>, n long")
    assert shortcuts.medoids(seen).first()["path"] == [1, 5, 9]
    arcs, known = spark.createDataFrame([(0, 1), (1, 2)], "prev long, next long"), spark.createDataFrame([(0, 2, [0, 1, 2])], "src long, dst long, path array<long>")
    assert shortcuts.expand(trips(spark, [0, 2]), arcs, known).first()["edges"] == [0, 1, 2]
    with pytest.raises(Exception, match="no path for 0 to 5"):
        shortcuts.expand(trips(spark, [0, 5]), arcs, known).collect()


def test_rollout_and_walks(spark):
    arcs = spark.createDataFrame([(i, i + 1) for i in range(4)], "prev long, next long")
    asked = spark.createDataFrame([("a", 0, 4)], "sample_id string, src long, dst long")
    assert predict.rollout(asked, arcs, lambda a, w, d: -w.astype(float)).first()["edges"] == [0, 1, 2, 3, 4]
    starts = spark.createDataFrame([(0,), (1,), (2,)], "edge long")
    first = sorted(map(tuple, predict.walks(starts, arcs, 5, 3, seed=1).select("walk", F.array_join("edges", ",")).collect()))
    assert len(first) == 9 and first == sorted(map(tuple, predict.walks(starts.repartition(2), arcs, 5, 3, seed=1).select("walk", F.array_join("edges", ",")).collect()))


def test_rollouts_with_the_same_ends_share_a_walk(spark):
    arcs = spark.createDataFrame([(-1, 7), (7, 3), (7, 5), (3, 9), (5, 9), (9, -1), (9, 4)], "prev long, next long")
    asked = spark.createDataFrame([(f"{k}:{s}:{d}", s, d) for k in range(300) for s, d in ((-1, 4), (7, 5), (8, 4), (4, 4))], "sample_id string, src long, dst long")

    def scorer(at, candidate, destination):
        if len(at) > 50:
            raise ValueError("a walk is made again for each query")
        return np.where(candidate == 3, np.nan, np.where(at == 9, 0.0, candidate == destination))

    def found(**options):
        rows = predict.rollout(asked.coalesce(1), arcs, scorer, **options).collect()
        assert len(rows) == len({r["sample_id"] for r in rows}) == 1200
        return {tuple(map(int, r["sample_id"].split(":")[1:])): r["edges"] for r in rows}

    assert found() == {(-1, 4): [-1, 7, 5, 9], (7, 5): [7, 5], (8, 4): [8], (4, 4): [4]}  # -1 ties with 4, and was seen
    assert found(cap=6, revisit=True)[-1, 4] == [-1, 7, 5, 9, -1, 7]
    assert found(cap=2)[-1, 4] == [-1, 7] and found(cap=1)[7, 5] == [7]


def test_parallel(spark):
    _, edges = net(spark, [0, 0, 1], [1, 1, 2], [5, 2, 3])
    assert {(r["head"], r["tail"]): r["weight"] for r in graph.parallel_minimum(edges).collect()} == {(1, 0): 2, (2, 1): 3}
    assert [r["canonical"] for r in graph.canonical_parallel(edges).orderBy("edge_id").collect()] == [1, 1, 2]


def test_strict_records(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"sample_id":"a","original_edge_ids":[1,2]}\n{"original_edge_ids":[3,4],"sample_id":"b"}\n')
    assert {r["sample_id"]: r["edges"] for r in records.read_jsonl(spark, str(p), records.DATASET).collect()} == {"a": [1, 2], "b": [3, 4]}
    bad = ["", '{"sample_id":"a"}', '{"sample_id":"a","sample_id":"b","original_edge_ids":[1,2]}', '{"sample_id":5,"original_edge_ids":[1,2]}', '{"sample_id":"a","original_edge_ids":[1,true]}', '{"sample_id":"a","original_edge_ids":[1,-2]}', '{"sample_id":"a","original_edge_ids":[1,4294967296]}', '{"sample_id":"a\\u0001","original_edge_ids":[1,2]}', "nonsense"]
    found = records.json_faults(spark.createDataFrame([(b,) for b in bad], "value string"), records.DATASET).collect()
    assert {r["value"]: r["fault"] for r in found} == dict(zip(bad, ["blank_line", "wrong_keys", "wrong_keys", "id_not_a_string", "bad_edge", "bad_edge", "bad_edge", "control_character", "not_an_object"]))


def test_documents():
    good = {"schema_version": 1, "dataset": {"nodes": "n", "edges": "e", "trajectories": "t"}, "fit": {"eta0": 0.5, "lambda": 0.1, "lower_factor": 0.1, "upper_factor": 10, "updates": 3}, "runtime": {"threads": 1, "checkpoint_every": 2}}
    assert records.config(json.dumps(good))[1] == FitOptions(0.5, 0.1, 0.1, 10, 3)
    with pytest.raises(ValueError):
        records.config(json.dumps(good | {"more": 1}))
    with pytest.raises(ValueError):
        records.strict_json('{"a":1,"a":2}')
    for path in ("../x", "/x", " ", "a/../../b"):
        with pytest.raises(ValueError):
            records.safe_relative(path)
    assert records.split_role("city-test-2020") == "test"
    assert records.load_pickle(pickle.dumps([("a", [1, True, -5], (1, 2))])) == [("a", [1, -1, -1], 1, 2)]
    with pytest.raises(pickle.UnpicklingError):
        records.load_pickle(pickle.dumps([FitOptions()]))
    for bad in ({"eta0": 0}, {"lower": 2.0}, {"updates": 0}, {"lam": -1.0}):
        with pytest.raises(ValueError):
            FitOptions(**bad)


def dbf(path, fields, rows):
    """A dBASE file of numeric fields (name, size, places)."""
    width = 1 + sum(s for _, s, _ in fields)
    head = struct.pack("<BBBBIHH20x", 3, 120, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width)
    head += b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"N", s, p) for n, s, p in fields) + b"\r"
    path.write_bytes(head + b"".join(b" " + b"".join(str(v).rjust(s).encode() for v, (_, s, _) in zip(r, fields)) for r in rows) + b"\x1a")


def test_shape_tables(spark, tmp_path):
    shapes.register(spark)
    dbf(tmp_path / "e.dbf", [("fid", 8, 0), ("u", 8, 0), ("v", 8, 0), ("length", 10, 4)], [(0, 40, 20, 1.25), (1, 20, 80, 2.25)])
    own = spark.read.format("road_table").option("kind", "edges").load(str(tmp_path / "e.dbf")).orderBy("ord").collect()
    assert [tuple(r) for r in own] == [(0, 40, 20, 1.25, 0), (1, 20, 80, 2.25, 1)]
    dbf(tmp_path / "n.dbf", [("osmid", 8, 0)], [(40,), (20,)])
    shape = lambda i, x, y, kind: struct.pack(">ii", i, 10) + struct.pack("<idd", kind, x, y)
    (tmp_path / "n.shp").write_bytes(b"\0" * 100 + shape(1, 1.5, 2.5, 1) + shape(2, 3.0, 4.0, 3))
    assert [tuple(r) for r in spark.read.format("road_table").option("kind", "nodes").load(str(tmp_path / "n.dbf")).collect()] == [(40, 1.5, 2.5, 0)]
    data = (tmp_path / "e.dbf").read_bytes()
    (tmp_path / "e.dbf").write_bytes(data[:-20])
    with pytest.raises(Exception, match="bytes beside the records"):
        spark.read.format("road_table").load(str(tmp_path / "e.dbf")).collect()


def test_time_report(spark):
    text = "\tUser time (seconds): 1.50\n\tSystem time (seconds): 0.25\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n\tMaximum resident set size (kbytes): 2048\n\tExit status: 0\n"
    r = records.time_report(spark.createDataFrame([(text,)], "t string"), F.col("t")).first()
    assert (r["user_s"], r["system_s"], r["elapsed_s"], r["peak_kib"], r["exit"]) == (1.5, 0.25, 62.5, 2048, 0)


def test_archive(spark):
    one = spark.range(1)
    assert one.select(archive.departure_hour(F.lit(0))).first()[0] == 8
    assert one.select(archive.speed(F.lit(100.0), F.lit(1)), archive.speed(F.lit(1.0), F.lit(0))).first() == (33.33, None)


def test_export_and_stream(spark, n1, tmp_path):
    from pathloom.streaming import routes

    own = validate.classify(trips(spark, [0, 1, 2], [0, 3, 4], []), n1[1])
    good = own.where("reason = 'accepted'").select("sample_id", "edges")
    audit = sinks.export_dataset(good, validate.report(own), str(tmp_path / "out"), "d-test", "n")
    assert audit == {"available": 3, "reasons": {"accepted": 2, "empty": 1}}
    assert records.read_jsonl(spark, str(tmp_path / "out" / "records"), records.DATASET).count() == 2
    with pytest.raises(FileExistsError):
        sinks.export_dataset(good, validate.report(own), str(tmp_path / "out"), "d-test", "n")
    good.write.parquet(str(tmp_path / "in"))
    arcs = graph.transitions(n1[1])
    ask = lambda binding: routes.predict_stream(spark, str(tmp_path / "in"), str(tmp_path / "pred"), str(tmp_path / "check"), arcs, predict.length_metric(arcs), binding)
    assert ask({"v": 1}).count() == 2
    trips(spark, [1, 2]).write.mode("append").parquet(str(tmp_path / "in"))
    assert ask({"v": 1}).count() == 3
    with pytest.raises(ValueError, match="another configuration"):
        ask({"v": 2})


def test_walks_meet_the_network_in_joins(spark, monkeypatch):
    """The same walks as by a loop over the whole network, which is never fetched."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 14, (40, 2)) if a < 12})
    near = {}
    for a, b in rows:
        near.setdefault(a, []).append(b)
    right = []
    for edge, ordinal in ((e, i) for e in range(14) for i in range(4)):
        draw, walk = np.random.default_rng([9, edge, ordinal]), [edge]
        while len(walk) < 6 and near.get(walk[-1]):
            ways = near[walk[-1]]
            weight = np.array([1 / 0.5 if len(walk) > 1 and w == walk[-2] else 1.0 if len(walk) < 2 or w in near.get(walk[-2], ()) else 1 / 2.0 for w in ways])
            walk.append(ways[int(draw.choice(len(ways), p=weight / weight.sum()))])
        right.append((f"{edge}:{ordinal}", walk))
    arcs, starts = spark.createDataFrame(rows, "prev long, next long"), spark.range(14).withColumnRenamed("id", "edge")
    monkeypatch.setattr(type(arcs), "toLocalIterator", None)
    found = predict.walks(starts, arcs, 6, 4, p=0.5, q=2.0, seed=9)
    assert sorted((r.walk, r.edges) for r in found.collect()) == sorted(right)
    assert sorted(r.edges for r in predict.walks(starts, arcs, 1, 1).collect()) == [[i] for i in range(14)]
