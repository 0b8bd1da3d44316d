"""Graph convolutions, two towers and skip-gram training against dense numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.operators import predict, scorers, skipgram


def test_two_layers_equal_dense(spark):
    rng = np.random.default_rng(2)
    n, arcs = 30, [(a, b) for a, b in np.random.default_rng(3).integers(0, 30, (90, 2)).tolist()]
    x, layers = rng.normal(size=(n, 4)), [(rng.normal(size=(4, 5)), rng.normal(size=5)), (rng.normal(size=(5, 3)), rng.normal(size=3))]
    adjacency = np.eye(n)
    for a, b in arcs:
        adjacency[b, a] += 1
    d = adjacency.sum(1)
    adjacency /= np.sqrt(d[:, None] * d[None, :])
    hidden = np.maximum(adjacency @ x @ layers[0][0] + layers[0][1], 0)
    expected = adjacency @ hidden @ layers[1][0] + layers[1][1]
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>").repartition(3)
    found = scorers.convolve(spark.createDataFrame([*arcs, (99, 1), (1, 99)], "prev long, next long"), features, layers).toPandas().sort_values("node")
    assert np.allclose(np.stack(found.features.tolist()), expected)
    with pytest.raises(Exception, match="features need 5 numbers"):
        scorers.dense(features, layers[1][0], layers[1][1], True).collect()


def test_towers_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    keys, x, pop = [3, 5, 9, 12], rng.normal(size=(4, 2)), rng.random(4)
    query, candidate = [(rng.normal(size=(6, 4)), rng.normal(size=4)), (rng.normal(size=(4, 3)), rng.normal(size=3))], [(rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 3)), rng.normal(size=3))]
    features = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "node long, features array<double>")
    popularity = spark.createDataFrame([(k, float(p)) for k, p in zip(keys[:3], pop)], "node long, popularity double")
    towers = scorers.two_towers(features, popularity, query, candidate)
    at, to, dst = np.array([3, 12, 5]), np.array([5, 12, 3]), np.array([9, 9, 12])
    i = {k: j for j, k in enumerate(keys)}
    encode = lambda v, layers: np.maximum(v @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1]
    for a, c, t, score in zip(at, to, dst, towers(at, to, dst)):
        q = encode(np.array([*x[i[a]], 1.0, *x[i[t]], 1.0]), query)
        assert np.isclose(score, q @ encode(np.array([*x[i[c]], pop[i[c]] if c < 12 else 0.0]), candidate))
    with pytest.raises(ValueError, match="without features"):
        towers(np.array([4]), np.array([3]), np.array([3]))
    with pytest.raises(ValueError, match="more than 15 numbers"):
        scorers.two_towers(features, popularity, query, candidate, most=15)
    arcs = spark.createDataFrame([(3, 5), (3, 12), (5, 9), (12, 9)], "prev long, next long")
    routes = predict.rollout(spark.createDataFrame([("a", 3, 9)], "sample_id string, src long, dst long"), arcs, towers).first().edges
    best = max((5, 12), key=lambda c: towers(np.array([3]), np.array([c]), np.array([9]))[0])
    assert routes == [3, best, 9]


def test_alias_table_has_the_weights():
    for w in ([1.0], [1, 1, 1], [5, 1, 0.5, 10, 3], np.random.default_rng(1).random(200)):
        w = np.asarray(w, float)
        keep, other = skipgram.alias_rows(w)
        got = keep / len(w)
        np.add.at(got, other, (1 - keep) / len(w))
        assert np.allclose(got, w / w.sum())


def test_draws_follow_the_weights(spark):
    n = np.array([0, 3, 50, 200, 7])
    nodes = spark.createDataFrame([(10 * i, int(c)) for i, c in enumerate(n)], "node long, n long")
    table = skipgram.negatives_table(nodes)
    pairs = spark.range(8000).select(F.col("id").alias("center"), (F.col("id") * 3).alias("context"), F.lit(1).cast("long").alias("n"))
    found = skipgram.draws(pairs.repartition(5), table, 5, 5, 7, 0)
    counts = dict(found.groupBy("context").count().collect())
    p = (1.0 + n) ** 0.75
    expected = 40_000 * p / p.sum()
    assert sum((counts.get(10 * i, 0) - e) ** 2 / e for i, e in enumerate(expected)) < 18.5  # 0.1 % of 4 degrees
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(found) == key(skipgram.draws(pairs.coalesce(1), table, 5, 5, 7, 0)) != key(skipgram.draws(pairs, table, 5, 5, 7, 1))


def test_a_round_equals_numpy(spark):
    rng = np.random.default_rng(8)
    n, width = 12, 4
    pairs = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, n, 60), rng.integers(0, n, 60), rng.integers(1, 9, 60))]
    negatives = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, n, 80), rng.integers(0, n, 80), rng.integers(1, 9, 80))]
    a, b = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    ga, gb, na, nb, loss = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.zeros(n), np.zeros(n), 0
    for rows, positive in ((pairs, True), (negatives, False)):
        for c, x, k in rows:
            one, two, l = skipgram.gradients(a[[c]], b[[x]], np.array([positive]), np.array([k], float))
            ga[c], gb[x], loss = ga[c] + one[0], gb[x] + two[0], loss + int(l[0])
            na[c], nb[x] = na[c] + k, nb[x] + k
    table = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "node long, v array<double>")
    frame = lambda rows: spark.createDataFrame(rows, "center long, context long, n long")
    step = lambda v, g, k: v - np.where(k[:, None] > 0, g / float(skipgram.UNIT) / np.maximum(k, 1)[:, None], 0) * 0.5
    for parts in (1, 5):
        c, x, mean = skipgram.one_round(table(a).repartition(parts), table(b), frame(pairs).repartition(parts), frame(negatives).repartition(parts), width, 0.5)
        for found, expected in ((c, step(a, ga, na)), (x, step(b, gb, nb))):
            assert (np.stack(found.toPandas().sort_values("node").v.tolist()) == expected).all()
        assert mean == loss / skipgram.UNIT / (na.sum())


def test_training_lowers_the_loss(spark):
    rows = [(a, b, 5) for g in (range(6), range(6, 12)) for a in g for b in g if a != b]
    nodes = spark.createDataFrame(pd.DataFrame({"node": range(13), "n": [10] * 12 + [0]}))
    pairs = spark.createDataFrame(rows, "center long, context long, n long")
    found, losses = skipgram.train(pairs, nodes, width=6, each=3, rounds=10, rate=4.0, seed=1)
    assert losses[-1] < 0.9 * losses[0] and found.count() == 13
    v = np.stack(found.toPandas().sort_values("node").v.tolist())[:12]
    same = v @ v.T
    assert same[:6, :6].mean() > same[:6, 6:].mean()
    with pytest.raises(ValueError, match="no pairs"):
        skipgram.train(pairs.limit(0), nodes)
