"""Walks by joins: those of the rollout that holds the network, and a query that holds neither network nor features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import predict, scorers
from pathloom.plans import street_queries, streets

SF = "/root/testdata/sf0.001"


def test_towers_by_joins_walk_as_before(spark, monkeypatch):
    arcs, trips = streets.arcs(spark, SF), streets.trips(spark, SF).limit(60)
    both = street_queries._features(spark, SF)
    features, popular = both.select("node", "features"), both.select("node", "popularity")
    weights = [street_queries._weights(10, 6, 3), street_queries._weights(6, 5, 4)], [street_queries._weights(5, 7, 5), street_queries._weights(7, 5, 6)]
    e = F.col("edges")
    asked = trips.select("sample_id", F.element_at(e, 1).alias("src"), F.element_at(e, -1).alias("dst"))
    asked = asked.union(spark.createDataFrame([("same", 3, 3), ("far", 5, 600)], "sample_id string, src long, dst long"))
    towers = scorers.two_towers(features, popular, *weights)
    for cap, revisit in ((8, False), (5, True), (1, False)):
        wanted = {r.sample_id: r.edges for r in predict.rollout(asked, arcs, towers, cap, revisit).collect()}
        found = predict.rollout_by_joins(asked, arcs, scorers.tower_rows(features, popular), scorers.Towers(*weights), cap, revisit).collect()
        assert {r.sample_id: r.edges for r in found} == wanted and len(found) == len(wanted)
    monkeypatch.setattr(scorers, "two_towers", lambda *_, **__: pytest.fail("the features are on the driver"))
    monkeypatch.setattr(predict, "rollout", lambda *_, **__: pytest.fail("the network is on the driver"))
    assert street_queries.two_tower_rollout(spark, SF).count() == 1


def test_walks_by_joins_take_the_smaller_edge_and_end_at_dead_ends(spark):
    arcs = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0)], "prev long, next long")
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "node long, x array<double>")
    asked = spark.createDataFrame([("a", 0, 4), ("b", 4, 0), ("c", 2, 2)], "sample_id string, src long, dst long")
    even = lambda at, way, to: np.zeros(len(at))
    found = {r.sample_id: r.edges for r in predict.rollout_by_joins(asked, arcs, rows, even).collect()}
    assert found == {"a": [0, 1, 3], "b": [4], "c": [2]}
    with pytest.raises(Exception, match="without features"):
        predict.rollout_by_joins(asked, arcs, rows.where("node <> 3"), even).collect()
