"""Lipschitz embeddings over several blocks."""

import pytest
from pyspark.sql import functions as F

from pathloom.operators import lipschitz, overlay
from pathloom.plans import streets

SF = "/root/testdata/sf0.001"


def test_embeddings_need_no_overlay(spark, monkeypatch):
    monkeypatch.setattr(overlay, "customise", lambda *_: pytest.fail("an overlay is made"))
    places = streets.nodes(spark, SF).select(F.col("node_id").alias("node"), (F.col("y") * 0.002 + 47.3).alias("lat"), (F.col("x") * 0.002 + 8.5).alias("lon"))
    edges, anchors = streets.edges(spark, SF), spark.createDataFrame([(3,), (70,)], "node long")
    rows = lambda size: sorted(map(tuple, lipschitz.embed(edges, places, anchors, size).withColumn("value", F.round("value", 9)).collect()))
    few = rows(20)
    assert few == rows(10_000) and len(few) == 2 * places.count()
