"""Lipschitz embeddings: what places have in common by their distances to a few anchors.

Distances run along streets to the anchors, so the graph is reversed; of parallel streets the shortest counts. All
anchors are searched for together over blocks of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import WIDE, BlockOracle
from .graph import parallel_minimum
from .predict import anchor_features, haversine
from .tables import kept

#: Lengths are whole millimetres, so that sums don't depend on their order.
PER_KM = 1_000_000


def seeded_order(seed: int, node: Column) -> Column:
    """What nodes are drawn by: the same for every partitioning and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), node.cast("string")))


def choose_anchors(nodes: DataFrame, dimensions: int, seed: int) -> DataFrame:
    """``dimensions`` different nodes of ``nodes`` (node) by seeded order; fewer than that are an error."""
    found = nodes.select("node").distinct().withColumn("_o", seeded_order(seed, F.col("node"))).orderBy("_o", "node").limit(dimensions)
    n = found.count()
    if n < dimensions:
        raise ValueError(f"{dimensions} anchors of {n} nodes")
    return found.select("node")


def street_lengths(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(edge_id, tail, head, w): lengths along the sphere in millimetres, at least one, of ``edges`` between ``places`` (node, lat, lon)."""
    a, b = (places.select(F.col("node").alias(end), F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}")) for i, end in enumerate(("tail", "head")))
    km = haversine(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    return edges.join(a, "tail").join(b, "head").select("edge_id", "tail", "head", F.greatest(F.round(km * PER_KM), F.lit(1)).cast("long").alias("w"))


def embed(edges: DataFrame, places: DataFrame, anchors: DataFrame, size: int = WIDE) -> DataFrame:
    """(node, anchor, value) of every node of ``places`` (node, lat, lon) for each of ``anchors`` (node).

    With d the kilometres from a node to an anchor along ``edges`` (edge_id, tail, head), its value is 1 / (d + 1), 0
    where no way leads there, as z-score of the anchor over all nodes; an anchor without variance is an error. Edges
    between unknown places are left out.
    """
    shortest = parallel_minimum(street_lengths(edges, places), "w")  # (head, tail, weight): reversed
    arcs = kept(shortest.select(F.xxhash64("head", "tail").alias("coord"), F.col("head").alias("prev"), F.col("tail").alias("next"), F.col("weight").alias("w")))
    oracle = BlockOracle(places.select("node", F.col("lon").alias("x"), F.col("lat").alias("y")))
    found = kept(oracle.distances_from(arcs, arcs.select("coord", "w"), anchors.select(F.col("node").alias("s")), size))
    return anchor_features(found.select(F.col("s").alias("source"), "node", (F.col("distance") / PER_KM).alias("distance")), places)
