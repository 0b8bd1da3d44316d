"""Scorers with given weights: graph convolutions as joins and sums, and two towers that rate the next edge.

A layer multiplies the features by the normalised adjacency, a sparse product by join and sum on the cluster, and then by
a small dense matrix in Arrow batches. Two towers rate candidates in arrays, so that a rollout can take them as its scorer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import apart, kept

#: Numbers of an embedding table that is sent to all executors at most; a larger one is an error.
MOST_NUMBERS = 64_000_000


def normalised(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(prev, next, norm) of arcs (prev, next) and a loop at each of ``nodes`` (node): 1 / sqrt(d(prev) d(next)).

    d counts what enters a node, its loop included. Arcs that occur twice count twice; ends that are no nodes are left out.
    """
    loops = nodes.select(F.col("node").alias("prev"), F.col("node").alias("next"))
    known = apart(nodes.select("node").distinct())
    every = loops.distinct().union(arcs.select("prev", "next").join(known.withColumnRenamed("node", "prev"), "prev", "left_semi").join(known.withColumnRenamed("node", "next"), "next", "left_semi").select("prev", "next"))
    degree = apart(every.groupBy("next").agg(F.count("*").alias("d")))
    one = degree.select(F.col("next").alias("prev"), F.col("d").alias("_d"))
    return every.join(degree, "next").join(one, "prev").select("prev", "next", (1 / F.sqrt(F.col("d") * F.col("_d"))).alias("norm"))


def propagate(norm: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """The sparse product: (node, features) with features of ``width`` numbers, summed where they lie before the shuffle."""
    rows = norm.join(apart(features.select(F.col("node").alias("prev"), F.col("features").alias("_x"))), "prev")
    sums = [F.sum(F.col("norm") * F.get("_x", F.lit(i))).alias(f"_{i}") for i in range(width)]
    return rows.groupBy(F.col("next").alias("node")).agg(*sums).select("node", F.array(*(F.col(f"_{i}") for i in range(width))).alias("features"))


def dense(features: DataFrame, weight: np.ndarray, bias: np.ndarray, relu: bool) -> DataFrame:
    """(node, features) times a matrix plus a bias, negatives cut off with ``relu``; rows of another width are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if set(batch.column(1).value_lengths().to_pylist()) - {len(weight)}:
                raise ValueError(f"features need {len(weight)} numbers")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(weight)) @ weight + bias
            x = np.maximum(x, 0) if relu else x
            offsets = pa.array(np.arange(len(x) + 1) * weight.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], names=["node", "features"])

    return features.select("node", "features").mapInArrow(run, "node long, features array<double>")


def convolve(arcs: DataFrame, features: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(node, features) after graph-convolution ``layers`` (matrix, bias), all but the last cut off at zero."""
    norm = kept(normalised(arcs, features))
    for i, (weight, bias) in enumerate(layers):
        features = kept(dense(propagate(norm, features, len(weight)), weight, bias, i < len(layers) - 1))
    return features


@dataclass
class TwoTowers:
    """A scorer: the product of an encoded query (edge, destination) and an encoded candidate (edge, popularity).

    ``query`` and ``candidate`` are each two layers (matrix, bias) with the cut-off at zero between; the offsets on both
    edges are fixed, as routes run from the end of an edge to the end of another.
    """

    keys: np.ndarray
    features: np.ndarray
    popularity: np.ndarray
    query: list[tuple[np.ndarray, np.ndarray]]
    candidate: list[tuple[np.ndarray, np.ndarray]]
    offsets: tuple[float, float] = (1.0, 1.0)

    def _rows(self, nodes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, nodes), len(self.keys) - 1)
        if not (self.keys[at] == nodes).all():
            raise ValueError("an edge without features")
        return at

    def __call__(self, at: np.ndarray, candidate: np.ndarray, destination: np.ndarray) -> np.ndarray:
        at, candidate, destination = (self._rows(x) for x in (at, candidate, destination))
        own = np.hstack((self.features[candidate], self.popularity[candidate, None]))
        return Towers(self.query, self.candidate, self.offsets)(self.features[at], own, self.features[destination])


@dataclass
class Towers:
    """The product of both towers for rows of features; a row of the candidate ends with its popularity, and others may."""

    query: list[tuple[np.ndarray, np.ndarray]]
    candidate: list[tuple[np.ndarray, np.ndarray]]
    offsets: tuple[float, float] = (1.0, 1.0)

    @staticmethod
    def _encoded(x: np.ndarray, layers) -> np.ndarray:
        (a, b), (c, d) = layers
        return np.maximum(x @ a + b, 0) @ c + d

    def __call__(self, at: np.ndarray, candidate: np.ndarray, destination: np.ndarray) -> np.ndarray:
        one, width = np.ones((len(at), 1)), candidate.shape[1] - 1
        query = np.hstack((at[:, :width], one * self.offsets[0], destination[:, :width], one * self.offsets[1]))
        return (self._encoded(query, self.query) * self._encoded(candidate, self.candidate)).sum(1)


def tower_rows(features: DataFrame, popularity: DataFrame) -> DataFrame:
    """(node, x): ``features`` (node, features) followed by ``popularity`` (node, popularity); lacking popularity is 0."""
    rows = features.join(apart(popularity), "node", "left")
    return rows.select("node", F.concat("features", F.array(F.coalesce("popularity", F.lit(0.0)))).alias("x"))


def two_towers(features: DataFrame, popularity: DataFrame, query, candidate, most: int = MOST_NUMBERS) -> TwoTowers:
    """Towers over ``features`` (node, features) and ``popularity`` (node, popularity); lacking popularity is 0.

    The table is bounded by the network and goes to the driver and to each executor; above ``most`` numbers it is an error.
    """
    rows = features.join(popularity, "node", "left").select("node", "features", F.coalesce("popularity", F.lit(0.0)).alias("popularity"))
    width = len(candidate[0][0]) - 1
    if features.count() * (width + 2) > most:
        raise ValueError(f"more than {most} numbers of features")
    found = rows.toPandas().sort_values("node")
    return TwoTowers(found.node.to_numpy(np.int64), np.stack(found.features.tolist()), found.popularity.to_numpy(np.float64), query, candidate)
