"""Shortest paths over a line graph, with one rule for ties.

Of equal distances a node's predecessor is the one with the least (distance, node), and a query's target the least
(distance, node). A search holds the graph in arrays that are broadcast; queries with the same sources share one search.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import INFINITY, MAX_TRANSITIONS

PATH = "qid long, distance long, nodes array<long>, coords array<long>"


class Oracle(Protocol):
    """What a fit or a prediction needs of a search: a versioned identity and paths for queries."""

    identity: str

    def shortest_paths(self, arcs: DataFrame, metric: DataFrame, queries: DataFrame) -> DataFrame: ...


class Graph:
    """Arcs by tail in plain lists: (head, coord, weight)."""

    def __init__(self, coord: np.ndarray, prev: np.ndarray, next_: np.ndarray, weight: np.ndarray):
        order = np.lexsort((next_, prev))
        self.prev, self.head, self.coord, self.weight = prev[order], next_[order], coord[order], weight[order]
        count = int(max(self.prev.max(), self.head.max())) + 1 if len(order) else 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.prev, minlength=count)))).astype(np.int64)
        self.nodes = count
        self.limit = INFINITY if np.issubdtype(weight.dtype, np.integer) else float("inf")
        self._lists = None

    def lists(self):
        if self._lists is None:  # made once in a worker
            self._lists = self.first.tolist(), self.head.tolist(), self.coord.tolist(), self.weight.tolist()
        return self._lists

    def __getstate__(self):
        return self.__dict__ | {"_lists": None}

    def search(self, sources: list[int], targets: set[int], ways: dict[int, int] | None = None) -> tuple[dict, dict]:
        """Distances and predecessors (node, coord) until all ``targets`` are settled; ``ways`` is filled with the numbers of shortest paths.

        Weights are positive, so what leads to a node is settled before it; numbers of nodes that aren't settled may lack some.
        """
        first, head, coord, weight = self.lists()
        distance = dict.fromkeys(sources, 0)
        before: dict[int, tuple[int, int]] = {}
        heap, settled, left = [(0, s) for s in sorted(distance)], set(), set(targets)
        if ways is not None:
            ways.update(distance.fromkeys(distance, 1))
        while heap and left:
            d, u = heapq.heappop(heap)
            if u in settled:
                continue
            settled.add(u)
            left.discard(u)
            if u >= self.nodes:
                continue
            for i in range(first[u], first[u + 1]):
                far, v = d + weight[i], head[i]
                known = distance.get(v, self.limit)
                if far < known:
                    distance[v], before[v] = far, (u, coord[i])
                    heapq.heappush(heap, (far, v))
                    if ways is not None:
                        ways[v] = ways[u]
                elif far == known and ways is not None and v in ways:
                    ways[v] += ways[u]
        return {u: distance[u] for u in settled}, before

    def count(self, distance: dict, sources: list[int]) -> dict[int, int]:
        """How many shortest paths lead to each settled node from any of ``sources``, by sums over arcs on shortest paths."""
        first, head, _, weight = self.lists()
        ways = dict.fromkeys(distance, 0)
        ways.update(dict.fromkeys(sources, 1))
        for u in sorted(distance, key=distance.__getitem__):  # weights are positive: what leads to u comes before it
            for i in range(first[u], first[u + 1]) if u < self.nodes else ():
                if distance.get(head[i]) == distance[u] + weight[i]:
                    ways[head[i]] += ways[u]
        return ways

    def path(self, distance: dict, before: dict, targets) -> tuple:
        """(distance, nodes, coords) of the nearest target, or nulls if none is reached."""
        found = [(distance[t], t) for t in targets if t in distance]
        if not found:
            return None, None, None
        far, at = min(found)
        nodes, coords = [at], []
        while at in before:
            at, c = before[at]
            nodes.append(at)
            coords.append(c)
        return far, nodes[::-1], coords[::-1]


def collect_graphs(arcs: DataFrame, metrics: list[DataFrame]) -> list[Graph]:
    """A graph for each metric, fetched together: at most MAX_TRANSITIONS arcs, each with a positive weight below the limit."""
    rows = arcs.select("coord", "prev", "next")
    for i, metric in enumerate(metrics):
        rows = rows.join(metric.select("coord", F.col("w").alias(f"w{i}")), "coord", "left")
    rows = rows.limit(MAX_TRANSITIONS + 1).toPandas()
    if len(rows) > MAX_TRANSITIONS:
        raise ValueError("too many transitions")
    for i in range(len(metrics)):
        w = rows[f"w{i}"]
        bad = rows[w.isna() | (w < 1) | (w >= INFINITY)].sort_values("coord")
        if len(bad):
            raise ValueError(f"coordinate {bad.coord.iloc[0]}: bad weight {bad[f'w{i}'].iloc[0]}")
    return [Graph(*(rows[c].to_numpy(np.int64) for c in ("coord", "prev", "next", f"w{i}"))) for i in range(len(metrics))]


def collect_graph(arcs: DataFrame, metric: DataFrame) -> Graph:
    """The graph of one metric on the driver."""
    return collect_graphs(arcs, [metric])[0]


class DijkstraOracle:
    """Searches in Arrow batches; a batch runs one search for each distinct set of sources."""

    identity = "pathloom-dijkstra-v1"

    def on(self, graph: Graph, queries: DataFrame) -> DataFrame:
        return self.on_each([graph], queries.withColumn("at", F.lit(0))).drop("at")

    def on_each(self, graphs: list[Graph], queries: DataFrame) -> DataFrame:
        """(at, qid, distance, nodes, coords) of queries (at, qid, sources, targets), each on ``graphs[at]``, in one pass."""
        shared = queries.sparkSession.sparkContext.broadcast(graphs)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graphs = shared.value
            for batch in batches:
                groups, out = defaultdict(list), []
                for at, qid, sources, targets in zip(batch["at"].tolist(), batch.qid, batch.sources, batch.targets):
                    groups[at, tuple(sorted(map(int, sources)))].append((qid, [int(t) for t in targets]))
                for (at, sources), asked in groups.items():
                    if not sources or not all(t for _, t in asked):
                        raise ValueError("a query needs sources and targets")
                    found = graphs[at].search(list(sources), {t for _, own in asked for t in own})
                    out += [(at, qid, *graphs[at].path(*found, own)) for qid, own in asked]
                yield pd.DataFrame(out, columns=["at", "qid", "distance", "nodes", "coords"]).astype({"distance": "Int64"})

        return queries.select("at", "qid", "sources", "targets").mapInPandas(run, f"at int, {PATH}")

    def counts_on(self, graph: Graph, queries: DataFrame) -> DataFrame:
        """(qid, distance, ways): how many shortest paths each query has; 0 and no distance where nothing leads."""
        shared = queries.sparkSession.sparkContext.broadcast(graph)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph = shared.value
            for batch in batches:
                groups, out = defaultdict(list), []
                for qid, sources, targets in zip(batch.qid, batch.sources, batch.targets):
                    groups[tuple(sorted({int(s) for s in sources}))].append((qid, {int(t) for t in targets}))
                for sources, asked in groups.items():
                    distance, _ = graph.search(list(sources), {t for _, own in asked for t in own})
                    ways = graph.count(distance, list(sources))
                    for qid, own in asked:
                        far = min((distance[t] for t in own if t in distance), default=None)
                        out.append((qid, far, sum(ways[t] for t in own if distance.get(t, -1) == far) if far is not None else 0))
                yield pd.DataFrame(out, columns=["qid", "distance", "ways"]).astype({"distance": "Int64"})

        parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return queries.select("qid", "sources", "targets").repartition(parts, "sources").mapInPandas(run, "qid long, distance long, ways long")

    def shortest_paths(self, arcs: DataFrame, metric: DataFrame, queries: DataFrame) -> DataFrame:
        """(qid, distance, nodes, coords) of each query (qid, sources, targets) under ``metric`` (coord, w)."""
        spark = queries.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Queries with the same sources go to one batch, so that a search is run once; sources are many.
        return self.on(collect_graph(arcs, metric), queries.repartition(parts, "sources"))


def real_cost_paths(arcs: DataFrame, costs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, distance, nodes) of the distinct ``pairs`` (src, dst) under real costs that depend on the destination.

    ``costs`` (dst, coord, w double) has a cost for every arc and each destination that is asked for; a cost that lacks,
    is negative or isn't finite is an error. The arcs are broadcast, at most MAX_TRANSITIONS. A task holds one
    destination's costs and distinct sources, both bounded by the network. What can't be reached has nulls; ties go as in
    the other searches.
    """
    spark = pairs.sparkSession
    rows = arcs.select("coord", "prev", "next").limit(MAX_TRANSITIONS + 1).toPandas().sort_values("coord")
    if len(rows) > MAX_TRANSITIONS:
        raise ValueError("too many transitions")
    shared = spark.sparkContext.broadcast(tuple(rows[c].to_numpy(np.int64) for c in ("coord", "prev", "next")))

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked):
            coord, prev, next_ = shared.value
            w = own.drop_duplicates("coord").set_index("coord").w.reindex(coord).to_numpy(np.float64)
            if not (np.isfinite(w) & (w >= 0)).all():
                raise ValueError(f"destination {asked.dst.iloc[0]}: bad cost of coordinate {coord[~(np.isfinite(w) & (w >= 0))][0]}")
            graph = Graph(coord, prev, next_, w)
            for src, dst in zip(asked.src.tolist(), asked.dst.tolist()):
                far, nodes, _ = graph.path(*graph.search([src], {dst}), [dst])
                out.append((src, dst, far, nodes))
        return pd.DataFrame(out, columns=["src", "dst", "distance", "nodes"]).astype({"src": "int64", "dst": "int64", "distance": "float64"})

    asked = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    own = costs.select(F.col("dst").cast("long").alias("dst"), "coord", F.col("w").cast("double").alias("w"))
    return asked.groupBy("dst").cogroup(own.groupBy("dst")).applyInPandas(run, "src long, dst long, distance double, nodes array<long>")


def relational_distances(arcs: DataFrame, metric: DataFrame, sources: DataFrame, rounds: int = 100) -> DataFrame:
    """(source, node, distance) from each source by repeated joins and minima, until nothing changes; for small graphs."""
    w = arcs.join(metric, "coord").select("prev", "next", "w").persist()
    best = sources.select(F.col("source"), F.col("source").alias("node"), F.lit(0).cast("long").alias("distance"))
    before = None
    for _ in range(rounds):
        more = best.join(w, best.node == w.prev).select("source", F.col("next").alias("node"), (F.col("distance") + F.col("w")).alias("distance"))
        best = best.union(more).groupBy("source", "node").agg(F.min("distance").alias("distance"))
        best = best.checkpoint() if best.sparkSession.sparkContext.getCheckpointDir() else best.persist()
        now = tuple(best.agg(F.count("*"), F.sum("distance")).first())
        if now == before:
            return best
        before = now
    raise RuntimeError("distances did not settle")


def pair_key(a, b) -> Column:
    """One long for a pair of ids of up to 32 bits each: no two pairs share it."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def edge_queries(trips: DataFrame) -> DataFrame:
    """(qid, sources, targets) of the distinct pairs of first and last edge of trips."""
    e = F.col("edges")
    pairs = trips.select(F.element_at(e, 1).alias("s"), F.element_at(e, -1).alias("t")).distinct()
    return pairs.select(pair_key("s", "t").alias("qid"), F.array("s").alias("sources"), F.array("t").alias("targets"))


def validate_paths(paths: DataFrame, queries: DataFrame, arcs: DataFrame, metric: DataFrame) -> DataFrame:
    """(qid, valid): a path's size, ends, arcs and distance agree with its query, the graph and the metric."""
    rows = arcs.join(metric, "coord").select(F.col("coord").alias("c"), "prev", "next", "w")
    e = paths.select("qid", F.posexplode("coords").alias("pos", "c"), "nodes").join(rows, "c", "left")
    fits = (F.get("nodes", F.col("pos")) == F.col("prev")) & (F.get("nodes", F.col("pos") + 1) == F.col("next"))
    sums = e.groupBy("qid").agg(F.sum("w").alias("total"), F.bool_and(F.coalesce(fits, F.lit(False))).alias("legal"))
    own = queries.join(paths, "qid", "left").join(sums, "qid", "left")
    n = F.size("nodes")
    ok = (F.col("distance") < INFINITY) & (n == F.size("coords") + 1) & F.array_contains("sources", F.get("nodes", F.lit(0))) & F.array_contains("targets", F.get("nodes", n - 1)) & F.coalesce("legal", F.size("coords") == 0) & (F.coalesce("total", F.lit(0)) == F.col("distance"))
    return own.select("qid", F.coalesce(ok, F.lit(False)).alias("valid"))
