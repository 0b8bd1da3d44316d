"""Route predictors: least length, Markov costs, learned weights, association planners, rollouts, walks, anchor distances."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, stats
from .paths import DijkstraOracle, Graph, collect_graphs, edge_queries, pair_key
from .tables import apart, drop, kept
from .validate import quantized

ROUTES = "sample_id string, edges array<long>"


def predict(trips: DataFrame, arcs: DataFrame, metric: DataFrame, oracle=None) -> DataFrame:
    """(sample_id, edges) from each trip's first to its last edge under ``metric`` (coord, w)."""
    paths = (oracle or DijkstraOracle()).shortest_paths(arcs, metric, edge_queries(trips))
    e = F.col("edges")
    own = trips.select("sample_id", pair_key(F.element_at(e, 1), F.element_at(e, -1)).alias("qid"))
    return own.join(paths, "qid").select("sample_id", F.col("nodes").alias("edges"), "distance")


def length_metric(arcs: DataFrame) -> DataFrame:
    return arcs.select("coord", quantized(F.col("w0")).alias("w"))


def markov_metric(arcs: DataFrame, counts: DataFrame, alpha: float) -> DataFrame:
    return stats.markov_costs(arcs, counts, alpha).select("coord", F.col("cost").alias("w"))


def model_metric(model: DataFrame) -> DataFrame:
    return model.select("coord", quantized(F.col("weight")).alias("w"))


def select_alpha(validation: DataFrame, arcs: DataFrame, counts: DataFrame, alphas: list[float]) -> tuple[float, list[dict]]:
    """The smoothing with the best F1, then exact match, then the smaller one, on validation trips.

    The trips and the counts are read once; all smoothings are searched in one pass over the trips' ends.
    """
    counts, own = kept(counts), kept(validation.select("sample_id", "edges"))
    graphs = collect_graphs(arcs, [markov_metric(arcs, counts, a) for a in alphas])
    each = F.explode(F.array(*(F.lit(i) for i in range(len(alphas))))).alias("at")
    asked = edge_queries(own).select(each, "*")
    found = DijkstraOracle().on_each(graphs, asked.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at", "sources"))
    e = F.col("edges")
    truth = own.select(each, "sample_id", "edges", pair_key(F.element_at(e, 1), F.element_at(e, -1)).alias("qid"))
    rows = truth.join(found, ["at", "qid"]).select("at", F.col("edges").alias("truth"), F.col("nodes").alias("predicted"))
    best = evaluate.route_metrics(rows).groupBy("at").agg(F.avg("edge_f1").alias("edge_f1"), F.avg("exact_match").alias("exact_match")).collect()
    tried = [{"alpha": alphas[r["at"]], "edge_f1": r["edge_f1"], "exact_match": r["exact_match"]} for r in sorted(best)]
    return min(tried, key=lambda t: (-t["edge_f1"], -t["exact_match"], t["alpha"]))["alpha"], tried


class Planner:
    """Greedy walks to a destination by association counts: the next edge is the one most often followed by it."""

    def __init__(self, out: dict[int, list[int]], counts: dict[tuple[int, int], int], popularity: dict[int, float] | None = None, heading: dict[int, tuple[float, float]] | None = None, cap: int = 300):
        self.out, self.counts, self.popularity, self.heading, self.cap = out, counts, popularity, heading or {}, cap

    def cosine(self, a: int, b: int, destination: int) -> float:
        """Of the way to ``b`` and that to the destination, by edge midpoints; 1 where either has no length."""
        if not {a, b, destination} <= self.heading.keys():
            return 1.0
        x, y, z = self.heading[a], self.heading[b], self.heading[destination]
        u, v = (y[0] - x[0], y[1] - x[1]), (z[0] - x[0], z[1] - x[1])
        n = math.hypot(*u) * math.hypot(*v)
        return (u[0] * v[0] + u[1] * v[1]) / n if n else 1.0

    def leg(self, start: int, destination: int) -> list[int]:
        """A walk of at most ``cap`` edges; an edge is used again only if all ways on are used."""
        route, used = [start], {start}
        while route[-1] != destination and len(route) < self.cap:
            ways = self.out.get(route[-1], [])
            if not ways:
                break
            if destination in ways:
                route.append(destination)
                break
            most, best = -1, ways  # an edge again: neither counts nor popularity choose
            if fresh := [w for w in ways if w not in used]:
                most = max(self.counts.get((w, destination), 0) for w in fresh)
                best = [w for w in fresh if self.counts.get((w, destination), 0) == most]
            if len(best) > 1 and self.popularity is not None:
                if most >= 1:
                    top = max(self.popularity.get(w, 0.0) for w in best)
                    best = [w for w in best if self.popularity.get(w, 0.0) == top]
                best = [min(best, key=lambda w: (-self.cosine(route[-1], w, destination), w))]
            route.append(min(best))
            used.add(route[-1])
        return route

    def via(self, start: int, key: int, destination: int) -> list[int]:
        """Through ``key``; the first leg alone if it doesn't arrive."""
        first = self.leg(start, key)
        return first if first[-1] != key else first + self.leg(key, destination)[1:]


def plan(queries: DataFrame, arcs: DataFrame, da: DataFrame, popularity: DataFrame | None = None, places: DataFrame | None = None, cap: int = 300) -> DataFrame:
    """(sample_id, edges) of queries (sample_id, src, dst[, key]).

    Queries meet the counts that lead to their destination in a co-group by destination, so no task holds all counts;
    the network, bounded by MAX_TRANSITIONS, is broadcast.
    """
    spark = queries.sparkSession
    near = defaultdict(list)
    for r in arcs.select("prev", "next").orderBy("prev", "next").toLocalIterator():
        near[r[0]].append(r[1])
    pop = {r[0]: r[1] for r in popularity.toLocalIterator()} if popularity is not None else None
    at = {r[0]: (r[1], r[2]) for r in places.toLocalIterator()} if places is not None else None
    shared = spark.sparkContext.broadcast((dict(near), pop, at))
    keyed = queries if "key" in queries.columns else queries.withColumn("key", F.lit(None).cast("long"))
    # Salted, so that a destination of very many queries is shared out; its counts go to each share.
    keyed = keyed.select("sample_id", "src", "dst", "key", F.pmod(F.xxhash64("sample_id"), F.lit(8)).cast("int").alias("salt"))
    legs = da.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    wanted = keyed.select("dst", "salt", F.explode(F.array_distinct(F.array_compact(F.array("dst", "key")))).alias("b")).distinct()
    counts = legs.join(wanted, "b").select("a", "b", "n", F.col("dst").alias("to"), F.col("salt").alias("part"))

    def run(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out, pop, at = shared.value
        planner = Planner(out, {(a, b): n for a, b, n in zip(counts.a, counts.b, counts.n)}, pop, at, cap)
        routes = [planner.leg(s, d) if pd.isna(k) else planner.via(s, int(k), d) for s, d, k in zip(asked.src, asked.dst, asked.key)]
        return pd.DataFrame({"sample_id": asked.sample_id, "edges": routes})

    return keyed.groupBy("dst", "salt").cogroup(counts.groupBy("to", "part")).applyInPandas(run, ROUTES)


def walked(keys: np.ndarray, first: np.ndarray, ways: np.ndarray, scorer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], src: np.ndarray, dst: np.ndarray, cap: int, revisit: bool) -> pa.ListArray:
    """The walk of each pair, all of them a step at a time; from ``keys[k]`` lead ``ways[first[k] : first[k + 1]]``, ascending."""
    steps, sizes = np.empty((max(1, cap), len(src)), np.int64), np.ones(len(src), np.int64)
    steps[0] = src
    going = np.arange(len(src) if len(keys) else 0)
    for n in range(1, cap):
        at = steps[n - 1, going]
        place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        on = (at != dst[going]) & (keys[place] == at)
        going, at, place = going[on], at[on], place[on]
        if not len(going):
            break
        count = first[place + 1] - first[place]
        start = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(going)), count)
        w = ways[np.arange(len(owner)) + (first[place] - start)[owner]]
        score = scorer(at[owner], w, dst[going][owner])
        most = np.fmax.reduceat(score, start)[owner]
        top = np.flatnonzero((score == most) | np.isnan(most))
        taken = w[top[np.append(True, np.diff(owner[top]) > 0)]]  # the smallest of the best
        if not revisit:
            new = ~(steps[:n, going] == taken).any(axis=0)
            going, taken = going[new], taken[new]
        steps[n, going] = taken
        sizes[going] += 1
    flat = steps[: sizes.max(initial=1)].T
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat[np.arange(flat.shape[1]) < sizes[:, None]]))


def rollout(queries: DataFrame, arcs: DataFrame, scorer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], cap: int = 300, revisit: bool = False) -> DataFrame:
    """(sample_id, edges) by always taking the transition with the best score, ties to the smaller edge.

    ``scorer(at, candidate, destination)`` gives scores for arrays, each from its own three edges alone. A walk ends at
    its destination, at a dead end, after ``cap`` edges, or, unless ``revisit``, before it would see an edge again.
    Queries of an Arrow batch with the same ends share a walk.
    """
    rows = arcs.select("prev", "next").toPandas()
    prev, ways = rows.prev.to_numpy(np.int64), rows.next.to_numpy(np.int64)
    order = np.lexsort((ways, prev))
    keys, first = np.unique(prev[order], return_index=True)
    shared = queries.sparkSession.sparkContext.broadcast((keys, np.append(first, len(prev)), ways[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(1).null_count or batch.column(2).null_count:
                raise ValueError("a query needs src and dst")
            (a, i), (b, j) = (np.unique(batch.column(c).to_numpy(), return_inverse=True) for c in (1, 2))
            pairs, own = np.unique(i * len(b) + j, return_inverse=True)
            # walks of a batch are made in slices, so that long ones take no more memory than short ones
            size, parts = max(256, (1 << 22) // max(1, cap)), []
            for k in range(0, len(pairs), size):
                some = pairs[k : k + size]
                parts.append(walked(*shared.value, scorer, a[some // len(b)], b[some % len(b)], cap, revisit))
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays(parts).take(pa.array(own))], names=["sample_id", "edges"])

    return queries.select(F.col("sample_id").cast("string"), F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(run, ROUTES)


def rollout_by_joins(queries: DataFrame, arcs: DataFrame, features: DataFrame, scorer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], cap: int = 300, revisit: bool = False) -> DataFrame:
    """The walks of ``rollout`` with a scorer of rows of ``features`` (node, x array<double>) in place of edges.

    All walks take a step together by a join with the ways on from their last edges, so neither the driver nor a task
    holds the network or its features. Edges that the same ways lead on from share a row of ways, and a way tells the row
    that goes on from it. Queries with the same ends share a walk. An edge or an end without features is an error.
    """
    x = F.coalesce("x", F.raise_error(F.lit("an edge without features")).cast("array<double>"))
    rows = kept(features.select(F.col("node").cast("long").alias("node"), F.col("x").cast("array<double>").alias("x")))
    on = kept(arcs.groupBy(F.col("prev").cast("long").alias("prev")).agg(F.sort_array(F.collect_list(F.col("next").cast("long"))).alias("ways")))
    lists = on.groupBy("ways").agg(F.min("prev").alias("hub"))
    hub_of = kept(on.join(apart(lists), "ways").select("prev", "hub"))
    each = on.join(apart(hub_of.where("prev = hub")), "prev").select(F.col("hub").alias("_hub"), F.explode("ways").alias("way"))
    each = each.join(apart(rows.withColumnRenamed("node", "way")), "way", "left").join(apart(hub_of.withColumnRenamed("prev", "way")), "way", "left")
    hubs = kept(each.groupBy(F.col("_hub").alias("hub")).agg(F.sort_array(F.collect_list(F.struct("way", "hub", x.alias("x")))).alias("ways")))

    given = lambda c: F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit("a query needs src and dst")).cast("long")).alias(c)
    asked = kept(queries.select(F.col("sample_id").cast("string").alias("sample_id"), given("src"), given("dst")))
    now = asked.select("src", "dst").distinct()
    for end in ("src", "dst"):
        now = now.join(apart(rows.withColumnRenamed("node", end)), end, "left").withColumn(f"{end}_x", x).drop("x")
    now = now.join(apart(hub_of.withColumnRenamed("prev", "src")), "src", "left")
    goes = (F.col("src") != F.col("dst")) & F.col("hub").isNotNull() & F.lit(cap > 1)
    now = kept(now.select("src", "dst", "hub", F.col("src_x").alias("at_x"), "dst_x", F.array("src").alias("edges"), goes.alias("going")))
    numbers = lambda column: column.flatten().to_numpy(zero_copy_only=False)

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ways, routes, dst = batch.column("ways"), batch.column("edges"), batch.column("dst").to_numpy()
            count, flat = pc.list_value_length(ways).to_numpy(), ways.flatten()
            way, beyond = (pc.struct_field(flat, c) for c in ("way", "hub"))
            own, way = np.repeat(np.arange(n), count), way.to_numpy()
            of_way = numbers(pc.struct_field(flat, "x")).reshape(len(way), -1)
            score = scorer(numbers(batch.column("at_x")).reshape(n, -1)[own], of_way, numbers(batch.column("dst_x")).reshape(n, -1)[own])
            most = np.fmax.reduceat(score, np.cumsum(count) - count)[own]
            top = np.flatnonzero((score == most) | np.isnan(most))
            best = top[np.append(True, np.diff(own[top]) > 0)]  # the smallest of the best
            taken, hub = way[best], beyond.take(pa.array(best))
            sizes, route = pc.list_value_length(routes).to_numpy(), numbers(routes)
            walk = np.repeat(np.arange(n), sizes)
            grows = revisit | (np.bincount(walk[route == taken[walk]], minlength=n) == 0)
            longer = np.insert(route, np.cumsum(sizes)[grows], taken[grows]).astype(np.int64)
            sizes = sizes + grows
            going = grows & (taken != dst) & hub.is_valid().to_numpy(zero_copy_only=False) & (sizes < cap)
            at_x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * of_way.shape[1], pa.int32()), pa.array(of_way[best].reshape(-1)))
            edges = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(longer))
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), hub, at_x, batch.column("dst_x"), edges, pa.array(going)], names=now_names)

    now_names, done = now.columns, []
    while True:
        done.append(kept(now.where("not going").select("src", "dst", "edges")))
        on_way = now.where("going")
        if on_way.isEmpty():
            break
        then = kept(on_way.join(apart(hubs), "hub").select("src", "dst", "at_x", "dst_x", "edges", "ways").mapInArrow(stepped, now.schema))
        drop(now)
        now = then
    drop(now)
    found = done[0]
    for some in done[1:]:
        found = found.union(some)
    return asked.join(apart(found), ["src", "dst"]).select("sample_id", "edges")


def shorten(routes: DataFrame, distances: str) -> DataFrame:
    """Routes cut after the first place where ``distances`` (array by place) is least."""
    return routes.withColumn("edges", F.slice("edges", F.lit(1), F.array_position(distances, F.array_min(distances)).cast("int")))


def walks(starts: DataFrame, arcs: DataFrame, length: int, per_start: int, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """(walk, edges): second-order random walks from each (edge); a walk has its own seed, so partitioning doesn't matter.

    All walks take a step together by a join with the ways on from their last edges, so no task holds the network; a
    walk carries the ways on from the edge before. It draws one number for each step.
    """
    if length < 2:
        return starts.select("edge", F.explode(F.sequence(F.lit(0), F.lit(per_start - 1))).alias("_i")).select(F.concat_ws(":", "edge", "_i").alias("walk"), F.array(F.col("edge").cast("long")).alias("edges"))
    near = kept(arcs.groupBy(F.col("prev").cast("long").alias("_at")).agg(F.sort_array(F.collect_list(F.col("next").cast("long"))).alias("_ways")))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            draws = [np.random.default_rng([seed, e, i]).random(length - 1) for e, i in zip(batch.edge.tolist(), batch.ordinal.tolist())]
            yield pd.DataFrame({"walk": batch.edge.astype(str) + ":" + batch.ordinal.astype(str), "_at": batch.edge, "edges": [[e] for e in batch.edge.tolist()], "_u": draws})

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The row of each value of a list column, and the values; a null list has none."""
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walk, last, routes, draws, beside, ways = (batch.column(c) for c in ("walk", "_at", "edges", "_u", "_before", "_ways"))
            n, (owner, w), (known_owner, known) = batch.num_rows, flat(ways), flat(beside)
            sizes, count = np.bincount(owner, minlength=n), pc.list_value_length(routes).to_numpy(zero_copy_only=False)
            own, route = flat(routes)
            starts_at = np.cumsum(count) - count
            former = route[starts_at + np.maximum(count - 2, 0)]
            values, code = np.unique(np.concatenate((w, known)), return_inverse=True)
            shared = np.isin(owner * len(values) + code[: len(w)], known_owner * len(values) + code[len(w) :])
            later = count[owner] > 1
            weight = np.where(later & (w == former[owner]), 1 / p, np.where(~later | shared, 1.0, 1 / q))
            table = np.zeros((n, max(1, sizes.max(initial=1))))
            first = np.cumsum(sizes) - sizes
            table[owner, np.arange(len(w)) - first[owner]] = weight
            on = np.flatnonzero(sizes)
            upto = (table[on] / table[on].sum(axis=1, keepdims=True)).cumsum(axis=1)
            u = draws.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[on, count[on] - 1]
            taken = np.minimum((upto / upto[:, -1:] <= u[:, None]).sum(axis=1), sizes[on] - 1)  # as numpy's choice does
            chosen = w[first[on] + taken].astype(np.int64)
            at = np.zeros(n, np.int64)
            at[on] = chosen
            ends = np.insert(route, (starts_at + count)[on], chosen).astype(np.int64)
            longer = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count + (sizes > 0))), pa.int32()), pa.array(ends))
            yield pa.RecordBatch.from_arrays([walk, pa.array(at, mask=sizes == 0), longer, draws, ways], names=["walk", "_at", "edges", "_u", "_before"])

    own = starts.select(F.col("edge").cast("long").alias("edge"), F.explode(F.sequence(F.lit(0), F.lit(per_start - 1))).alias("ordinal"))
    now = own.mapInPandas(drawn, "walk string, _at long, edges array<long>, _u array<double>").withColumn("_before", F.lit(None).cast("array<long>"))
    for _ in range(length - 1):
        met = now.join(near, "_at", "left").select("walk", "_at", "edges", "_u", "_before", "_ways")
        then = kept(met.mapInArrow(stepped, "walk string, _at long, edges array<long>, _u array<double>, _before array<long>"))
        drop(now)
        now = then
    return now.select("walk", "edges")


def haversine(lat1, lon1, lat2, lon2):
    """Kilometres between places in degrees, as a column."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def anchor_features(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, anchor, value) from (source, node, distance): 1 / (d + 1), 0 where unreached, as z-scores of each anchor.

    Deviations are of the population; an anchor without variance is an error.
    """
    grid = nodes.select("node").crossJoin(F.broadcast(distances.select(F.col("source").alias("anchor")).distinct()))
    near = grid.join(apart(distances.select(F.col("source").alias("anchor"), "node", "distance")), ["anchor", "node"], "left")
    near = near.withColumn("v", F.coalesce(1.0 / (F.col("distance") + 1.0), F.lit(0.0)))
    sums = near.groupBy("anchor").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    s = F.when(F.col("s") > 0, F.col("s")).otherwise(F.raise_error(F.lit("an anchor has no variance")).cast("double"))
    return near.join(F.broadcast(sums), "anchor").select("node", "anchor", ((F.col("v") - F.col("m")) / s).alias("value"))


def reverse_next_hops(arcs: DataFrame, metric: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst, edges, distance): paths of groups (dst, sources) by one search from each destination on reversed arcs."""
    rows = arcs.join(metric, "coord").select("coord", "prev", "next", "w").toPandas()
    graph = Graph(rows.coord.to_numpy(np.int64), rows.next.to_numpy(np.int64), rows.prev.to_numpy(np.int64), rows.w.to_numpy(np.int64))
    shared = groups.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for dst, sources in zip(batch.dst, batch.sources):
                found = shared.value.search([int(dst)], {int(s) for s in sources})
                for s in sources:
                    far, nodes, _ = shared.value.path(*found, [int(s)])
                    out.append((int(s), int(dst), nodes[::-1] if nodes else None, far))
            yield pd.DataFrame(out, columns=["src", "dst", "edges", "distance"]).astype({"distance": "Int64"})

    return groups.select("dst", "sources").mapInPandas(run, "src long, dst long, edges array<long>, distance long")
