"""Validation of networks, trips, models and records. Checks are predicates; the first broken rule names the reason."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import INFINITY, MAX_ID
from .tables import kept

#: Networks of at most so many edges are broadcast; the trips of larger ones meet them in a join.
BROADCAST_EDGES = 200_000

#: Reasons, in the order in which they are looked for.
ACCEPTED, EMPTY, TOO_SHORT, OUT_OF_BOUNDS, DISCONTINUOUS, CYCLIC = "accepted", "empty", "too_short", "out_of_bounds", "discontinuous", "cyclic"


def finite(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def edge_ends(edges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tails and heads of the edges of a small network in id order: two longs for each edge."""
    found = edges.select("edge_id", "tail", "head").toPandas().sort_values("edge_id")
    return found["tail"].to_numpy(np.int64), found["head"].to_numpy(np.int64)


def first_fault(lists: pa.Array, tails: np.ndarray, heads: np.ndarray, min_edges: int, cycles: bool, split_empty: bool) -> pa.Array:
    """(reason, src, dst) of each list of edge ids, for a batch at once: all hops are compared as one array."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = pc.fill_null(lists.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    trip, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    outside = (ids < 0) | (ids >= len(tails))
    safe = np.where(outside, 0, ids)
    if not len(tails):
        tails = heads = np.zeros(1, np.int64)
    tail, head = tails[safe], heads[safe]

    def any_of(hops: np.ndarray) -> np.ndarray:
        return np.bincount(trip[hops], minlength=len(sizes)) > 0

    follows = np.flatnonzero(trip[1:] == trip[:-1]) + 1
    rules = [(sizes == 0, EMPTY if split_empty else TOO_SHORT), (sizes < min_edges, TOO_SHORT), (any_of(np.flatnonzero(outside)), OUT_OF_BOUNDS), (any_of(follows[head[follows - 1] != tail[follows]]), DISCONTINUOUS)]
    full = np.flatnonzero(sizes)
    first, last = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    first[full], last[full] = tail[starts[full]], head[starts[full] + sizes[full] - 1]
    if not cycles:
        owner, node = np.concatenate([trip, full]), np.concatenate([head, first[full]])
        order = np.lexsort((node, owner))
        owner, node = owner[order], node[order]
        again = owner[1:][(owner[1:] == owner[:-1]) & (node[1:] == node[:-1])]
        rules.append((np.bincount(again, minlength=len(sizes)) > 0, CYCLIC))
    reason = np.select([broken for broken, _ in rules], [name for _, name in rules], ACCEPTED)
    rejected = reason != ACCEPTED
    return pa.StructArray.from_arrays([pa.array(reason, pa.string()), pa.array(first, pa.int64(), mask=rejected), pa.array(last, pa.int64(), mask=rejected)], ["reason", "src", "dst"])


def classify(trips: DataFrame, edges: DataFrame, min_edges: int = 2, cycles: bool = False, split_empty: bool = True) -> DataFrame:
    """``trips`` with reason, src and dst.

    Rules in order: empty, fewer than ``min_edges``, an id outside the network, neighbours that don't meet, a node seen
    twice (unless ``cycles``). The ends of a network of at most BROADCAST_EDGES edges are broadcast once to each executor,
    so trips are neither shuffled nor widened by them; of a trip only its list goes through Arrow. Those of a larger one
    stay a table. Ids are dense from 0, as network validation makes sure.
    """
    if edges.count() > BROADCAST_EDGES:
        return _classify_by_join(trips, edges, min_edges, cycles, split_empty)
    ends = trips.sparkSession.sparkContext.broadcast(edge_ends(edges))

    @F.arrow_udf("reason string, src long, dst long")
    def fault(lists: pa.Array) -> pa.Array:
        return first_fault(lists, *ends.value, min_edges, cycles, split_empty)

    # not deterministic for Catalyst: a filter by the reason would otherwise run it a second time
    found = trips.withColumn("_fault", fault.asNondeterministic()("edges"))
    return found.withColumns({c: F.col(f"_fault.{c}") for c in ("reason", "src", "dst")}).drop("_fault")


def _classify_by_join(trips: DataFrame, edges: DataFrame, min_edges: int, cycles: bool, split_empty: bool) -> DataFrame:
    """The same by a join of hops and edges. Rows are numbered in a written table, as rows may be equal."""
    own = kept(trips.withColumn("_row", F.monotonically_increasing_id()))
    hops = own.select("_row", F.posexplode("edges").alias("_pos", "edge_id")).join(edges.select("edge_id", "tail", "head"), "edge_id", "left")
    hops = hops.groupBy("_row").agg(F.count("tail").alias("_known"), F.sort_array(F.collect_list(F.struct("_pos", "tail", "head"))).alias("_h"))
    t, h, n = F.col("_h.tail"), F.col("_h.head"), F.greatest(F.coalesce(F.size("edges"), F.lit(0)), F.lit(0))
    seen = F.concat(F.slice(t, 1, 1), h)
    reason = F.when(n == 0, EMPTY if split_empty else TOO_SHORT).when(n < min_edges, TOO_SHORT).when(F.col("_known") < n, OUT_OF_BOUNDS)
    reason = reason.when(F.slice(t, F.lit(2), n - 1) != F.slice(h, F.lit(1), n - 1), DISCONTINUOUS)
    if not cycles:
        reason = reason.when(F.size(F.array_distinct(seen)) < n + 1, CYCLIC)
    found = own.join(hops, "_row", "left").withColumn("reason", reason.otherwise(ACCEPTED))
    end = lambda x: F.when(F.col("reason") == ACCEPTED, x)
    return found.withColumns({"src": end(F.get(t, F.lit(0))), "dst": end(F.get(h, n - 1))}).select(*trips.columns, "reason", "src", "dst")


def accepted(trips: DataFrame, edges: DataFrame, min_edges: int = 2) -> DataFrame:
    return classify(trips, edges, min_edges).where(F.col("reason") == ACCEPTED).drop("reason")


def report(classified: DataFrame) -> DataFrame:
    """Rows of each reason; they add up to the rows that were classified."""
    return classified.groupBy("reason").agg(F.count("*").alias("n"))


def scaled_baseline(length: Column) -> Column:
    """Length in thousandths, at least 1; an error unless it stays below the routing limit."""
    scaled = F.greatest(F.round(length * 1000), F.lit(1.0))
    ok = finite(length) & (length > 0) & (scaled < INFINITY)
    return F.when(ok, scaled).otherwise(F.raise_error(F.concat(F.lit("bad length: "), F.coalesce(length.cast("string"), F.lit("null")))).cast("double"))


def quantized(weight: Column, zero_is_one: bool = False) -> Column:
    """A weight as a positive integer below the routing limit; an error if it isn't positive and finite."""
    q = F.greatest(F.round(weight), F.lit(1.0))
    least = weight >= 0 if zero_is_one else weight > 0
    return F.when(finite(weight) & least & (q < INFINITY), q.cast("long")).otherwise(F.raise_error(F.concat(F.lit("bad weight: "), F.coalesce(weight.cast("string"), F.lit("null")))).cast("long"))


def bounds(w0: Column, lower: float, upper: float) -> tuple[Column, Column]:
    """The bounds of a weight; the upper one must stay below the routing limit when it is quantised."""
    if not 0 < lower <= 1 <= upper or lower == float("inf") or upper == float("inf"):
        raise ValueError("factors must satisfy 0 < lower <= 1 <= upper")
    hi = w0 * upper
    return w0 * lower, F.when(F.greatest(F.round(hi), F.lit(1.0)) < INFINITY, hi).otherwise(F.raise_error(F.concat(F.lit("bound reaches the limit: "), hi.cast("string"))).cast("double"))


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, duplicate): each repeated key with the order of its first row and of the repeat."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.select(key, F.min(order).over(w).alias("first"), F.col(order).alias("duplicate"), F.row_number().over(w).alias("_n")).where("_n > 1").drop("_n")


def check_ids(edges: DataFrame, ids: str = "fid", order: str = "ord") -> None:
    """Edge ids must be unique and equal to the record's place; repeats are told first."""
    twice = duplicates(edges, ids, order).orderBy("duplicate").first()
    if twice:
        raise ValueError(f"duplicate {ids} {twice[ids]} at {twice['first']} and {twice['duplicate']}")
    off = edges.where(F.col(ids) != F.col(order)).orderBy(order).first()
    if off:
        raise ValueError(f"{ids} {off[ids]} at record {off[order]}")


def check_network(nodes: DataFrame, edges: DataFrame) -> None:
    """A network has nodes and edges with dense ids, finite places, ends that exist and positive finite baselines."""
    n, low, high, kinds = nodes.agg(F.count("*"), F.min("node_id"), F.max("node_id"), F.count_distinct("node_id")).first()
    if not n:
        raise ValueError("no nodes")
    m, elow, ehigh, ekinds = edges.agg(F.count("*"), F.min("edge_id"), F.max("edge_id"), F.count_distinct("edge_id")).first()
    if not m:
        raise ValueError("no edges")
    if (low, high, kinds) != (0, n - 1, n) or (elow, ehigh, ekinds) != (0, m - 1, m):
        raise ValueError("ids must be dense from 0")
    bad = nodes.where(~finite("x") | ~finite("y") | F.col("x").isNull() | F.col("y").isNull()).agg(F.min("node_id")).first()[0]
    if bad is not None:
        raise ValueError(f"node {bad}: bad coordinate")
    end = F.when(~F.col("tail").between(0, n - 1), "tail").when(~F.col("head").between(0, n - 1), "head").when(~finite("baseline") | (F.col("baseline") <= 0) | F.col("baseline").isNull(), "baseline")
    bad = edges.select("edge_id", end.alias("what")).where("what is not null").orderBy("edge_id").first()
    if bad:
        raise ValueError(f"edge {bad['edge_id']}: bad {bad['what']}")


def model_faults(model: DataFrame) -> DataFrame:
    """Rows of a model (coord, prev, next, weight) that break its order or whose weight isn't positive and finite."""
    before = F.lag(F.struct("prev", "next")).over(Window.orderBy("coord"))
    return model.withColumn("_b", before).where((F.col("_b") >= F.struct("prev", "next")) | ~finite("weight") | (F.col("weight") <= 0)).drop("_b")


def record_faults(records: DataFrame, edges: str, min_edges: int, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, fault) of records with a blank or repeated id, control characters, too few edges or ids out of range."""
    i, e = F.col(sample_id), F.col(edges)
    n = F.count("*").over(Window.partitionBy(sample_id))
    fault = F.when(i.isNull() | (F.trim(i) == ""), "blank_id").when(i.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control_character").when(F.coalesce(F.size(e), F.lit(-1)) < min_edges, "too_few_edges").when(F.exists(e, lambda x: x.isNull() | (x < 0) | (x > MAX_ID)), "edge_out_of_range").when(n > 1, "duplicate_id")
    return records.select(i.alias(sample_id), fault.alias("fault")).where("fault is not null")


def endpoint_faults(queries: DataFrame, nodes: int) -> DataFrame:
    """(qid, fault) of queries whose ``sources`` and ``targets``, arrays of (node, offset), can't be routed."""
    both = F.concat("sources", "targets")
    empty = F.coalesce((F.size("sources") < 1) | (F.size("targets") < 1), F.lit(True))
    outside = F.exists(both, lambda x: F.coalesce((x["node"] < 0) | (x["node"] >= nodes), F.lit(True)))
    moved = F.exists(both, lambda x: F.coalesce(x["offset"] != 0, F.lit(True)))
    fault = F.when(empty, "empty").when(outside, "out_of_range").when(moved, "nonzero_offset")
    return queries.select("qid", fault.alias("fault")).where("fault is not null")


def artifact_faults(arcs: DataFrame, artifact: DataFrame) -> DataFrame:
    """(coord, fault) where an artifact (coord, prev, next, initial) differs from the rebuilt line graph (coord, prev, next, w0).

    Baselines must be the same number; one that isn't a number differs from all others.
    """
    g = arcs.select("coord", F.struct("prev", "next").alias("g"), F.col("w0").cast("double").alias("w0"))
    a = artifact.select("coord", F.struct("prev", "next").alias("a"), F.col("initial").cast("double").alias("initial"))
    fault = F.when(F.col("g").isNull(), "unknown").when(F.col("a").isNull(), "missing").when(F.col("g") != F.col("a"), "transition").when(~F.col("w0").eqNullSafe(F.col("initial")), "baseline")
    return g.join(a, "coord", "full").select("coord", fault.alias("fault")).where("fault is not null")
