"""Line graphs: nodes are edges of the road network, arcs are the legal transitions between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MAX_TRANSITIONS
from .tables import apart
from .validate import bounds, quantized

#: Tables with a row for each edge or transition are broadcast below this; larger ones are shuffled.
SMALL_ROWS = 1_000_000
#: Transitions are ordered in blocks of 2^BLOCK_BITS edges.
BLOCK_BITS = 10


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its number of rows, which the caller knows, is small, else for a shuffle."""
    return F.broadcast(df) if rows <= SMALL_ROWS else apart(df)


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (fid, u, v, length) with node ids for the outer ids ``u`` and ``v``; a missing one is an error, tails first."""
    tail = nodes.select(F.col("osmid").alias("u"), F.col("node_id").alias("tail"))
    head = nodes.select(F.col("osmid").alias("v"), F.col("node_id").alias("head"))
    found = edges.join(tail, "u", "left").join(head, "v", "left")
    miss = lambda side, at: F.raise_error(F.concat(F.lit("edge "), "fid", F.lit(f": no {side} node "), at)).cast("long")
    return found.select(F.col("fid").alias("edge_id"), F.coalesce("tail", miss("tail", F.col("u"))).alias("tail"), F.coalesce("head", miss("head", F.col("v"))).alias("head"), "length")


def transitions(edges: DataFrame, lower: float = 0.5, upper: float = 2.0) -> DataFrame:
    """(coord, prev, next, w0, lo, hi): every edge followed by every edge that leaves its head, U-turns and parallels too.

    A transition costs the baseline of the edge it enters. Coordinates are places in (prev, next) order: a transition's
    place within its block of edges, after the sizes of the blocks before, so that no task orders all.
    """
    block = F.shiftright("prev", BLOCK_BITS).alias("_block")
    out = apart(edges.select(F.col("edge_id").alias("next"), F.col("tail").alias("via"), F.col("baseline").alias("w0")))
    pairs = edges.select(F.col("edge_id").alias("prev"), F.col("head").alias("via")).join(out, "via")
    lo, hi = bounds(F.col("w0"), lower, upper)
    ways = out.groupBy("via").agg(F.count("*").alias("_n"))
    sizes = edges.select(F.col("edge_id").alias("prev"), F.col("head").alias("via")).join(ways, "via").groupBy(block).agg(F.sum("_n").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))  # a row for each block
    coord = F.row_number().over(Window.partitionBy("_block").orderBy("prev", "next")) - 1 + F.col("_before")
    rows = pairs.select(block, "prev", "next", "w0", lo.alias("lo"), hi.alias("hi")).join(F.broadcast(before), "_block")
    return apart(rows.select(coord.cast("long").alias("coord"), "prev", "next", "w0", "lo", "hi"))


def check_transitions(arcs: DataFrame) -> int:
    """The number of transitions; none, or too many for one model, is an error."""
    n = arcs.count()
    if not 1 <= n <= MAX_TRANSITIONS:
        raise ValueError(f"{n} transitions")
    return n


def midpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, x, y): midpoints in single precision."""
    a = nodes.select(F.col("node_id").alias("tail"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("head"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    half = F.lit(0.5).cast("float")
    return edges.join(a, "tail").join(b, "head").select("edge_id", (half * F.col("x1") + half * F.col("x2")).cast("float").alias("x"), (half * F.col("y1") + half * F.col("y2")).cast("float").alias("y"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, outgoing, incoming): sorted edge ids of every node that has any."""
    out = edges.groupBy(F.col("tail").alias("node_id")).agg(F.array_sort(F.collect_list("edge_id")).alias("outgoing"))
    into = edges.groupBy(F.col("head").alias("node_id")).agg(F.array_sort(F.collect_list("edge_id")).alias("incoming"))
    none = F.array().cast("array<long>")
    return out.join(into, "node_id", "full").select("node_id", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"))


def steps(trips: DataFrame, arcs: DataFrame, rows: int = 0) -> DataFrame:
    """(sample_id, pos, prev, next, coord): the transitions of each trip; one that doesn't exist has a null coord.

    Pairs are made inside the row. With ``rows``, the number of transitions, a small table of them is broadcast and
    trips stay where they are.
    """
    e = F.col("edges")
    pairs = F.zip_with(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("prev"), b.alias("next")))
    long = trips.select("sample_id", F.posexplode(pairs).alias("pos", "s")).select("sample_id", "pos", "s.prev", "s.next")
    return long.join(small(arcs.select("prev", "next", "coord"), rows or SMALL_ROWS + 1), ["prev", "next"], "left")


def coordinates(trips: DataFrame, arcs: DataFrame, rows: int = 0) -> DataFrame:
    """(sample_id, coords) in trip order; a transition that doesn't exist is an error."""
    at = F.coalesce("coord", F.raise_error(F.concat(F.lit("no transition "), "prev", F.lit(" to "), "next")).cast("long"))
    own = steps(trips, arcs, rows).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", at.alias("c")))).alias("s"))
    return own.select("sample_id", F.col("s.c").alias("coords"))


def decode(coords: DataFrame, arcs: DataFrame, rows: int = 0) -> DataFrame:
    """(sample_id, edges, connected) of coordinate lists."""
    long = coords.select("sample_id", F.posexplode("coords").alias("pos", "coord")).join(small(arcs.select("coord", "prev", "next"), rows or SMALL_ROWS + 1), "coord")
    own = long.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "prev", "next"))).alias("s"))
    n = F.size("s")
    meets = F.forall(F.zip_with(F.slice("s", F.lit(1), n - 1), F.slice("s", F.lit(2), n - 1), lambda a, b: a["next"] == b["prev"]), lambda x: x)
    return own.select("sample_id", F.concat(F.array(F.col("s")[0]["prev"]), F.col("s.next")).alias("edges"), meets.alias("connected"))


def endpoints(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups (src, dst, n) with the edges that leave ``src`` as sources and those that enter ``dst`` as targets.

    A side without edges is an error.
    """
    near = adjacency(edges)
    out = groups.join(near.select(F.col("node_id").alias("src"), F.col("outgoing").alias("sources")), "src", "left").join(near.select(F.col("node_id").alias("dst"), F.col("incoming").alias("targets")), "dst", "left")
    need = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"no {c}")).cast("array<long>"))
    return out.select("src", "dst", "n", need("sources").alias("sources"), need("targets").alias("targets"))


def canonical_parallel(edges: DataFrame) -> DataFrame:
    """(edge_id, canonical): the last edge between the same ends stands for all of them."""
    return edges.select("edge_id", F.max("edge_id").over(Window.partitionBy("tail", "head")).alias("canonical"))


def parallel_minimum(edges: DataFrame, weight: str = "baseline") -> DataFrame:
    """(head, tail, weight): the least weight of parallel edges, reversed."""
    return edges.groupBy("head", "tail").agg(F.min(weight).alias("weight"))


def quantized_bounds(arcs: DataFrame) -> DataFrame:
    """Weights and bounds of transitions as the integers that a search uses."""
    return arcs.select("coord", "w0", "lo", "hi", quantized(F.col("w0")).alias("q0"), quantized(F.col("lo")).alias("qlo"), quantized(F.col("hi")).alias("qhi"))
