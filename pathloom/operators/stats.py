"""Counts over trips: transitions, origins and destinations, Markov costs, associations, candidates, skip-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import small, steps


def observed_counts(trips: DataFrame, arcs: DataFrame, rows: int = 0) -> DataFrame:
    """(coord, n) of every transition, zeros too. Trips are reduced to counts before anything is shuffled."""
    counts = steps(trips, arcs, rows).groupBy("coord").agg(F.count("*").alias("n"))
    return arcs.select("coord").join(counts, "coord", "left").select("coord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def od_groups(trips: DataFrame) -> DataFrame:
    """(src, dst, n): trips by the nodes where they start and end."""
    return trips.groupBy("src", "dst").agg(F.count("*").alias("n"))


def markov_costs(arcs: DataFrame, counts: DataFrame, alpha: float) -> DataFrame:
    """(coord, prev, next, cost): smoothed negative log probabilities of the next edge, in hundred-thousandths, at least 1."""
    own = arcs.select("coord", "prev", "next").join(counts, "coord")
    w = Window.partitionBy("prev")
    p = (F.col("n") + F.lit(alpha)) / (F.sum("n").over(w) + F.lit(alpha) * F.count("*").over(w))
    return own.select("coord", "prev", "next", F.greatest(F.round(-F.log(p) * 100000), F.lit(1.0)).cast("long").alias("cost"))


def popularity(trips: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, n, normalised): uses of every edge, and these between 0 and 1 by minimum and maximum; all 0 if equal."""
    counts = trips.select(F.explode("edges").alias("edge_id")).groupBy("edge_id").agg(F.count("*").alias("n"))
    own = edges.select("edge_id").join(counts, "edge_id", "left").select("edge_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    ends = own.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("n") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return own.crossJoin(F.broadcast(ends)).select("edge_id", "n", norm.alias("normalised"))


def associations(trips: DataFrame) -> DataFrame:
    """(src, dst, n): ordered pairs of edges of a trip, the first before the second, each time they occur.

    Pairs are made inside the row and counted before the shuffle.
    """
    e = F.col("edges")
    pairs = F.flatten(F.transform(e, lambda a, i: F.transform(F.slice(e, i + 2, F.size(e)), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return trips.select(F.explode(pairs).alias("p")).groupBy("p.src", "p.dst").agg(F.count("*").alias("n"))


def candidate_pool(queries: DataFrame, da: DataFrame, k: int = 100) -> DataFrame:
    """(src, dst, rank, edge, strength): edges that follow ``src`` and precede ``dst``, strongest first, ties to small ids.

    An edge's strength is the smaller of its two counts. Queries (src, dst) are made unique first.
    """
    first = da.select("src", F.col("dst").alias("edge"), F.col("n").alias("n1"))
    second = da.select(F.col("src").alias("edge"), "dst", F.col("n").alias("n2"))
    own = queries.select("src", "dst").distinct().join(first, "src").join(second, ["edge", "dst"])
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("strength"), "edge"))
    return own.withColumn("strength", F.least("n1", "n2")).withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "rank", "edge", "strength")


def candidate_rows(trips: DataFrame, pool: DataFrame, share: float = 0.2) -> DataFrame:
    """(sample_id, candidates, labels, weights) of trips (sample_id, edges) from the pool of their first and last edge.

    Of the interior edges that are candidates the first max(1, ceil(share of them)) in pool order are labelled 1; their
    weight is exp(strength / sum of their strengths), that of others 1.
    """
    e = F.col("edges")
    inner = F.when(F.size(e) > 2, F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0)))).otherwise(F.array().cast("array<long>"))
    own = trips.select("sample_id", F.element_at(e, 1).alias("src"), F.element_at(e, -1).alias("dst"), inner.alias("inner"))
    listed = pool.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("rank", "edge", "strength"))).alias("pool"))
    out = own.join(listed, ["src", "dst"])
    hits = F.filter("pool", lambda c: F.array_contains("inner", c["edge"]))
    out = out.withColumn("hits", hits).withColumn("top", F.slice("hits", F.lit(1), F.greatest(F.ceil(F.size("hits") * F.lit(share)), F.lit(1)).cast("int")))
    total = F.aggregate("top", F.lit(0).cast("long"), lambda s, c: s + c["strength"])
    out = out.withColumn("total", total)
    on = lambda c: F.exists("top", lambda t: t["edge"] == c["edge"])
    return out.select("sample_id", F.col("pool.edge").alias("candidates"), F.transform("pool", lambda c: on(c).cast("int")).alias("labels"), F.transform("pool", lambda c: F.when(on(c), F.exp(c["strength"] / F.col("total"))).otherwise(F.lit(1.0))).alias("weights"))


def skipgrams(trips: DataFrame, reach: int) -> DataFrame:
    """(center, context, n): edges at most ``reach`` places apart in a trip, both ways."""
    e = F.col("edges")
    beside = lambda i: F.concat(F.slice(e, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), F.slice(e, i + 2, F.lit(reach)))
    near = F.flatten(F.transform(e, lambda a, i: F.transform(beside(i), lambda b: F.struct(a.alias("center"), b.alias("context")))))
    return trips.select(F.explode(near).alias("p")).groupBy("p.center", "p.context").agg(F.count("*").alias("n"))


def audit(trips: DataFrame) -> DataFrame:
    """One row: trips, distinct edges, shortest, longest and summed lengths, repeated ids."""
    lengths = trips.agg(F.count("*").alias("trips"), F.min(F.size("edges")).cast("long").alias("shortest"), F.max(F.size("edges")).cast("long").alias("longest"), F.sum(F.size("edges")).cast("long").alias("total"), (F.count("*") - F.count_distinct("sample_id")).alias("repeated_ids"))
    used = trips.select(F.explode("edges").alias("e")).distinct().agg(F.count("*").alias("distinct_edges"))
    return lengths.crossJoin(used)


def changed_by_condensation(trips: DataFrame, canonical: DataFrame, rows: int) -> DataFrame:
    """One row: trips, and those that a parallel edge's stand-in would change."""
    moved = canonical.where("edge_id <> canonical").select(F.col("edge_id").alias("e"))
    hit = trips.select("sample_id", F.explode("edges").alias("e")).join(small(moved, rows), "e", "left_semi").select("sample_id").distinct()
    return trips.agg(F.count("*").alias("trips")).crossJoin(hit.agg(F.count("*").alias("changed")))
