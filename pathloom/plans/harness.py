"""A road network and trips derived from the order tables, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = 64


def edges(spark: SparkSession) -> DataFrame:
    """Four edges leave each of 64 nodes on a ring; the second and third are parallel."""
    e = spark.range(NODES * 4).withColumnRenamed("id", "edge_id")
    tail, d = F.expr("edge_id div 4"), F.col("edge_id") % 4
    step = F.when(d == 0, 1).when(d == 3, -3).otherwise(2)
    return e.select("edge_id", tail.alias("tail"), F.pmod(tail + step, F.lit(NODES)).cast("long").alias("head"), (F.lit(0.05) + ((F.col("edge_id") * 37) % 101) / 10.0).alias("length"))


def nodes(spark: SparkSession) -> DataFrame:
    """Node n lies at (n mod 8, n div 8)."""
    return spark.range(NODES).select(F.col("id").alias("node_id"), (F.col("id") % 8).cast("float").alias("x"), F.expr("cast(id div 8 as float)").alias("y"))


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, sample_id, edges): an order's line items are hops from its customer's node.

    Line items meet their order in one shuffle by order key; the walk is folded inside the row.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.pmod("o_custkey", F.lit(NODES)).alias("start"))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", ((F.col("l_suppkey") + F.col("l_linenumber")) % 4).alias("d"))
    hops = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(key)).alias("hops"))
    step = lambda d: F.when(d == 0, 1).when(d == 3, -3).otherwise(2)
    walk = F.aggregate(
        "hops",
        F.struct(F.col("start").cast("long").alias("at"), F.array().cast("array<long>").alias("edges")),
        lambda acc, h: F.struct(F.pmod(acc["at"] + step(h["d"]), F.lit(NODES)).cast("long").alias("at"), F.concat(acc["edges"], F.array((acc["at"] * 4 + h["d"]).cast("long"))).alias("edges")),
        lambda acc: acc["edges"],
    )
    return hops.join(orders, "k").select("k", F.concat(F.lit("order:"), "k").alias("sample_id"), walk.alias("edges"))


def dirty_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips of which some are broken, so that every reason to reject one occurs."""
    e, n = F.col("edges"), F.size("edges")
    broken = F.transform(e, lambda x, i: F.when(i == 1, (x + 4) % 256).otherwise(x))
    beyond = F.transform(e, lambda x, i: F.when(i == n - 1, F.lit(9999).cast("long")).otherwise(x))
    found = F.when(F.col("k") % 83 == 0, F.array().cast("array<long>")).when(F.col("k") % 97 == 0, beyond).when(F.col("k") % 89 == 0, broken).otherwise(e)
    return raw_trips(spark, sf_dir).withColumn("edges", found)


# DuckDB: edges, hop (k, pos, edge_id, tail, head), good (k, n) for simple trips of two edges or more, trip = hops of these.
SQL = """
edges AS (SELECT CAST(t.t * 4 + s.d AS BIGINT) AS edge_id, CAST(t.t AS BIGINT) AS tail,
  CAST((t.t + CASE s.d WHEN 0 THEN 1 WHEN 3 THEN -3 ELSE 2 END + 64) % 64 AS BIGINT) AS head,
  CAST(0.05 AS DOUBLE) + CAST(((t.t * 4 + s.d) * 37) % 101 AS DOUBLE) / 10.0 AS length FROM range(64) t(t), range(4) s(d)),
raw AS (SELECT l_orderkey AS k, o_custkey % 64 AS s0, (l_suppkey + l_linenumber) % 4 AS d,
  CASE (l_suppkey + l_linenumber) % 4 WHEN 0 THEN 1 WHEN 3 THEN -3 ELSE 2 END AS st,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
run AS (SELECT k, pos, d, st, ((s0 + coalesce(sum(st) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 64 + 64) % 64 AS tail FROM raw),
hop AS (SELECT k, pos, CAST(tail * 4 + d AS BIGINT) AS edge_id, CAST(tail AS BIGINT) AS tail, CAST((tail + st + 64) % 64 AS BIGINT) AS head FROM run),
origin AS (SELECT k, tail AS src FROM hop WHERE pos = 1),
good AS (SELECT h.k, count(*) AS n, min(o.src) AS src FROM hop h JOIN origin o ON h.k = o.k GROUP BY h.k
  HAVING count(*) >= 2 AND count(DISTINCT h.head) = count(*) AND sum(CASE WHEN h.head = o.src THEN 1 ELSE 0 END) = 0),
trip AS (SELECT h.k, h.pos, h.edge_id, h.tail, h.head, g.n, g.src FROM hop h JOIN good g ON h.k = g.k),
arcs AS (SELECT CAST(row_number() OVER (ORDER BY a.edge_id, b.edge_id) - 1 AS BIGINT) AS coord, a.edge_id AS prev, b.edge_id AS next,
  greatest(round(b.length * 1000), 1.0) AS w0, a.head AS via FROM edges a JOIN edges b ON a.head = b.tail),
steps AS (SELECT a.k, a.pos, a.n, t.coord, a.edge_id AS prev, b.edge_id AS next, t.w0 FROM trip a JOIN trip b ON a.k = b.k AND b.pos = a.pos + 1 JOIN arcs t ON t.prev = a.edge_id AND t.next = b.edge_id)
"""
