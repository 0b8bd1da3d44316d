"""A street network that grows with the given tables: customers are crossings of a grid, orders walk on its streets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, validate
from ..operators.tables import apart

KINDS = 5  # right, left, up, down, and a second street to the right


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, x, y, n, w, bal): a crossing for each of n customers, w = ceil(sqrt(n)) to a row; keys are dense from 0."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("node_id"), F.floor(F.abs("c_acctbal")).cast("long").alias("bal"))
    w = c.agg((F.max("node_id") + 1).alias("n")).withColumn("w", F.ceil(F.sqrt("n")).cast("long"))
    return c.crossJoin(F.broadcast(w)).select("node_id", (F.col("node_id") % F.col("w")).cast("float").alias("x"), F.expr("cast(node_id div w as float)").alias("y"), "n", "w", "bal")  # one row


def step(d, w):
    return F.when(d == 1, F.lit(-1)).when(d == 2, w).when(d == 3, -w).otherwise(F.lit(1))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, tail, head, length, baseline): KINDS streets leave each crossing; the last row leads into the first."""
    d, i = F.col("d"), F.col("node_id")
    each = nodes(spark, sf_dir).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(KINDS - 1))))
    each = each.select((i * KINDS + d).alias("edge_id"), i.alias("tail"), F.pmod(i + step(d, F.col("w")), F.col("n")).cast("long").alias("head"), (F.lit(0.05) + ((F.col("bal") + d * 37) % 101) / 10.0).alias("length"))
    return apart(each.withColumn("baseline", validate.scaled_baseline(F.col("length"))))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitions(edges(spark, sf_dir))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, x, y) of the line graph: every street lies at the crossing that it leaves."""
    own = nodes(spark, sf_dir).select(F.col("node_id").alias("tail"), "x", "y")
    return edges(spark, sf_dir).join(own, "tail").select(F.col("edge_id").alias("node"), "x", "y")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, sample_id, edges, ...): the accepted walks of orders from their customers' crossings, a hop for each line item."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    w = nodes(spark, sf_dir).agg(F.max("n").alias("n"), F.max("w").alias("w"))
    orders = read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("long").alias("start")).crossJoin(F.broadcast(w))  # one row
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", ((F.col("l_suppkey") + F.col("l_linenumber")) % KINDS).alias("d"))
    hops = read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(key)).alias("hops"))
    walk = F.aggregate(
        "hops",
        F.struct(F.col("start").alias("at"), F.array().cast("array<long>").alias("edges")),
        lambda acc, h: F.struct(F.pmod(acc["at"] + step(h["d"], F.col("w")), F.col("n")).cast("long").alias("at"), F.concat(acc["edges"], F.array((acc["at"] * KINDS + h["d"]).cast("long"))).alias("edges")),
        lambda acc: acc["edges"],
    )
    raw = hops.join(apart(orders), "k").select("k", F.concat(F.lit("order:"), "k").alias("sample_id"), walk.alias("edges"))
    return validate.accepted(raw, edges(spark, sf_dir))


# The same tables as in the ring's SQL, and w (n, w), crossing (id, bal).
SQL = """
crossing AS (SELECT c_custkey AS id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS bal FROM customer),
w AS (SELECT max(id) + 1 AS n, CAST(ceil(sqrt(max(id) + 1)) AS BIGINT) AS w FROM crossing),
edges AS (SELECT id * 5 + d AS edge_id, id AS tail, ((id + CASE d WHEN 1 THEN -1 WHEN 2 THEN w WHEN 3 THEN -w ELSE 1 END) % n + n) % n AS head,
  CAST(0.05 AS DOUBLE) + CAST((bal + d * 37) % 101 AS DOUBLE) / 10.0 AS length FROM (SELECT c.*, n, w, unnest([0, 1, 2, 3, 4]) AS d FROM crossing c, w)),
raw AS (SELECT l_orderkey AS k, o_custkey AS s0, (l_suppkey + l_linenumber) % 5 AS d, n,
  CASE (l_suppkey + l_linenumber) % 5 WHEN 1 THEN -1 WHEN 2 THEN w WHEN 3 THEN -w ELSE 1 END AS st,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey, w),
run AS (SELECT k, pos, d, st, n, ((s0 + coalesce(sum(st) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % n + n) % n AS tail FROM raw),
hop AS (SELECT k, pos, CAST(tail * 5 + d AS BIGINT) AS edge_id, CAST(tail AS BIGINT) AS tail, CAST(((tail + st) % n + n) % n AS BIGINT) AS head FROM run),
origin AS (SELECT k, tail AS src FROM hop WHERE pos = 1),
good AS (SELECT h.k, count(*) AS n, min(o.src) AS src FROM hop h JOIN origin o ON h.k = o.k GROUP BY h.k
  HAVING count(*) >= 2 AND count(DISTINCT h.head) = count(*) AND sum(CASE WHEN h.head = o.src THEN 1 ELSE 0 END) = 0),
trip AS (SELECT h.k, h.pos, h.edge_id, h.tail, h.head, g.n, g.src FROM hop h JOIN good g ON h.k = g.k),
arcs AS (SELECT CAST(row_number() OVER (ORDER BY a.edge_id, b.edge_id) - 1 AS BIGINT) AS coord, a.edge_id AS prev, b.edge_id AS next,
  greatest(round(b.length * 1000), 1.0) AS w0, a.head AS via FROM edges a JOIN edges b ON a.head = b.tail),
steps AS (SELECT a.k, a.pos, a.n, t.coord, a.edge_id AS prev, b.edge_id AS next, t.w0 FROM trip a JOIN trip b ON a.k = b.k AND b.pos = a.pos + 1 JOIN arcs t ON t.prev = a.edge_id AND t.next = b.edge_id)
"""
