"""One query for each operator over the driver's tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, graph, stats, validate
from ..operators.tables import kept
from . import harness, streets

ARCS = 1024  # transitions of the derived network

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, tables: str = harness.SQL):
    """Register a query under its function's name; ``sql`` follows ``tables``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {tables.strip()}{sql}"
        return f

    return add


def _edges(spark) -> DataFrame:
    e = harness.edges(spark)
    return e.withColumn("baseline", validate.scaled_baseline(F.col("length")))


def _arcs(spark) -> DataFrame:
    return graph.transitions(_edges(spark))


def _good(spark, sf_dir) -> DataFrame:
    return validate.accepted(harness.raw_trips(spark, sf_dir), _edges(spark))


def _predicted(trips: DataFrame) -> DataFrame:
    """Made-up predictions: each third route lacks its last edge, each fifth has another first edge."""
    e, k = F.col("edges"), F.col("k")
    cut = F.when(k % 3 == 0, F.slice(e, F.lit(1), F.size(e) - 1)).otherwise(e)
    return trips.withColumn("edges", cut).withColumn("edges", F.when(k % 5 == 0, F.transform("edges", lambda x, i: F.when(i == 0, (x + 1) % 256).otherwise(x))).otherwise(F.col("edges")))


def _metrics(spark, sf_dir) -> DataFrame:
    trips = _good(spark, sf_dir).select("k", "sample_id", "edges")
    return evaluate.route_metrics(trips.select("sample_id", F.col("edges").alias("truth"), _predicted_column().alias("predicted")))


def _predicted_column():
    e, k = F.col("edges"), F.col("k")
    cut = F.when(k % 3 == 0, F.slice(e, F.lit(1), F.size(e) - 1)).otherwise(e)
    return F.when(k % 5 == 0, F.transform(cut, lambda x, i: F.when(i == 0, (x + 1) % 256).otherwise(x))).otherwise(cut)


# Made-up predictions in SQL: pred (k, pos, edge_id).
PRED = """, pred AS (SELECT k, pos, n, CASE WHEN k % 5 = 0 AND pos = 1 THEN (edge_id + 1) % 256 ELSE edge_id END AS edge_id
  FROM trip WHERE NOT (k % 3 = 0 AND pos = n)),
tset AS (SELECT DISTINCT k, edge_id FROM trip), pset AS (SELECT DISTINCT k, edge_id FROM pred),
tn AS (SELECT k, count(*) AS t FROM tset GROUP BY k), pn AS (SELECT k, count(*) AS p FROM pset GROUP BY k),
bn AS (SELECT a.k, count(*) AS b FROM tset a JOIN pset c ON a.k = c.k AND a.edge_id = c.edge_id GROUP BY a.k),
metric AS (SELECT tn.k, CAST(coalesce(b, 0) AS DOUBLE) / p AS edge_precision, CAST(coalesce(b, 0) AS DOUBLE) / t AS edge_recall,
  CAST(coalesce(b, 0) AS DOUBLE) / (t + p - coalesce(b, 0)) AS edge_jaccard,
  CAST(CASE WHEN tn.k % 3 = 0 OR tn.k % 5 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS exact_match,
  CAST(CASE WHEN tn.k % 3 = 0 OR tn.k % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS endpoint_failure
  FROM tn JOIN pn ON tn.k = pn.k LEFT JOIN bn ON tn.k = bn.k),
scored AS (SELECT *, CASE WHEN edge_precision + edge_recall = 0 THEN 0.0 ELSE 2 * edge_precision * edge_recall / (edge_precision + edge_recall) END AS edge_f1 FROM metric)
"""


@query("SELECT edge_id, tail, head, length, greatest(round(length * 1000), 1.0) AS baseline FROM edges", streets.SQL)
def network_edges(spark, sf_dir):
    return streets.edges(spark, sf_dir)


DIRTY = """, allraw AS (SELECT h.k, h.pos, h.edge_id, count(*) OVER (PARTITION BY h.k) AS n FROM hop h),
dirty AS (SELECT k, pos, n, CASE WHEN k % 97 = 0 THEN CASE WHEN pos = n THEN 9999 ELSE edge_id END
  WHEN k % 89 = 0 AND pos = 2 THEN (edge_id + 4) % 256 ELSE edge_id END AS edge_id FROM allraw),
ends AS (SELECT d.*, e.tail, e.head FROM dirty d LEFT JOIN edges e ON d.edge_id = e.edge_id),
chain AS (SELECT *, lead(tail) OVER (PARTITION BY k ORDER BY pos) AS nt, first_value(tail) OVER (PARTITION BY k ORDER BY pos) AS ft FROM ends),
facts AS (SELECT k, max(n) AS n, sum(CASE WHEN head IS NULL THEN 1 ELSE 0 END) AS outside, sum(CASE WHEN pos < n AND nt <> head THEN 1 ELSE 0 END) AS gaps,
  count(DISTINCT head) AS heads, sum(CASE WHEN head = ft THEN 1 ELSE 0 END) AS back FROM chain GROUP BY k),
judged AS (SELECT 'order:' || k AS sample_id, CASE WHEN k % 83 = 0 THEN 'empty' WHEN n < {least} THEN 'too_short' WHEN outside > 0 THEN 'out_of_bounds'
  WHEN gaps > 0 THEN 'discontinuous' WHEN heads < n OR back > 0 THEN 'cyclic' ELSE 'accepted' END AS reason FROM facts)
"""


@query(DIRTY.format(least=2) + "SELECT sample_id, reason FROM judged")
def trip_reject_reasons(spark, sf_dir):
    return validate.classify(harness.dirty_trips(spark, sf_dir), _edges(spark)).select("sample_id", "reason")


@query(DIRTY.format(least=2) + "SELECT reason, count(*) AS n FROM judged GROUP BY reason")
def trip_reject_report(spark, sf_dir):
    return validate.report(validate.classify(harness.dirty_trips(spark, sf_dir), _edges(spark)))


@query(DIRTY.format(least=5) + "SELECT reason, count(*) AS n FROM judged GROUP BY reason")
def five_edge_filter_report(spark, sf_dir):
    return validate.report(validate.classify(harness.dirty_trips(spark, sf_dir), _edges(spark), min_edges=5))


@query("SELECT coord, prev, next, w0 FROM arcs", streets.SQL)
def line_graph_transitions(spark, sf_dir):
    return streets.arcs(spark, sf_dir).select("coord", "prev", "next", "w0")


@query("SELECT coord, w0, w0 * 0.5 AS lo, w0 * 2.0 AS hi, CAST(greatest(round(w0), 1.0) AS BIGINT) AS q0, CAST(greatest(round(w0 * 0.5), 1.0) AS BIGINT) AS qlo, CAST(greatest(round(w0 * 2.0), 1.0) AS BIGINT) AS qhi FROM arcs", streets.SQL)
def transition_bounds_quantized(spark, sf_dir):
    return graph.quantized_bounds(streets.arcs(spark, sf_dir))


@query("SELECT edge_id, CAST(0.5 AS FLOAT) * CAST(tail % w AS FLOAT) + CAST(0.5 AS FLOAT) * CAST(head % w AS FLOAT) AS x, CAST(0.5 AS FLOAT) * CAST(tail // w AS FLOAT) + CAST(0.5 AS FLOAT) * CAST(head // w AS FLOAT) AS y FROM edges, w", streets.SQL)
def edge_midpoints(spark, sf_dir):
    return graph.midpoints(streets.edges(spark, sf_dir), streets.nodes(spark, sf_dir))


@query(", o AS (SELECT tail AS node_id, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS outgoing FROM edges GROUP BY tail), i AS (SELECT head AS node_id, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS incoming FROM edges GROUP BY head) SELECT o.node_id, outgoing, incoming FROM o JOIN i ON o.node_id = i.node_id", streets.SQL)
def node_adjacency(spark, sf_dir):
    return graph.adjacency(streets.edges(spark, sf_dir)).select("node_id", F.array_join("outgoing", ",").alias("outgoing"), F.array_join("incoming", ",").alias("incoming"))


@query("SELECT 'order:' || k AS sample_id, string_agg(CAST(coord AS VARCHAR), ',' ORDER BY pos) AS coords FROM steps GROUP BY k")
def trip_coordinates(spark, sf_dir):
    return graph.coordinates(_good(spark, sf_dir), _arcs(spark), ARCS).select("sample_id", F.array_join("coords", ",").alias("coords"))


@query("SELECT 'order:' || k AS sample_id, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY pos) AS edges, true AS connected FROM trip GROUP BY k")
def coordinates_decode(spark, sf_dir):
    arcs = _arcs(spark)
    return graph.decode(graph.coordinates(_good(spark, sf_dir), arcs, ARCS), arcs, ARCS).select("sample_id", F.array_join("edges", ",").alias("edges"), "connected")


@query("SELECT a.coord, count(s.k) AS n FROM arcs a LEFT JOIN steps s ON a.coord = s.coord GROUP BY a.coord")
def observed_counts(spark, sf_dir):
    return stats.observed_counts(_good(spark, sf_dir), _arcs(spark), ARCS)


OD = ", od AS (SELECT src, head AS dst, count(*) AS n FROM trip WHERE pos = n GROUP BY src, head)"


@query(OD + " SELECT CAST(src AS BIGINT) AS src, dst, n FROM od")
def od_groups(spark, sf_dir):
    return stats.od_groups(_good(spark, sf_dir))


@query(OD + ", o AS (SELECT tail, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS sources FROM edges GROUP BY tail), i AS (SELECT head, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS targets FROM edges GROUP BY head) SELECT CAST(src AS BIGINT) AS src, dst, n, sources, targets FROM od JOIN o ON od.src = o.tail JOIN i ON od.dst = i.head")
def node_query_endpoints(spark, sf_dir):
    found = graph.endpoints(stats.od_groups(_good(spark, sf_dir)), _edges(spark))
    return found.select("src", "dst", "n", F.array_join("sources", ",").alias("sources"), F.array_join("targets", ",").alias("targets"))


@query("SELECT edge_id, max(edge_id) OVER (PARTITION BY tail, head) AS canonical FROM edges", streets.SQL)
def parallel_edge_canonical(spark, sf_dir):
    return graph.canonical_parallel(streets.edges(spark, sf_dir))


@query("SELECT head, tail, min(greatest(round(length * 1000), 1.0)) AS weight FROM edges GROUP BY head, tail", streets.SQL)
def parallel_edge_min(spark, sf_dir):
    return graph.parallel_minimum(streets.edges(spark, sf_dir))


@query(", c AS (SELECT a.coord, a.prev, a.next, count(s.k) AS n FROM arcs a LEFT JOIN steps s ON a.coord = s.coord GROUP BY a.coord, a.prev, a.next) SELECT coord, prev, next, CAST(greatest(round(-ln((n + 1.0) / (sum(n) OVER (PARTITION BY prev) + 1.0 * count(*) OVER (PARTITION BY prev))) * 100000), 1.0) AS BIGINT) AS cost FROM c")
def markov_costs(spark, sf_dir):
    arcs = _arcs(spark)
    return stats.markov_costs(arcs, stats.observed_counts(_good(spark, sf_dir), arcs, ARCS), 1.0)


@query(", c AS (SELECT e.edge_id, count(t.k) AS n FROM edges e LEFT JOIN trip t ON e.edge_id = t.edge_id GROUP BY e.edge_id) SELECT edge_id, n, CASE WHEN max(n) OVER () > min(n) OVER () THEN CAST(n - min(n) OVER () AS DOUBLE) / (max(n) OVER () - min(n) OVER ()) ELSE 0.0 END AS normalised FROM c")
def edge_popularity_minmax(spark, sf_dir):
    return stats.popularity(_good(spark, sf_dir), _edges(spark))


DA = ", da AS (SELECT a.edge_id AS src, b.edge_id AS dst, count(*) AS n FROM trip a JOIN trip b ON a.k = b.k AND a.pos < b.pos GROUP BY a.edge_id, b.edge_id)"
POOL = DA + """, q AS (SELECT DISTINCT a.edge_id AS src, b.edge_id AS dst FROM trip a JOIN trip b ON a.k = b.k AND a.pos = 1 AND b.pos = b.n),
ranked AS (SELECT q.src, q.dst, x.dst AS edge, least(x.n, y.n) AS strength, row_number() OVER (PARTITION BY q.src, q.dst ORDER BY least(x.n, y.n) DESC, x.dst) AS rank
  FROM q JOIN da x ON x.src = q.src JOIN da y ON y.src = x.dst AND y.dst = q.dst),
pool AS (SELECT * FROM ranked WHERE rank <= 100)"""


def _pool(trips):
    e = F.col("edges")
    return stats.candidate_pool(trips.select(F.element_at(e, 1).alias("src"), F.element_at(e, -1).alias("dst")), stats.associations(trips), 100)


@query(DA + " SELECT src, dst, n FROM da")
def directed_association(spark, sf_dir):
    return stats.associations(_good(spark, sf_dir))


@query(POOL + " SELECT src, dst, CAST(rank AS INTEGER) AS rank, edge, strength FROM pool")
def candidate_pool_topk(spark, sf_dir):
    return _pool(_good(spark, sf_dir))


@query(POOL + """, first AS (SELECT k, edge_id AS src FROM trip WHERE pos = 1), last AS (SELECT k, edge_id AS dst FROM trip WHERE pos = n),
hits AS (SELECT f.k, p.rank, p.edge, p.strength, row_number() OVER (PARTITION BY f.k ORDER BY p.rank) AS i, count(*) OVER (PARTITION BY f.k) AS c
  FROM first f JOIN last l ON f.k = l.k JOIN pool p ON p.src = f.src AND p.dst = l.dst JOIN trip t ON t.k = f.k AND t.edge_id = p.edge AND t.pos > 1 AND t.pos < t.n)
SELECT 'order:' || k AS sample_id, CAST(edge AS BIGINT) AS edge, CAST(strength AS BIGINT) AS strength FROM hits WHERE i <= greatest(ceil(c * 0.2), 1)""")
def candidate_labels(spark, sf_dir):
    trips = _good(spark, sf_dir)
    pool = kept(_pool(trips))
    rows = stats.candidate_rows(trips, pool)
    pairs = F.filter(F.arrays_zip("candidates", "labels", "weights"), lambda c: c["labels"] == 1)
    on = rows.select("sample_id", F.explode(pairs).alias("c")).select("sample_id", F.col("c.candidates").alias("edge"))
    e = F.col("edges")
    own = trips.select("sample_id", F.element_at(e, 1).alias("src"), F.element_at(e, -1).alias("dst"))
    return on.join(own, "sample_id").join(pool, ["src", "dst", "edge"]).select("sample_id", "edge", "strength")


@query("SELECT a.edge_id AS center, b.edge_id AS context, count(*) AS n FROM trip a JOIN trip b ON a.k = b.k AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2 GROUP BY a.edge_id, b.edge_id".replace("SELECT a", " SELECT a", 1))
def skipgram_pairs(spark, sf_dir):
    return stats.skipgrams(_good(spark, sf_dir), 2)


@query(" SELECT (SELECT count(*) FROM good) AS trips, (SELECT min(n) FROM good) AS shortest, (SELECT max(n) FROM good) AS longest, CAST((SELECT sum(n) FROM good) AS BIGINT) AS total, CAST(0 AS BIGINT) AS repeated_ids, (SELECT count(DISTINCT edge_id) FROM trip) AS distinct_edges")
def audit_counters(spark, sf_dir):
    return stats.audit(_good(spark, sf_dir))


@query(", m AS (SELECT edge_id, max(edge_id) OVER (PARTITION BY tail, head) AS c FROM edges) SELECT (SELECT count(*) FROM good) AS trips, (SELECT count(DISTINCT k) FROM trip t JOIN m ON t.edge_id = m.edge_id WHERE m.c <> m.edge_id) AS changed")
def condensation_audit(spark, sf_dir):
    return stats.changed_by_condensation(_good(spark, sf_dir), graph.canonical_parallel(_edges(spark)), 256)


@query(PRED + "SELECT 'order:' || k AS sample_id, exact_match, edge_precision, edge_recall, edge_f1, edge_jaccard, endpoint_failure FROM scored")
def route_metrics_rows(spark, sf_dir):
    return _metrics(spark, sf_dir).select("sample_id", *evaluate.METRICS, "endpoint_failure")


@query(PRED + "SELECT count(*) AS sample_count, round(avg(exact_match), 9) AS exact_match, round(avg(edge_precision), 9) AS edge_precision, round(avg(edge_recall), 9) AS edge_recall, round(avg(edge_f1), 9) AS edge_f1, round(avg(edge_jaccard), 9) AS edge_jaccard FROM scored")
def route_metrics_macro(spark, sf_dir):
    trips = _good(spark, sf_dir)
    aligned = evaluate.align(trips.select("sample_id", "edges"), _predicted(trips).select("sample_id", "edges"))
    return evaluate.macro(evaluate.route_metrics(aligned)).select("sample_count", *(F.round(m, 9).alias(m) for m in evaluate.METRICS))


def _ci_sql(names, table="scored", clamp=True):
    low, high = ("greatest({l}, 0.0)", "least({h}, 1.0)") if clamp else ("{l}", "{h}")
    z = 1.9599639845400536
    rows = []
    for n in names:
        m, s = f"avg({n})", f"stddev_samp({n}) / sqrt(count(*))"
        rows.append(f"SELECT '{n}' AS metric, count(*) AS n, round({m}, 9) AS mean, round({s}, 9) AS se, round({low.format(l=f'{m} - {z} * {s}')}, 9) AS low, round({high.format(h=f'{m} + {z} * {s}')}, 9) AS high FROM {table}")
    return " UNION ALL ".join(rows)


def _rounded(ci):
    return ci.select("metric", "n", *(F.round(c, 9).alias(c) for c in ("mean", "se", "low", "high")))


@query(PRED + _ci_sql(["exact_match", "edge_f1", "endpoint_failure"]))
def route_metric_ci(spark, sf_dir):
    return _rounded(evaluate.interval(_metrics(spark, sf_dir), ["exact_match", "edge_f1", "endpoint_failure"]))


@query(PRED + ", diff AS (SELECT edge_f1 - 1.0 AS edge_f1, exact_match - 1.0 AS exact_match FROM scored) " + _ci_sql(["exact_match", "edge_f1"], "diff", False))
def paired_difference_ci(spark, sf_dir):
    own = _metrics(spark, sf_dir)
    perfect = evaluate.route_metrics(own.select("sample_id", "truth", F.col("truth").alias("predicted")))
    return _rounded(evaluate.paired_interval(own, perfect, ["exact_match", "edge_f1"]))


@query(PRED + "SELECT count(*) AS routes, CAST(sum(endpoint_failure) AS BIGINT) AS failures, round(avg(endpoint_failure), 9) AS rate FROM scored")
def endpoint_failures(spark, sf_dir):
    return evaluate.endpoint_failures(_metrics(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query(" SELECT 'order:' || k AS sample_id, 'missing' AS kind FROM good WHERE k % 11 = 0 UNION ALL SELECT 'extra:' || k, 'extra' FROM good WHERE k % 13 = 0 AND k % 11 <> 0 UNION ALL SELECT 'order:' || k, 'duplicate_prediction' FROM good WHERE k % 17 = 0 AND k % 11 <> 0")
def alignment_missing_extra(spark, sf_dir):
    trips = _good(spark, sf_dir).select("k", "sample_id", "edges")
    kept = trips.where("k % 11 <> 0")
    extra = kept.where("k % 13 = 0").withColumn("sample_id", F.concat(F.lit("extra:"), "k"))
    return evaluate.misaligned(trips, kept.union(extra).union(kept.where("k % 17 = 0")))


@query(" SELECT (SELECT count(*) FROM good WHERE k % 10 >= 8 AND k % 7 = 0) AS shared")
def split_overlap(spark, sf_dir):
    trips = _good(spark, sf_dir).select("k", "sample_id")
    return evaluate.overlap(trips.where("k % 10 >= 8"), trips.where("k % 7 = 0"))


@query(PRED + """, ps AS (SELECT a.k, a.edge_id AS prev, b.edge_id AS next FROM pred a JOIN pred b ON a.k = b.k AND b.pos = a.pos + 1),
bad AS (SELECT p.k, count(*) AS c FROM ps p LEFT JOIN arcs x ON x.prev = p.prev AND x.next = p.next WHERE x.coord IS NULL GROUP BY p.k),
rep AS (SELECT k, count(*) - count(DISTINCT edge_id) AS r FROM pred GROUP BY k)
SELECT (SELECT count(*) FROM good) AS routes, CAST(0 AS BIGINT) AS empty, (SELECT count(*) FROM good WHERE k % 5 = 0) AS source_mismatch, (SELECT count(*) FROM trip t JOIN pred p ON p.k = t.k WHERE t.pos = t.n AND p.pos = (CASE WHEN t.k % 3 = 0 THEN t.n - 1 ELSE t.n END) AND p.edge_id <> t.edge_id) AS destination_mismatch,
(SELECT count(*) FROM bad) AS illegal_routes, CAST((SELECT coalesce(sum(c), 0) FROM bad) AS BIGINT) AS illegal_transitions, (SELECT count(*) FROM rep WHERE r > 0) AS non_simple, CAST((SELECT sum(r) FROM rep) AS BIGINT) AS repeated""")
def route_validity_stats(spark, sf_dir):
    trips = _good(spark, sf_dir).withColumns({"src": F.element_at("edges", 1), "dst": F.element_at("edges", -1)})
    return evaluate.validity(_predicted(trips).select("sample_id", "edges", "src", "dst"), _arcs(spark), ARCS)


@query(" SELECT CAST(quantile_cont(CAST(n AS DOUBLE), 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(CAST(n AS DOUBLE), 0.95) AS DOUBLE) AS p95 FROM good")
def latency_percentiles(spark, sf_dir):
    return _good(spark, sf_dir).agg(F.percentile(F.size("edges").cast("double"), F.lit(0.5)).alias("p50"), F.percentile(F.size("edges").cast("double"), F.lit(0.95)).alias("p95"))


@query(PRED + ", g AS (SELECT k % 7 AS alpha, round(avg(edge_f1), 6) AS f1, round(avg(exact_match), 6) AS exact FROM scored GROUP BY k % 7) SELECT alpha, f1, exact FROM g ORDER BY f1 DESC, exact DESC, alpha LIMIT 1")
def candidate_selection_best(spark, sf_dir):
    own = _metrics(spark, sf_dir).withColumn("alpha", F.split_part("sample_id", F.lit(":"), F.lit(2)).cast("long") % 7)
    g = own.groupBy("alpha").agg(F.round(F.avg("edge_f1"), 6).alias("f1"), F.round(F.avg("exact_match"), 6).alias("exact"))
    return evaluate.best(g, [-F.col("f1"), -F.col("exact"), F.col("alpha")])


@query(" SELECT CAST((row_number() OVER (ORDER BY k) - 1) // 500 AS BIGINT) AS shard, k FROM good".join([", s AS (", ") SELECT shard, min(k) AS first, max(k) AS last, count(*) AS n FROM s GROUP BY shard"]))
def shard_plan(spark, sf_dir):
    return evaluate.shard_plan(_good(spark, sf_dir).select("k"), 500, "k")


@query(PRED + " SELECT 'made-up' AS method, CAST(avg(edge_f1) > 0.5 AS BOOLEAN) AS good, CAST(NULL AS DOUBLE) AS seconds, 'partial' AS status FROM scored")
def method_summary(spark, sf_dir):
    quality = evaluate.macro(_metrics(spark, sf_dir)).select(F.lit("made-up").alias("method"), (F.col("edge_f1") > 0.5).alias("good"))
    timing = spark.createDataFrame([], "method string, seconds double")
    return evaluate.method_summary([quality, timing], ["good", "seconds"])
