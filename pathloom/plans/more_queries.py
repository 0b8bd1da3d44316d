"""Queries of the iterative operators, shortcuts, strict records and timed analytics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import archive, scalar
from ..operators import blocks, evaluate, fit, graph, paths, predict, reports, shortcuts, stats, tables, validate
from ..operators.tables import kept
from ..schema import FitOptions
from ..sources import records
from . import harness, streets
from .queries import ARCS, OD, PRED, _arcs, _edges, _good, _metrics, _predicted, query


def _counts(trips, arcs):
    return stats.observed_counts(trips, arcs, ARCS)


def _small(trips):
    """Trips without the columns of the classifier, written once: what follows reads them several times."""
    return kept(trips.select("k", "sample_id", "edges", "src", "dst"))


# All distances of the 256-edge line graph by repeated squaring of (min, +), each cost that of the entered edge.
DIST = ", d0 AS (SELECT prev AS a, next AS b, min(w0) AS w FROM (SELECT prev, next, w0 FROM arcs UNION ALL SELECT edge_id, edge_id, 0.0 FROM edges) GROUP BY prev, next)" + "".join(
    f", d{i} AS (SELECT x.a, y.b, min(x.w + y.w) AS w FROM d{i - 1} x JOIN d{i - 1} y ON x.b = y.a GROUP BY x.a, y.b)" for i in range(1, 6)
)
ENDS = ", fe AS (SELECT k, edge_id AS s FROM trip WHERE pos = 1), le AS (SELECT k, edge_id AS t FROM trip WHERE pos = n)"


@query(DIST + ENDS + " SELECT DISTINCT fe.s AS src, le.t AS dst, CAST(d5.w AS BIGINT) AS distance FROM fe JOIN le ON fe.k = le.k JOIN d5 ON d5.a = fe.s AND d5.b = le.t")
def sp_length_distances(spark, sf_dir):
    trips, arcs = _good(spark, sf_dir), _arcs(spark)
    found = paths.DijkstraOracle().shortest_paths(arcs, predict.length_metric(arcs), paths.edge_queries(trips))
    return found.select(F.get("nodes", F.lit(0)).alias("src"), F.element_at("nodes", -1).alias("dst"), "distance")


@query(ENDS + " SELECT count(*) AS queries, count(*) AS valid FROM (SELECT DISTINCT fe.s, le.t FROM fe JOIN le ON fe.k = le.k)")
def path_validation(spark, sf_dir):
    trips, arcs = _good(spark, sf_dir), _arcs(spark)
    asked, metric = paths.edge_queries(trips), predict.length_metric(arcs)
    found = paths.DijkstraOracle().shortest_paths(arcs, metric, asked)
    return paths.validate_paths(found, asked, arcs, metric).agg(F.count("*").alias("queries"), F.count_if("valid").alias("valid"))


@query()
def sp_length_predict(spark, sf_dir):
    trips, arcs = _small(_good(spark, sf_dir)), _arcs(spark)
    found = predict.predict(trips, arcs, predict.length_metric(arcs))
    return evaluate.macro(evaluate.route_metrics(evaluate.align(trips, found)))


@query()
def markov_sp_predict(spark, sf_dir):
    trips, arcs = _small(_good(spark, sf_dir)), _arcs(spark)
    counts = kept(_counts(trips.where("k % 10 < 7"), arcs))
    alpha, _ = predict.select_alpha(trips.where("k % 10 = 7"), arcs, counts, [0.1, 1.0, 10.0])
    test = trips.where("k % 10 > 7")
    found = predict.predict(test, arcs, predict.markov_metric(arcs, counts, alpha))
    return evaluate.macro(evaluate.route_metrics(evaluate.align(test, found))).withColumn("alpha", F.lit(alpha))


@query()
def node_paths_predicted_counts(spark, sf_dir):
    fitter = fit.Fitter(_edges(spark), _small(_good(spark, sf_dir)), FitOptions())
    found = fitter.evaluate(fitter.initial)
    return spark.createDataFrame([(int(c), int(n)) for c, n in zip(fitter.coord, found.predicted)], "coord long, n long")


@query()
def fit_three_updates(spark, sf_dir):
    model, _ = fit.fit(_edges(spark), _small(_good(spark, sf_dir)).where("k % 10 < 7"), FitOptions(updates=3))
    return model


@query()
def learned_predict(spark, sf_dir):
    trips, arcs = _small(_good(spark, sf_dir)), _arcs(spark)
    model, _ = fit.fit(_edges(spark), trips.where("k % 10 < 7"), FitOptions(updates=3))
    test = trips.where("k % 10 > 7")
    return evaluate.macro(evaluate.route_metrics(evaluate.align(test, predict.predict(test, arcs, predict.model_metric(model)))))


STEPS2 = PRED + """, ps AS (SELECT t.coord, count(*) AS n FROM pred a JOIN pred b ON a.k = b.k AND b.pos = a.pos + 1 JOIN arcs t ON t.prev = a.edge_id AND t.next = b.edge_id GROUP BY t.coord),
os AS (SELECT coord, count(*) AS n FROM steps GROUP BY coord),
pairs AS (SELECT a.coord, a.w0, coalesce(os.n, 0) AS observed, coalesce(ps.n, 0) AS predicted FROM arcs a LEFT JOIN os ON a.coord = os.coord LEFT JOIN ps ON a.coord = ps.coord)"""


def _both(spark, sf_dir):
    trips, arcs = _good(spark, sf_dir), _arcs(spark)
    made = graph.steps(_predicted(trips).select("sample_id", "edges"), arcs, ARCS).where("coord is not null").groupBy("coord").agg(F.count("*").alias("p"))
    counts = _counts(trips, arcs).join(made, "coord", "left").select("coord", F.col("n").alias("observed"), F.coalesce("p", F.lit(0)).cast("long").alias("predicted"))
    return trips, arcs, counts


@query(STEPS2 + """, s AS (SELECT sum(w0 * observed) AS o, sum(w0 * predicted) AS p, (SELECT count(*) FROM good) AS n FROM pairs)
SELECT o AS observed_cost, p AS predicted_cost, o - p AS data_loss, round((o - p) / n, 9) AS mean_loss, round((o - p) / o, 9) AS relative_loss, round(0.1 / (2 * 1024) * 1024 * 0.25, 9) AS regularizer FROM s""")
def regret_and_regularizer(spark, sf_dir):
    trips, arcs, counts = _both(spark, sf_dir)
    own = arcs.join(counts, "coord").withColumn("weight", F.col("w0") * 1.5)
    sums = own.agg(F.sum(F.col("w0") * F.col("observed")).alias("observed_cost"), F.sum(F.col("w0") * F.col("predicted")).alias("predicted_cost"), (F.lit(0.1) / (2 * F.count("*")) * F.sum(F.pow(F.col("weight") / F.col("w0") - 1, F.lit(2)))).alias("r"))
    n = trips.agg(F.count("*").alias("n"))
    loss = F.col("observed_cost") - F.col("predicted_cost")
    return sums.crossJoin(n).select("observed_cost", "predicted_cost", loss.alias("data_loss"), F.round(evaluate.ratio(loss, F.col("n")), 9).alias("mean_loss"), F.round(evaluate.ratio(loss, F.col("observed_cost")), 9).alias("relative_loss"), F.round("r", 9).alias("regularizer"))


@query(STEPS2 + ", g AS (SELECT coord, w0, 1.0 - 0.5 * (w0 * (observed - predicted) * (1.0 / (SELECT CAST(count(*) AS DOUBLE) FROM good))) AS q FROM pairs) SELECT coord, round(least(greatest(w0 * least(greatest(q, 0.5), 2.0), w0 * 0.5), w0 * 2.0), 6) AS weight FROM g")
def subgradient_step(spark, sf_dir):
    trips, arcs, counts = _both(spark, sf_dir)
    n = trips.count()
    moved = fit.step_table(arcs.withColumn("weight", F.col("w0")), counts, n, FitOptions(eta0=0.5, lam=0.1))
    return moved.select("coord", F.round("weight", 6).alias("weight"))


def _planned(spark, sf_dir, popular: bool):
    trips, arcs = _small(_good(spark, sf_dir)), _arcs(spark)
    train, test = trips.where("k % 10 < 7"), trips.where("k % 10 > 7")
    e = F.col("edges")
    asked = test.select("sample_id", F.element_at(e, 1).alias("src"), F.element_at(e, -1).alias("dst"))
    pop = stats.popularity(train, _edges(spark)).select("edge_id", "normalised") if popular else None
    places = graph.midpoints(_edges(spark), harness.nodes(spark)) if popular else None
    found = predict.plan(asked, arcs, stats.associations(train), pop, places)
    return evaluate.macro(evaluate.route_metrics(evaluate.align(test, found)))


@query()
def drp_tp_routes(spark, sf_dir):
    return _planned(spark, sf_dir, False)


@query()
def drp_popularity_routes(spark, sf_dir):
    return _planned(spark, sf_dir, True)


@query()
def greedy_rollout(spark, sf_dir):
    trips, arcs = _small(_good(spark, sf_dir)), _arcs(spark)
    e = F.col("edges")
    asked = trips.select("sample_id", F.element_at(e, 1).alias("src"), F.element_at(e, -1).alias("dst"))

    def nearer(at, candidate, destination):
        """Edges whose tail has the least way round the ring to go."""
        return -(((destination // 4) - (candidate // 4)) % 64).astype(float)

    found = predict.rollout(asked, arcs, nearer, cap=64)
    return evaluate.macro(evaluate.route_metrics(evaluate.align(trips, found)))


@query()
def random_walks(spark, sf_dir):
    return predict.walks(streets.edges(spark, sf_dir).select(F.col("edge_id").alias("edge")), streets.arcs(spark, sf_dir), 10, 2, p=0.5, q=2.0, seed=7).select("walk", F.array_join("edges", ",").alias("edges"))


# Every least cost: paths of up to 256 arcs, as many as there are edges.
FAR = DIST + "".join(f", d{i} AS (SELECT x.a, y.b, min(x.w + y.w) AS w FROM d{i - 1} x JOIN d{i - 1} y ON x.b = y.a GROUP BY x.a, y.b)" for i in range(6, 9))


@query(""", anchor AS (SELECT CAST(unnest([0, 77, 200]) AS BIGINT) AS anchor), far(s, node, d) USING KEY (s, node) AS (SELECT anchor, anchor, CAST(0 AS DOUBLE) FROM anchor
  UNION SELECT f.s, a.next, min(f.d + a.w0) FROM far f JOIN arcs a ON a.prev = f.node LEFT JOIN recurring.far k ON k.s = f.s AND k.node = a.next WHERE k.d IS NULL OR f.d + a.w0 < k.d GROUP BY f.s, a.next),
v AS (SELECT n.anchor, e.edge_id AS node, coalesce(CAST(1 AS DOUBLE) / (d.d + 1), 0) AS v FROM anchor n CROSS JOIN edges e LEFT JOIN far d ON d.s = n.anchor AND d.node = e.edge_id)
SELECT node, anchor, round((v - avg(v) OVER (PARTITION BY anchor)) / stddev_pop(v) OVER (PARTITION BY anchor), 9) AS value FROM v""", streets.SQL)
def anchor_features(spark, sf_dir):
    arcs = streets.arcs(spark, sf_dir)
    ends = streets.edges(spark, sf_dir).select(F.col("edge_id").alias("node"))
    sources = spark.createDataFrame([(0,), (77,), (200,)], "s long")
    found = blocks.BlockOracle(streets.places(spark, sf_dir)).distances_from(arcs, predict.length_metric(arcs), sources)
    d = tables.kept(found.select(F.col("s").alias("source"), "node", "distance"))
    return predict.anchor_features(d, ends).withColumn("value", F.round("value", 9))


@query()
def contract_graph(spark, sf_dir):
    _, sparse, cuts = shortcuts.contract_graph(streets.edges(spark, sf_dir), streets.arcs(spark, sf_dir), 0.5)
    return sparse.join(cuts.withColumn("shortcut", F.lit(True)), ["prev", "next"], "left").withColumn("shortcut", F.coalesce("shortcut", F.lit(False)))


# Shortcuts in SQL: edges that are divisible by 3 are active, and every pair of neighbours that trips have is mined.
SC = """, kept AS (SELECT *, lead(pos) OVER (PARTITION BY k ORDER BY pos) AS np, lead(edge_id) OVER (PARTITION BY k ORDER BY pos) AS ne FROM trip WHERE edge_id % 3 = 0),
gap AS (SELECT k, pos, np, edge_id AS src, ne AS dst FROM kept WHERE np > pos + 1),
obs AS (SELECT g.k, g.pos, g.src, g.dst, string_agg(lpad(CAST(t.edge_id AS VARCHAR), 3, '0'), ',' ORDER BY t.pos) AS path FROM gap g JOIN trip t ON t.k = g.k AND t.pos BETWEEN g.pos AND g.np GROUP BY g.k, g.pos, g.src, g.dst),
var AS (SELECT src, dst, path, count(*) AS n FROM obs GROUP BY src, dst, path)"""


def _mined(spark, sf_dir):
    trips = _good(spark, sf_dir)
    active = _edges(spark).where("edge_id % 3 = 0").select(F.col("edge_id").alias("edge"))
    pairs = active.select(F.col("edge").alias("prev")).crossJoin(F.broadcast(active.select(F.col("edge").alias("next"))))  # 86 edges
    return trips, active, shortcuts.observations(trips, active, pairs)


PATH_TEXT = "array_join(transform(path, x -> lpad(cast(x as string), 3, '0')), ',')"


@query(SC + " SELECT src, dst, path, n FROM var")
def shortcut_observations(spark, sf_dir):
    return _mined(spark, sf_dir)[2].withColumn("path", F.expr(PATH_TEXT))


@query(SC + """, el AS (SELECT src, dst, path, n, unnest(string_split(path, ',')) AS e FROM var), de AS (SELECT DISTINCT src, dst, path, n, e FROM el),
mass AS (SELECT src, dst, e, sum(n) AS m FROM de GROUP BY src, dst, e),
score AS (SELECT d.src, d.dst, d.path, sum(m.m) AS total, count(*) AS size FROM de d JOIN mass m ON d.src = m.src AND d.dst = m.dst AND d.e = m.e GROUP BY d.src, d.dst, d.path),
best AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY round(CAST(total AS DOUBLE) / size, 9) DESC, path) AS r FROM score)
SELECT b.src, b.dst, b.path, CAST(sum(v.n) AS BIGINT) AS observations, count(*) AS variants FROM best b JOIN var v ON v.src = b.src AND v.dst = b.dst WHERE b.r = 1 GROUP BY b.src, b.dst, b.path""")
def sc1_medoid(spark, sf_dir):
    return shortcuts.medoids(_mined(spark, sf_dir)[2]).withColumn("path", F.expr(PATH_TEXT))


@query(" SELECT 'order:' || k AS sample_id, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY pos) AS edges FROM trip WHERE edge_id % 3 = 0 GROUP BY k HAVING count(*) >= 2")
def sparse_trip_filter(spark, sf_dir):
    trips, active, _ = _mined(spark, sf_dir)
    return shortcuts.sparse_trips(trips.select("sample_id", "edges"), active).select("sample_id", F.array_join("edges", ",").alias("edges"))


@query()
def shortcut_expand(spark, sf_dir):
    trips, active, found = _mined(spark, sf_dir)
    routes = shortcuts.sparse_trips(trips.select("sample_id", "edges"), active)
    return shortcuts.expand(routes, _arcs(spark), shortcuts.medoids(found)).select("sample_id", F.array_join("edges", ",").alias("edges"))


@query(FAR + SC + """ SELECT d.a AS src, d.b AS dst, CAST(d.w AS BIGINT) AS distance FROM d8 d
WHERE d.a % 3 = 0 AND d.b % 3 = 0 AND d.a <> d.b AND NOT EXISTS (SELECT 1 FROM var v WHERE v.src = d.a AND v.dst = d.b)""")
def shortcut_completion(spark, sf_dir):
    _, active, found = _mined(spark, sf_dir)
    arcs = _arcs(spark)
    pairs = active.select(F.col("edge").alias("prev")).crossJoin(F.broadcast(active.select(F.col("edge").alias("next"))))  # 86 edges
    lacking = shortcuts.missing(pairs.where("prev <> next"), shortcuts.medoids(found))
    return predict.reverse_next_hops(arcs, predict.length_metric(arcs), lacking).select("src", "dst", "distance")


# Lines made from orders: each seventh lacks a key, and so on; the fault is known from the order's key.
@query(" SELECT CASE o_orderkey % 8 WHEN 0 THEN 'wrong_keys' WHEN 1 THEN 'blank_line' WHEN 2 THEN 'id_not_a_string' WHEN 3 THEN 'bad_edge' WHEN 4 THEN 'too_few_edges' WHEN 5 THEN 'blank_id' WHEN 6 THEN 'not_an_object' ELSE 'accepted' END AS fault, count(*) AS n FROM orders GROUP BY 1")
def strict_jsonl_reject(spark, sf_dir):
    k = F.col("o_orderkey")
    i = F.concat(F.lit('"order:'), k, F.lit('"'))
    made = lambda name, edges: F.concat(F.lit('{"sample_id":'), name, F.lit(',"original_edge_ids":'), F.lit(edges), F.lit("}"))
    line = F.when(k % 8 == 0, F.concat(F.lit('{"sample_id":'), i, F.lit(',"original_edge_ids":[1,2],"more":1}'))).when(k % 8 == 1, " ").when(k % 8 == 2, made(k.cast("string"), "[1,2]")).when(k % 8 == 3, made(i, "[1,2.5]")).when(k % 8 == 4, made(i, "[1]")).when(k % 8 == 5, made(F.lit('" "'), "[1,2]")).when(k % 8 == 6, "[1,2]").otherwise(made(i, "[1,2]"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(line.alias("value"))
    return records.json_faults(rows, records.DATASET).groupBy(F.coalesce("fault", F.lit("accepted")).alias("fault")).agg(F.count("*").alias("n"))


@query(" SELECT CAST((extract(hour FROM ts) + 8) % 24 AS INTEGER) AS hour, count(*) AS n, count(*) FILTER (WHERE (extract(hour FROM ts) + 8) % 24 >= 22 OR (extract(hour FROM ts) + 8) % 24 < 5) AS night FROM events GROUP BY 1")
def time_bucket_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = archive.departure_hour(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return e.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(archive.in_bucket(hour, 22, 5)).alias("night"))


@query(", m AS (SELECT t.k, sum(e.length) * 100 AS metres, max(t.n) * 10 + t.k % 7 AS seconds FROM trip t JOIN edges e ON t.edge_id = e.edge_id GROUP BY t.k), v AS (SELECT k, k % 5 AS bucket, least(greatest(metres / seconds, 1.0), 33.33) AS v FROM m) SELECT bucket, count(*) AS n, round((sum(v) + 42 * (SELECT avg(v) FROM v)) / (count(*) + 42), 9) AS speed FROM v GROUP BY bucket")
def shrunk_speeds(spark, sf_dir):
    trips = _good(spark, sf_dir)
    length = _edges(spark).select(F.col("edge_id").alias("e"), "length")
    m = trips.select("k", F.size("edges").alias("n"), F.explode("edges").alias("e")).join(F.broadcast(length), "e").groupBy("k").agg((F.sum("length") * 100).alias("metres"), (F.max("n") * 10 + F.col("k") % 7).alias("seconds"))
    v = m.select((F.col("k") % 5).alias("bucket"), archive.speed(F.col("metres"), F.col("seconds")).alias("v"))
    mean = v.agg(F.avg("v").alias("mean"))
    return v.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("v").alias("s")).crossJoin(F.broadcast(mean)).select("bucket", "n", F.round(archive.shrunk(F.col("s"), F.col("n"), F.col("mean"), 42), 9).alias("speed"))


@query(" SELECT max(abs(greatest(round(w0 / 1000), 1.0) - w0 / 1000) / (w0 / 1000)) AS max_relative_error, sum(CASE WHEN round(w0 / 1000) = 0 THEN 1 ELSE 0 END)::BIGINT AS zero_weights FROM arcs", streets.SQL)
def quantization_diagnostics(spark, sf_dir):
    return archive.quantization_audit(streets.arcs(spark, sf_dir).withColumn("w0", F.col("w0") / 1000))


@query(OD + " SELECT CAST(sum(n) AS BIGINT) AS trips, CAST(coalesce(sum(CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.tail = od.src AND e.head = od.dst) THEN n ELSE 0 END), 0) AS BIGINT) AS exposed FROM od")
def zero_cost_audit(spark, sf_dir):
    return archive.zero_cost_exposure(stats.od_groups(_good(spark, sf_dir)), _edges(spark))


@query(PRED + """, ln AS (SELECT p.k, sum(e.length) AS pl FROM pset p JOIN edges e ON p.edge_id = e.edge_id GROUP BY p.k), lt AS (SELECT p.k, sum(e.length) AS tl FROM tset p JOIN edges e ON p.edge_id = e.edge_id GROUP BY p.k),
lb AS (SELECT a.k, sum(e.length) AS bl FROM tset a JOIN pset b ON a.k = b.k AND a.edge_id = b.edge_id JOIN edges e ON e.edge_id = a.edge_id GROUP BY a.k)
SELECT round(avg(coalesce(bl, 0) / pl), 9) AS precision, round(avg(coalesce(bl, 0) / tl), 9) AS recall FROM lt JOIN ln ON lt.k = ln.k LEFT JOIN lb ON lb.k = lt.k""")
def length_weighted_metrics(spark, sf_dir):
    lengths = F.broadcast(paths_lengths(spark))
    own = _metrics(spark, sf_dir).crossJoin(lengths)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + F.element_at("_len", (e + 1).cast("int")))
    t, p = F.col("truth"), F.col("predicted")
    both = total(F.array_intersect(t, p))
    return own.agg(F.round(F.avg(evaluate.ratio(both, total(F.array_distinct(p)))), 9).alias("precision"), F.round(F.avg(evaluate.ratio(both, total(F.array_distinct(t)))), 9).alias("recall"))


def paths_lengths(spark):
    """One row: lengths of all edges in id order."""
    return _edges(spark).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "length"))), lambda x: x["length"]).alias("_len"))


@query(", b AS (SELECT k % 5 AS bucket, avg(n) AS m, count(*) AS c FROM good GROUP BY k % 5) SELECT round(sum(m * c) / sum(c), 9) AS m FROM b")
def weighted_bucket_mean(spark, sf_dir):
    b = _good(spark, sf_dir).groupBy(F.col("k") % 5).agg(F.avg(F.size("edges")).alias("m"), F.count("*").alias("c"))
    return archive.weighted_mean(b, "m", "c").withColumn("m", F.round("m", 9))


@query(""", m AS (SELECT coord, prev, CASE WHEN coord % 97 = 3 THEN next - 1000000 ELSE next END AS next, CASE WHEN coord % 101 = 5 THEN 0 WHEN coord % 103 = 7 THEN CAST('nan' AS DOUBLE) ELSE w0 END AS weight FROM arcs),
o AS (SELECT *, lag(prev) OVER (ORDER BY coord) AS p, lag(next) OVER (ORDER BY coord) AS x FROM m)
SELECT coord FROM o WHERE weight <= 0 OR isnan(weight) OR p > prev OR (p = prev AND x >= next)""", streets.SQL)
def model_validation(spark, sf_dir):
    """A model of the network with weights and transitions that are out of order."""
    c = F.col("coord")
    model = streets.arcs(spark, sf_dir).select("coord", "prev", F.when(c % 97 == 3, F.col("next") - 1_000_000).otherwise(F.col("next")).alias("next"), F.when(c % 101 == 5, 0.0).when(c % 103 == 7, float("nan")).otherwise(F.col("w0")).alias("weight"))
    return validate.model_faults(model).select("coord")


@query(DIST + ENDS + " SELECT DISTINCT fe.s AS src, le.t AS dst, round(d5.w * (1 + le.t % 3 / CAST(2 AS DOUBLE)) / 1000, 6) AS distance FROM fe JOIN le ON fe.k = le.k JOIN d5 ON d5.a = fe.s AND d5.b = le.t")
def real_cost_distances(spark, sf_dir):
    """Each destination weighs all arcs by a factor of its own."""
    e, arcs = F.col("edges"), _arcs(spark)
    pairs = _good(spark, sf_dir).select(F.element_at(e, 1).alias("src"), F.element_at(e, -1).alias("dst")).distinct()
    costs = arcs.crossJoin(F.broadcast(_edges(spark).select(F.col("edge_id").alias("dst"))))  # 1,024 arcs, 256 edges
    costs = costs.select("dst", "coord", (F.col("w0") * (1 + F.col("dst") % 3 / 2) / 1000).alias("w"))
    return paths.real_cost_paths(arcs, costs, pairs).select("src", "dst", F.round("distance", 6).alias("distance"))


@query(""", q AS (SELECT k, max(CASE WHEN pos = 1 THEN edge_id END) AS s, max(CASE WHEN pos = n THEN edge_id END) AS t FROM trip GROUP BY k)
SELECT k AS qid, CASE WHEN k % 11 = 0 THEN 'empty' WHEN s >= 250 OR t >= 250 THEN 'out_of_range' ELSE 'nonzero_offset' END AS fault FROM q WHERE k % 11 = 0 OR s >= 250 OR t >= 250 OR k % 7 = 0""")
def endpoint_validation(spark, sf_dir):
    """Ends of trips in a network said to have 250 nodes; some queries lack targets or start within an edge."""
    k, e = F.col("k"), F.col("edges")
    at = lambda node, offset: F.array(F.struct(node.alias("node"), offset.cast("long").alias("offset")))
    last = at(F.element_at(e, -1), F.lit(0))
    asked = _good(spark, sf_dir).select(k.alias("qid"), at(F.element_at(e, 1), (k % 7 == 0).cast("int")).alias("sources"), F.when(k % 11 == 0, F.slice(last, 1, 0)).otherwise(last).alias("targets"))
    return validate.endpoint_faults(asked, 250)


@query(""", a AS (SELECT coord, prev, CASE WHEN coord % 31 = 0 THEN next + 1 ELSE next END AS next, CASE WHEN coord % 10 = 0 THEN w0 + 1 ELSE w0 END AS initial FROM arcs WHERE coord % 97 <> 0 UNION ALL SELECT 2000000000, 1, 2, 1)
SELECT coalesce(g.coord, a.coord) AS coord, CASE WHEN g.coord IS NULL THEN 'unknown' WHEN a.coord IS NULL THEN 'missing' WHEN a.next <> g.next THEN 'transition' ELSE 'baseline' END AS fault
FROM arcs g FULL JOIN a ON g.coord = a.coord WHERE g.coord IS NULL OR a.coord IS NULL OR a.next <> g.next OR a.initial <> g.w0""", streets.SQL)
def artifact_validation(spark, sf_dir):
    """A damaged artifact of the derived network against its line graph."""
    arcs, c = streets.arcs(spark, sf_dir), F.col("coord")
    made = arcs.where(c % 97 != 0).select("coord", "prev", F.when(c % 31 == 0, F.col("next") + 1).otherwise(F.col("next")).alias("next"), F.when(c % 10 == 0, F.col("w0") + 1).otherwise(F.col("w0")).alias("initial"))
    more = spark.createDataFrame([(2_000_000_000, 1, 2, 1.0)], "coord long, prev long, next long, initial double")
    return validate.artifact_faults(arcs, made.unionByName(more))


def _attempts(spark, sf_dir):
    """Each order is an attempt at its customer's task; some are lost."""
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("task"), k.alias("attempt"), F.col("o_totalprice").alias("wall"), (F.col("o_totalprice") / 2).alias("user"), (F.col("o_totalprice") / 8).alias("system"), (k % 1000).alias("peak_kib"), (k % 3).cast("int").alias("exit"), (k % 13 == 0).alias("lost"))


@query(""", t AS (SELECT o_custkey AS task, o_orderkey AS a, o_totalprice AS w, o_orderkey % 13 = 0 AS lost, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders),
s AS (SELECT task, count(*) AS attempts, count(*) FILTER (WHERE lost) AS lost_attempts, coalesce(sum(w) FILTER (WHERE NOT lost), 0) AS known, max(w) FILTER (WHERE last AND NOT lost) AS final, max(a % 1000) FILTER (WHERE NOT lost) AS peak_kib, CAST(max(a % 3) FILTER (WHERE last AND NOT lost) AS INTEGER) AS exit FROM t GROUP BY task)
SELECT task, attempts, lost_attempts, lost_attempts = 0 AS timing_complete, CASE WHEN lost_attempts = 0 THEN round(known, 2) END AS wall, round(known, 2) AS known_wall, round(final, 2) AS final_wall, round(known - coalesce(final, 0), 2) AS wasted, round(known / 2, 4) AS "user", round(known / 8, 6) AS system, peak_kib, exit FROM s""")
def attempt_timing(spark, sf_dir):
    found = reports.attempt_timing(_attempts(spark, sf_dir))
    return found.withColumns({c: F.round(c, d) for c, d in (("wall", 2), ("known_wall", 2), ("final_wall", 2), ("wasted", 2), ("user", 4), ("system", 6))})


@query(" SELECT count(*) AS samples, round(avg(o_totalprice), 6) AS mean_seconds, round(count(*) / sum(o_totalprice), 12) AS per_second, round(avg(o_totalprice / 2), 6) AS mean_user, round(sum(o_totalprice / 2), 2) AS sum_user FROM orders")
def prediction_throughput(spark, sf_dir):
    found = reports.throughput(_attempts(spark, sf_dir).withColumnRenamed("wall", "seconds"), ["user"])
    return found.withColumns({c: F.round(c, d) for c, d in (("mean_seconds", 6), ("per_second", 12), ("mean_user", 6), ("sum_user", 2))})


@query(""", s AS (SELECT k % 5 AS run, k // 500 AS shard, count(*) AS n, sum(n) AS seconds FROM good GROUP BY 1, 2), w AS (SELECT run, shard, sum(n) OVER r AS done, sum(n) OVER (PARTITION BY run) AS total, sum(seconds) OVER r AS spent FROM s WINDOW r AS (PARTITION BY run ORDER BY shard))
SELECT run, shard, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total, round(CAST(done AS DOUBLE) / total, 9) AS share, round(CAST(spent AS DOUBLE) / done * (total - done), 6) AS remaining FROM w""")
def shard_progress(spark, sf_dir):
    shards = _good(spark, sf_dir).groupBy((F.col("k") % 5).alias("run"), F.expr("k div 500").alias("shard")).agg(F.count("*").alias("n"), F.sum(F.size("edges")).alias("seconds"))
    return reports.progress(shards).withColumns({"share": F.round("share", 9), "remaining": F.round("remaining", 6)})


@query(" SELECT k, n FROM good ORDER BY k LIMIT 100")
def latency_sample(spark, sf_dir):
    """The hundred trips whose prediction would be timed; the limit is the feature."""
    return reports.latency_sample(_good(spark, sf_dir).select("k", F.size("edges").cast("long").alias("n")), 100, "k")


@query(" SELECT k % 5 AS bucket, count(*) AS n, round(quantile_cont(CAST(n * 10 + k % 7 AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(n * 10 + k % 7 AS DOUBLE), 0.9), 6) AS p90, round(quantile_cont(CAST(n * 10 + k % 7 AS DOUBLE), 0.99), 6) AS p99 FROM good GROUP BY 1")
def trip_durations(spark, sf_dir):
    own = _good(spark, sf_dir).select((F.col("k") % 5).alias("bucket"), (F.size("edges") * 10 + F.col("k") % 7).alias("seconds"))
    found = reports.percentiles(own, "seconds", {"median": 0.5, "p90": 0.9, "p99": 0.99}, ["bucket"])
    return found.withColumns({c: F.round(c, 6) for c in ("median", "p90", "p99")})


@query(PRED + """, g AS (SELECT k % 4 AS model, k % 7 AS epoch, round(avg(exact_match), 2) AS accuracy, round(1 - avg(edge_f1), 2) AS loss FROM scored GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, loss, epoch) AS r FROM g) SELECT model, epoch, accuracy, loss FROM r WHERE r = 1""")
def checkpoint_choice(spark, sf_dir):
    own = _metrics(spark, sf_dir).withColumn("k", F.split_part("sample_id", F.lit(":"), F.lit(2)).cast("long"))
    g = own.groupBy((F.col("k") % 4).alias("model"), (F.col("k") % 7).alias("epoch")).agg(F.round(F.avg("exact_match"), 2).alias("accuracy"), F.round(1 - F.avg("edge_f1"), 2).alias("loss"))
    return reports.chosen_checkpoint(g, ["model"])


@query(", x AS (SELECT CAST(k % 41 - 20 AS DOUBLE) AS x, k % 2 AS y, 1 + k % 3 AS w FROM good) SELECT round(avg(w * (greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))), 6) AS loss FROM x")
def candidate_loss(spark, sf_dir):
    k = F.col("k")
    return _good(spark, sf_dir).agg(F.round(F.avg(scalar.weighted_bce((k % 41 - 20).cast("double"), k % 2, 1 + k % 3)), 6).alias("loss"))
