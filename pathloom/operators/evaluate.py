"""Evaluation of predicted routes: strict alignment, route metrics, intervals, validity, summaries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ["exact_match", "edge_precision", "edge_recall", "edge_f1", "edge_jaccard"]


def misaligned(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, kind): duplicate, extra and missing ids of predictions against the truth."""
    twice = lambda df, kind: df.groupBy("sample_id").count().where("count > 1").select("sample_id", F.lit(kind).alias("kind"))
    extra = predictions.select("sample_id").distinct().join(truth, "sample_id", "left_anti").select("sample_id", F.lit("extra").alias("kind"))
    missing = truth.select("sample_id").distinct().join(predictions, "sample_id", "left_anti").select("sample_id", F.lit("missing").alias("kind"))
    return twice(truth, "duplicate_truth").union(twice(predictions, "duplicate_prediction")).union(extra).union(missing)


def align(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, truth, predicted), one row for each id; anything but a one-to-one match is an error when it runs.

    Both sides meet in one grouped shuffle that also counts them, so predictions are made once.
    """
    none = F.lit(None).cast("array<long>")
    left = truth.select("sample_id", F.col("edges").alias("truth"), none.alias("predicted"), F.lit(1).alias("t"), F.lit(0).alias("p"))
    right = predictions.select("sample_id", none.alias("truth"), F.col("edges").alias("predicted"), F.lit(0).alias("t"), F.lit(1).alias("p"))
    own = left.union(right).groupBy("sample_id").agg(F.first("truth", ignorenulls=True).alias("truth"), F.first("predicted", ignorenulls=True).alias("predicted"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    fault = F.when(F.col("t") == 0, "extra").when(F.col("p") == 0, "missing").when((F.col("t") > 1) | (F.col("p") > 1), "duplicate")
    sure = F.when(fault.isNull(), F.col("truth")).otherwise(F.raise_error(F.concat(fault, F.lit(" id "), "sample_id")).cast("array<long>"))
    return own.select("sample_id", sure.alias("truth"), "predicted")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 if b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def route_metrics(aligned: DataFrame) -> DataFrame:
    """``aligned`` with the metrics of each route: sets of edges for all but the exact match. Empty sides count as 0."""
    t, p = F.col("truth"), F.col("predicted")
    both = F.size(F.array_intersect(t, p))
    out = aligned.withColumns({"exact_match": (t == p).cast("double"), "edge_precision": ratio(both, F.size(F.array_distinct(p))), "edge_recall": ratio(both, F.size(F.array_distinct(t))), "edge_jaccard": ratio(both, F.size(F.array_union(t, p)))})
    s = F.col("edge_precision") + F.col("edge_recall")
    out = out.withColumn("edge_f1", F.when(s == 0, F.lit(0.0)).otherwise(2 * F.col("edge_precision") * F.col("edge_recall") / s))
    fails = F.coalesce((F.get(p, F.lit(0)) != F.get(t, F.lit(0))) | (F.get(p, F.size(p) - 1) != F.get(t, F.size(t) - 1)), F.lit(True))
    return out.withColumn("endpoint_failure", fails.cast("double"))


def macro(metrics: DataFrame) -> DataFrame:
    """One row: routes and the unweighted mean of each metric."""
    return metrics.agg(F.count("*").alias("sample_count"), *(F.avg(m).alias(m) for m in METRICS))


def interval(metrics: DataFrame, columns: list[str], level: float = 0.95, clamp: bool = True) -> DataFrame:
    """(metric, n, mean, se, low, high) of each column: a normal interval from the sample variance; two rows at least.

    Rows are reduced to counts, means and deviations before the columns are turned into rows.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    sums = metrics.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns))
    rows = sums.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"m_{c}").alias("mean"), (F.col(f"s_{c}") / F.sqrt("n")).alias("se")) for c in columns))).alias("r")).select("r.metric", "n", "r.mean", "r.se")
    low, high = F.col("mean") - z * F.col("se"), F.col("mean") + z * F.col("se")
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    n = F.when(F.col("n") >= 2, F.col("n")).otherwise(F.raise_error(F.lit("an interval needs two routes")).cast("long"))
    return rows.select("metric", n.alias("n"), "mean", "se", low.alias("low"), high.alias("high"))


def paired_interval(method: DataFrame, reference: DataFrame, columns: list[str], level: float = 0.95) -> DataFrame:
    """Intervals of the differences method - reference of routes with the same id; not clamped."""
    a = method.select("sample_id", *(F.col(c).alias(f"a_{c}") for c in columns))
    b = reference.select("sample_id", *(F.col(c).alias(f"b_{c}") for c in columns))
    return interval(a.join(b, "sample_id").select(*((F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in columns)), columns, level, clamp=False)


def endpoint_failures(metrics: DataFrame) -> DataFrame:
    """One row: routes, those whose first or last edge is wrong, and their share."""
    return metrics.agg(F.count("*").alias("routes"), F.sum("endpoint_failure").cast("long").alias("failures"), F.avg("endpoint_failure").alias("rate"))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct ids that two splits share."""
    return left.select("sample_id").distinct().join(right, "sample_id", "left_semi").agg(F.count("*").alias("shared"))


def validity(routes: DataFrame, arcs: DataFrame, rows: int = 0) -> DataFrame:
    """One row of counts over (sample_id, edges, src, dst): empties, wrong ends, illegal transitions, repeated edges."""
    from .graph import steps

    bad = steps(routes, arcs, rows).where("coord is null").groupBy("sample_id").agg(F.count("*").alias("bad"))
    e = F.col("edges")
    own = routes.join(bad, "sample_id", "left")
    count = lambda c: F.count_if(c)
    return own.agg(F.count("*").alias("routes"), count(F.size(e) == 0).alias("empty"), count((F.size(e) > 0) & (F.get(e, F.lit(0)) != F.col("src"))).alias("source_mismatch"), count((F.size(e) > 0) & (F.get(e, F.size(e) - 1) != F.col("dst"))).alias("destination_mismatch"), count(F.col("bad").isNotNull()).alias("illegal_routes"), F.coalesce(F.sum("bad"), F.lit(0)).alias("illegal_transitions"), count(F.size(F.array_distinct(e)) < F.size(e)).alias("non_simple"), F.sum(F.size(e) - F.size(F.array_distinct(e))).cast("long").alias("repeated"))


def best(candidates: DataFrame, by: list[Column], group: list[str] | None = None) -> DataFrame:
    """The best row of each group in an order that has no ties left, by a grouped minimum."""
    row = F.struct(*[F.col(c) for c in candidates.columns])
    keys = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)])
    top = candidates.groupBy(*(group or [])).agg(F.min_by(row, keys).alias("r"))
    return top.select("r.*")


def shard_plan(samples: DataFrame, size: int, order: str = "sample_id") -> DataFrame:
    """(shard, first, last, n): runs of ``size`` ids in order. Places come from counts of ranges, not from one sort task."""
    n = samples.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = samples.select(order).repartitionByRange(int(n), order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(order)
    local = dealt.withColumn("_i", F.row_number().over(w) - 1).persist()
    before = local.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    placed = local.join(F.broadcast(before), "_p").withColumn("shard", F.floor((F.col("_i") + F.col("_b")) / size))
    return placed.groupBy("shard").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def method_summary(parts: list[DataFrame], required: list[str]) -> DataFrame:
    """One row for each method from tables that hold some of the columns; status tells how many of ``required`` are known."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    own = out.groupBy("method").agg(*(F.max(c).alias(c) for c in required))
    known = sum((F.col(c).isNotNull().cast("int") for c in required), F.lit(0))
    return own.withColumn("status", F.when(known == 0, "pending").when(known < len(required), "partial").otherwise("complete"))
