"""Operational reports: timing of attempts, throughput, progress, latency samples, chosen checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluate import best


def attempt_timing(attempts: DataFrame, task: str = "task") -> DataFrame:
    """One row a task from (task, attempt, wall, user, system, peak_kib, exit, lost); a null ``lost`` counts as false.

    A lost attempt has no times: it makes the total wall time null, and what is known is a lower bound. ``wasted`` is the
    time of all attempts but the last, of what is known.
    """
    lost = F.coalesce("lost", F.lit(False))
    known = lambda c: F.when(~lost, F.col(c))
    sums = attempts.groupBy(task).agg(
        F.count("*").alias("attempts"), F.count_if(lost).alias("lost_attempts"), F.coalesce(F.sum(known("wall")), F.lit(0.0)).alias("known_wall"), F.coalesce(F.sum(known("user")), F.lit(0.0)).alias("user"),
        F.coalesce(F.sum(known("system")), F.lit(0.0)).alias("system"), F.max(known("peak_kib")).alias("peak_kib"), F.max_by(F.struct(known("wall").alias("wall"), known("exit").alias("exit")), "attempt").alias("last"),
    )
    whole = F.col("lost_attempts") == 0
    return sums.select(task, "attempts", "lost_attempts", whole.alias("timing_complete"), F.when(whole, F.col("known_wall")).alias("wall"), "known_wall", F.col("last.wall").alias("final_wall"), (F.col("known_wall") - F.coalesce("last.wall", F.lit(0.0))).alias("wasted"), "user", "system", "peak_kib", F.col("last.exit").alias("exit"))


def throughput(timings: DataFrame, components: list[str], seconds: str = "seconds") -> DataFrame:
    """One row: samples, mean seconds, samples a second (null without time), mean and sum of each component."""
    parts = [f(c).alias(f"{name}_{c}") for c in components for name, f in (("mean", F.avg), ("sum", F.sum))]
    return timings.agg(F.count(seconds).alias("samples"), F.avg(seconds).alias("mean_seconds"), F.when(F.sum(seconds) > 0, F.count(seconds) / F.sum(seconds)).alias("per_second"), *parts)


def progress(shards: DataFrame, run: str = "run", order: str = "shard") -> DataFrame:
    """Running totals over a run's finished shards (n, seconds): done, total, share, seconds that remain at this pace.

    A run's shards are a plan's rows, not its samples; they are few.
    """
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done, spent, total = F.sum("n").over(w), F.sum("seconds").over(w), F.sum("n").over(Window.partitionBy(run))
    return shards.select(run, order, done.alias("done"), total.alias("total"), (done / F.nullif(total, F.lit(0))).alias("share"), (spent / F.nullif(done, F.lit(0)) * (total - done)).alias("remaining"))


def latency_sample(samples: DataFrame, size: int, order: str = "sample_id") -> DataFrame:
    """The first ``size`` samples in order, whose latency is measured; a top-k, so that no task sorts them all."""
    if size < 1:
        raise ValueError("a latency sample needs a row")
    return samples.orderBy(order).limit(size)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, a column for each name of ``shares``; nulls don't count."""
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), *(F.percentile(F.col(value).cast("double"), F.lit(q)).alias(name) for name, q in shares.items()))


def chosen_checkpoint(evaluations: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The checkpoint (epoch, accuracy, loss) of the highest accuracy, then the least loss, then the earliest."""
    return best(evaluations, [-F.col("accuracy"), F.col("loss"), F.col("epoch")], group)


def method_faults(expected: list[str], found: list[str]) -> list[str]:
    """What keeps two lists of methods from being the same in the same order."""
    faults = [f"missing {m}" for m in expected if m not in found] + [f"extra {m}" for m in found if m not in expected]
    faults += [f"repeated {m}" for m in sorted({m for m in found if found.count(m) > 1})]
    return faults or (["another order"] if expected != found else [])
