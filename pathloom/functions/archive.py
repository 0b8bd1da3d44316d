"""Analytics over trips with times: departure hours, durations, speeds, shrinkage, quantisation and exposure audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"  # UTC+8 all year


def departure_hour(seconds: Column) -> Column:
    return F.hour(F.from_utc_timestamp(F.timestamp_seconds(seconds), ZONE))


def in_bucket(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in a half-open bucket, which may go past midnight."""
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def speed(metres: Column, seconds: Column) -> Column:
    """Metres a second, from 1 to 33.33; null without a duration."""
    return F.when(seconds > 0, F.least(F.greatest(metres / seconds, F.lit(1.0)), F.lit(33.33)))


def shrunk(total: Column, n: Column, prior: Column, k: float) -> Column:
    """A mean of n values drawn towards a prior that counts as k of them."""
    return (total + F.lit(k) * prior) / (n + F.lit(k))


def quantization_audit(arcs: DataFrame, weight: str = "w0") -> DataFrame:
    """One row: the greatest relative error of rounding, and weights that round to nothing."""
    w = F.col(weight)
    return arcs.agg(F.max(F.abs(F.greatest(F.round(w), F.lit(1.0)) - w) / w).alias("max_relative_error"), F.count_if(F.round(w) == 0).alias("zero_weights"))


def zero_cost_exposure(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: trips, and those between nodes that one edge joins, which cost nothing from node to node."""
    direct = edges.select(F.col("tail").alias("src"), F.col("head").alias("dst"), F.lit(1).alias("_d")).distinct()
    return groups.join(direct, ["src", "dst"], "left").agg(F.sum("n").alias("trips"), F.coalesce(F.sum(F.when(F.col("_d") == 1, F.col("n"))), F.lit(0)).alias("exposed"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))
