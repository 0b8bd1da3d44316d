"""Scalar functions of routes, records and reports, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interior(edges: Column) -> Column:
    """All but the first and the last element; empty for fewer than three."""
    return F.when(F.size(edges) > 2, F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))).otherwise(F.slice(edges, F.lit(1), F.lit(0)))


def joined(first: Column, second: Column) -> Column:
    """Two legs, the second without its first element."""
    return F.concat(first, F.slice(second, F.lit(2), F.greatest(F.size(second), F.lit(0))))


def padded(values: Column, size: int, fill: int = -1) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill).cast("long"), F.lit(size) - F.size(values)))


def replicated(value: Column, slots: int = 48) -> Column:
    return F.array_repeat(value, slots)


def place(values: Column, value: Column) -> Column:
    """Zero-based place of a value; null if it isn't there."""
    return F.nullif(F.array_position(values, value), F.lit(0)) - 1


def is_simple(edges: Column) -> Column:
    return F.size(F.array_distinct(edges)) == F.size(edges)


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9A-Fa-f]{64}$")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def checkpoint_number(name: Column) -> Column:
    """The number of ``checkpoint-N.json``; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^checkpoint-(\d+)\.json$", 1), F.lit("")).cast("long")


def at_key(document: Column, dotted: str) -> Column:
    """A nested value of a JSON document."""
    return F.get_json_object(document, "$." + dotted)


def duration_text(seconds: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``3s``; less than nothing is ``0s``."""
    s = F.round(seconds).cast("long")
    s = F.when(s < 0, F.lit(0)).otherwise(s)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %02ds", m, s % 60)).when(s.isNotNull(), F.format_string("%ds", s))


def iso_time(text: Column) -> Column:
    """The moment of an ISO 8601 text, of UTC where it names no zone; null for other texts."""
    zoned = F.when(text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(zoned))


def age_seconds(text: Column, now: Column | None = None) -> Column:
    """Seconds since an ISO 8601 text, at least 0; null for other texts."""
    now = F.current_timestamp() if now is None else now
    age = now.cast("double") - iso_time(text).cast("double")
    return F.when(age < 0, F.lit(0.0)).otherwise(age)


def weighted_bce(logit: Column, label: Column, weight: Column) -> Column:
    """Weighted binary cross-entropy of a logit, without overflow at either end."""
    return weight * (F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit))))


def percent(value: Column, digits: int = 2) -> Column:
    return F.coalesce(F.concat(F.format_number(value * 100, digits), F.lit("%")), F.lit("—"))


def interval_text(low: Column, high: Column, digits: int = 2) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.format_number(low * 100, digits), F.lit(", "), F.format_number(high * 100, digits), F.lit("]")), F.lit("—"))


def mebibytes(kib: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(kib / 1024, 1), F.lit(" MiB")), F.lit("—"))


def log_loss(score: str, group: list[str], legal: str | None = None) -> Column:
    """Negative log softmax of a score within its group; where ``legal`` is false a score counts as nothing."""
    x = F.col(score) if legal is None else F.when(F.col(legal), F.col(score))
    w = Window.partitionBy(*group)
    top = F.max(x).over(w)
    return -(x - top - F.log(F.sum(F.exp(x - top)).over(w)))


def standardised(value: str, group: list[str]) -> Column:
    """z-scores with the population's deviation."""
    w = Window.partitionBy(*group)
    return (F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w)


def summed_counters(rows: DataFrame, counters: str) -> DataFrame:
    """(key, n): maps of whole numbers summed by key."""
    return rows.select(F.explode(counters).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def range_faults(summary: DataFrame, metrics: list[str], count: str = "sample_count") -> DataFrame:
    """Rows of a summary with no samples or a metric that isn't finite and between 0 and 1."""
    bad = F.col(count) <= 0
    for m in metrics:
        bad = bad | F.col(m).isNull() | F.isnan(m) | ~F.col(m).between(0, 1)
    return summary.where(bad)


def changed_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names whose bytes differ, or that one side lacks, of two tables (name, sha256)."""
    a, b = left.select("name", F.col("sha256").alias("a")), right.select("name", F.col("sha256").alias("b"))
    return a.join(b, "name", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("name")
