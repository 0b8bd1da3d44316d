"""Temporal list join: URL captures against dated list entries that were active when each was fetched.

DataFrame functions only. Entries become validity intervals; the intervals that can concern a host are gathered by host,
not by capture, and every capture then looks for those that hold its fetch time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: The query's list: (pattern, action, date). A pattern is a domain with all below it, or a host and the start of a path.
ENTRIES = [
    ("casino-win.example.com", "add", "2020-03-01"),
    ("casino-win.example.com", "remove", "2021-06-15"),
    ("casino-win.example.com", "add", "2022-01-10"),
    ("cheap-pills.example.com", "add", "2019-11-20"),
    ("free-bets.example.com", "add", "2020-09-01"),
    ("free-bets.example.com", "remove", "2020-09-01"),
    ("free-bets.example.com", "add", "2021-02-01"),
    ("example.net", "add", "2021-01-01"),
    ("example.net", "remove", "2021-03-31"),
    ("blog.tionsh.example.com/en/", "add", "2020-05-05"),
    ("tiontion.example.net/en/", "add", "2022-07-01"),
    ("org", "add", "2023-11-01"),
]


def host_of(url):
    """The lower-cased host of a URL, without user, port and final dot; null if it has none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(F.rtrim(found, F.lit(".")) != "", F.rtrim(found, F.lit(".")))


def path_of(url):
    """What follows the host, from its first slash; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, start, stop) while a pattern is listed, from (pattern, action, date). Of one date's entries a removal wins; patterns don't tell cases apart."""
    one = entries.where("pattern is not null and date is not null").groupBy(F.lower("pattern").alias("pattern"), "date").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off"))
    stop = F.lead("date").over(Window.partitionBy("pattern").orderBy("date"))
    return one.withColumn("stop", stop).where("off = 0").select("pattern", F.col("date").alias("start"), "stop")


def filter_urls(captures: DataFrame, entries: DataFrame, key: str, url: str, at: str) -> DataFrame:
    """(key, host, at, active, blocked) of every capture: the sorted patterns that were listed at its time.

    URLs of any length are read whole; other columns of the captures, whatever their names, are not read. A null, empty or hostless URL and a null time match nothing. Repeated captures are judged one by one. An entry with
    a null pattern or date is left out; an action that isn't ``remove`` adds. An empty list blocks nothing.
    """
    rows = captures.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("_path"), F.col(at).alias(at))
    own = intervals(entries)
    own = own.withColumns({"suffix": F.split_part("pattern", F.lit("/"), F.lit(1)), "prefix": F.when(F.instr("pattern", "/") > 0, F.expr("substr(pattern, instr(pattern, '/'))"))})
    labels = F.split("host", r"\.")
    hosts = rows.where("host is not null").select("host").distinct()
    ends = hosts.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    near = ends.join(own, "suffix").where("prefix is null or host = suffix").groupBy("host").agg(F.collect_set(F.struct("pattern", "start", "stop", "prefix")).alias("_spans"))
    near = cut(near)  # a row for each host that the list can concern
    then = F.col(at)
    hit = F.filter("_spans", lambda s: (s["start"] <= then) & (s["stop"].isNull() | (then < s["stop"])) & (s["prefix"].isNull() | F.startswith(F.lower("_path"), s["prefix"])))
    active = F.coalesce(F.array_sort(F.array_distinct(F.transform(hit, lambda s: s["pattern"]))), F.array().cast("array<string>"))
    return rows.join(near, "host", "left").select(key, "host", at, active.alias("active")).withColumn("blocked", F.size("active") > 0)


def listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "pattern string, action string, date string").withColumn("date", F.col("date").cast("date"))


def url_query(spark, sf_dir: str) -> DataFrame:
    """op7: all pages; the fetch date, which the table lacks, follows from the page's id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr("date_add(date'2020-01-01', cast(pmod(page_id * 7919, 1500) as int))").alias("fetched"))
    found = filter_urls(pages, listed(spark), "page_id", "url", "fetched")
    return found.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), F.array_join("active", ",").alias("active"), "blocked")


_ROWS = ", ".join(f"('{p}', '{a}', DATE '{d}')" for p, a, d in ENTRIES)
URL_SQL = f"""
WITH entries(pattern, action, date) AS (VALUES {_ROWS}),
one AS (SELECT pattern, date, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS off FROM entries GROUP BY pattern, date),
spans AS (SELECT pattern, date AS start, lead(date) OVER (PARTITION BY pattern ORDER BY date) AS stop, off FROM one),
caps AS (
  SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#:]*)', 1) AS host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1) AS path,
         DATE '2020-01-01' + CAST((page_id * 7919) % 1500 AS INTEGER) AS fetched
  FROM pages),
hits AS (
  SELECT DISTINCT c.page_id, s.pattern FROM caps c JOIN spans s
  ON s.off = 0 AND s.start <= c.fetched AND (s.stop IS NULL OR c.fetched < s.stop)
  AND (CASE WHEN contains(s.pattern, '/') THEN starts_with(c.host || c.path, s.pattern)
            ELSE c.host = s.pattern OR c.host LIKE '%.' || s.pattern END))
SELECT c.page_id, c.host, CAST(CAST(c.fetched AS DATE) AS VARCHAR) AS fetched,
       coalesce(string_agg(h.pattern, ',' ORDER BY h.pattern), '') AS active, count(h.pattern) > 0 AS blocked
FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id
GROUP BY c.page_id, c.host, c.fetched
"""
