"""Source divergence audit: how far each source's words lie from its language's and from other sources', by relations.

Regexp matches are exploded and counted by group; groups meet the kept vocabulary, so that absent terms count as zero;
the dense table is joined with itself on language and term, summed and ranked.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop

#: What parts terms: ASCII but letters. The pieces between its matches are the matches of its complement, and splitting
#: takes time in proportion to the text, which Spark's extraction of all matches doesn't.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: A language's groups are dealt to so many tasks by term when they meet its vocabulary.
SALTS = 64


def _share(count: Column, total: Column, terms: Column, prior: int) -> Column:
    """1 + floor(SCALE * (count + prior) / (total + prior * terms)), in exact decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + prior)
    bottom = wide(total) + F.lit(prior) * wide(terms)
    return F.lit(1) + F.call_function("div", top, bottom)


def lowered(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased. What is ASCII goes by Spark's lower, which is several times as quick as a translation."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(l, g, term, n) of kept terms and (l, g, lang, source) of all groups, written to the shared folder.

    ``l`` and ``g`` are hashes of language and group, narrower keys than their names; two of one hash are an error.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    keys = F.xxhash64("lang").alias("l"), F.xxhash64("lang", "source").alias("g")
    groups = rows.select("lang", "source").distinct().select(*keys, "lang", "source")
    groups = groups.withColumns({"_g": F.count("*").over(Window.partitionBy("g")), "_l": F.min("lang").over(Window.partitionBy("l"))})
    clash = F.raise_error(F.concat(F.lit("two groups share a hash: "), "lang", F.lit(" "), "source")).cast("long")
    groups = cut(groups.select("l", F.when((F.col("_g") == 1) & (F.col("_l") == F.col("lang")), F.col("g")).otherwise(clash).alias("g"), "lang", "source"))

    # In a sorted row the first of equal terms counts its document, so that one pass and one shuffle give both sums.
    terms = rows.select(*keys, F.sort_array(F.split(lowered(F.col("text")), BETWEEN)).alias("t"))
    seen = terms.select("l", "g", "t", F.posexplode("t").alias("pos", "term")).where("term <> ''")
    first = (F.col("pos") == 0) | (F.get("t", F.col("pos") - 1) != F.col("term"))
    seen = seen.select("l", "g", "term", first.cast("long").alias("first"))
    sums = cut(seen.groupBy("l", "g", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs")))
    kept = sums.groupBy("l", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("l", "term")
    found = cut(sums.join(kept, ["l", "term"]).select("l", "g", "term", "n"))
    drop(sums)
    return found, groups


def divergence(docs: DataFrame, least: int = 30, prior: int = 5, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks a group's other sources, part ``term`` its own terms.

    ``docs`` has text, lang and source; nulls count as ''. A term is kept in a language in which at least ``least`` of
    its documents hold it. A group's share of a term is smoothed by ``prior``. A pair's value is the sum of the absolute
    differences of shares over all kept terms; a term's is how far the group's share lies above the language's, for terms
    that occur in the group, the ``top`` first. Ties go by the item in UTF-8 order. Groups without terms have pairs; a
    language of one source has none. Repeated rows count each; texts are read whole. Other columns are not read, and an
    empty table gives no rows.
    """
    counts, groups = counted(docs, least)
    by_lang = cut(counts.groupBy("l", "term").agg(F.sum("n").alias("lang_n")))
    sizes = by_lang.groupBy("l").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    own = groups.select("l", "g").join(totals, "g", "left").join(sizes, "l", "left")
    own = own.select("l", "g", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")))

    # Groups x vocabulary: a language's groups go to each salt, its terms to one, so that no task holds a language.
    salted = own.where("v > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    vocabulary = by_lang.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    grid = vocabulary.join(salted, ["l", "salt"]).drop("salt").join(counts, ["l", "g", "term"], "left")
    n = F.coalesce("n", F.lit(0))
    dense = cut(grid.select("l", "g", "term", n.alias("n"), _share(n, F.col("total"), F.col("v"), prior).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"), prior).alias("q")))

    # Each pair is summed once, from the smaller hash, and then told from both sides.
    a = dense.select("l", "term", "g", "p")
    b = dense.select("l", "term", F.col("g").alias("other"), F.col("p").alias("p2"))
    sums = a.join(b, ["l", "term"]).where("g < other").groupBy("g", "other").agg(F.sum(F.abs(F.col("p") - F.col("p2"))).alias("value"))
    bare = own.where("v = 0").select("l", "g")
    alone = bare.join(bare.withColumnRenamed("g", "other"), "l").where("g < other").select("g", "other", F.lit(0).cast("long").alias("value"))
    half = sums.unionByName(alone)
    pairs = half.union(half.select("other", "g", "value"))
    pairs = pairs.join(groups.select(F.col("g").alias("other"), F.col("source").alias("item")), "other").select("g", F.lit("pair").alias("part"), "item", "value")
    terms = dense.where("n > 0 and p > q").select("g", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).union(terms.withColumn("rank", place).where(F.col("rank") <= top))
    return ranked.join(groups.select("g", "lang", "source"), "g").select("lang", "source", "part", "item", "value", "rank")


def divergence_query(spark, sf_dir: str) -> DataFrame:
    """op12: all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


DIVERGENCE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
words AS (SELECT k, lang, source, unnest(t) AS term FROM rows),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
groups AS (SELECT DISTINCT lang, source FROM rows),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM dense),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM summed),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
told AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
