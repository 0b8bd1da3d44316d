"""Shards cut from a Hilbert curve over document metadata. DataFrame functions only.

Source, language and size are quantised to 32 levels each by their cumulative share of rows, a curve index orders the
cells, and equal runs of that order are the shards, so that a shard spans a compact box of all three dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SHARDS, BITS = 8, 5


def hilbert(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """``df`` with the Hilbert index of ``dims`` (integers below 2^bits each) as ``out``.

    The axes are turned to the transposed index bit by bit with shifts and exclusive ors, each step a projection.
    """
    n, x = len(dims), [f"_h{i}" for i in range(len(dims))]
    now = df.withColumns({x[i]: F.col(d).cast("int") for i, d in enumerate(dims)})
    one = lambda c, q: F.col(c).bitwiseAND(F.lit(q)) != 0
    xor = lambda a, b: a.bitwiseXOR(b)
    for bit in range(bits - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(n):
            first = F.col(x[0])
            if i == 0:
                now = now.withColumn(x[0], F.when(one(x[0], q), xor(first, F.lit(p))).otherwise(first))
                continue
            swap = xor(first, F.col(x[i])).bitwiseAND(F.lit(p))
            now = now.withColumn("_s", F.when(one(x[i], q), F.lit(0)).otherwise(swap)).withColumn(x[0], F.when(one(x[i], q), xor(F.col(x[0]), F.lit(p))).otherwise(xor(F.col(x[0]), F.col("_s")))).withColumn(x[i], xor(F.col(x[i]), F.col("_s")))
    for i in range(1, n):
        now = now.withColumn(x[i], xor(F.col(x[i]), F.col(x[i - 1])))
    flip = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        flip = xor(flip, F.when(one(x[n - 1], 1 << bit), F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    now = now.withColumn("_s", flip)
    for i in range(n):
        now = now.withColumn(x[i], xor(F.col(x[i]), F.col("_s")))
    index = F.lit(0).cast("long")
    for bit in range(bits):
        for i in range(n):
            index = index + F.shiftleft(F.shiftright(F.col(x[i]), bit).bitwiseAND(F.lit(1)).cast("long"), bit * n + n - 1 - i)
    return now.withColumn(out, index).drop(*x, "_s")


def ranked(df: DataFrame, order: list, out: str, weight=None) -> DataFrame:
    """``df`` with its gapless rank (or the sum of ``weight`` before it) in a total order, without one task for all rows.

    Rows are dealt by range; a row's place is its place in its part plus what the parts before it hold. The parts are
    written first: which rows a part has would otherwise change if a lost one were computed again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    dealt = cut(df.withColumns(keys | {"_w": w}).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("_w").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row for each part
    inner = F.sum("_w").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return dealt.withColumn("_in", inner).join(F.broadcast(before), "_part").withColumn(out, F.col("_in") + F.col("_before")).drop(*keys, "_w", "_part", "_in", "_before")


def _levels(df: DataFrame, column: str, total: int, bits: int) -> DataFrame:
    """(column, level): values in order, dealt to 2^bits levels by the rows before their middle; null comes last."""
    counts = df.groupBy(column).agg(F.count("*").alias("_c"))
    placed = ranked(counts, [F.col(column).isNull(), F.coalesce(F.col(column), F.lit(""))], "_lo", F.col("_c"))
    level = F.floor((F.col("_lo") + F.col("_c") / 2) * (1 << bits) / F.lit(max(total, 1)))
    return placed.select(F.col(column).alias("_v"), F.least(level, F.lit((1 << bits) - 1)).cast("int").alias(f"{column}_level"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the levels and curve index of every document.

    Size is the text's UTF-8 bytes plus 1; a null text has size 1 and checksum 0. Shards differ by one row at most and
    slots of a shard count from 0. Equal texts stand together, with the source and language of the copy that comes
    first by (doc_id, source, lang): only the end of a run can part them. Rows of a cell are ordered by size, checksums
    and id; fully equal rows get places in any order. Null sources and languages have their level after all others,
    null ids come first. Texts of any length are described whole; other columns, whatever their names, are not
    read. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash")))
    same = ["size", "text_crc32", "text_hash"]
    # Only texts that recur are joined, with a row for each: so a text of very many copies is split among tasks.
    first = rows.groupBy(*same).agg(F.min(F.struct("doc_id", "source", "lang")).alias("f"), F.count("*").alias("c"))
    first = cut(first.where("c > 1").select(*same, "f"))
    own = [F.when(F.col("f").isNull(), F.col(c)).otherwise(F.col(f"f.{c}")).alias(c) for c in ("source", "lang")]
    base = cut(rows.join(first, same, "left").select("doc_id", *same, *own))
    total, ends = base.agg(F.count("*"), F.percentile_approx("size", [i / (1 << bits) for i in range(1, 1 << bits)], 10_000)).first()
    level = sum(((F.col("size") > e).cast("int") for e in ends or []), F.lit(0))
    out = base.withColumn("size_level", level)
    for column in ("source", "lang"):
        levels = _levels(base, column, total, bits)
        out = out.join(levels, out[column].eqNullSafe(levels["_v"])).drop("_v")
    out = hilbert(out, ["source_level", "lang_level", "size_level"], bits, "curve")
    out = ranked(out, [F.col(c) for c in ("curve", *same, "doc_id")], "_rank")
    shard = F.expr(f"_rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")  # of a shard, in exact integers
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - first).select("doc_id", "size", "text_crc32", "shard", "slot", "source_level", "lang_level", "size_level", "curve")


def shard_query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents in eight shards under the law ``rows``."""
    found = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rest = [c for c in found.columns if c not in ("doc_id", "size", "text_crc32", "shard", "slot")]
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *rest)
