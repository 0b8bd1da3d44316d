"""Tables in the folder that all executors share, and rows dealt to the tables they ask for."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one key that a task takes at most when they meet the key's table.
CHUNK = 4096
#: Spark deletes the shuffle files of a query when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's checkpoint folder; a local one only with a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        found = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's (file system, path) of ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def kept(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet and read again: lost executors cost no recomputation. It goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathloom/{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")  # what was shuffled for the table goes as soon as it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)
    _MADE.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._kept_path = path
    return made


def forgotten(spark: SparkSession, path: str) -> None:
    """What is written to ``path`` goes when the program ends."""
    _MADE.append((spark, path))


def apart(df: DataFrame) -> DataFrame:
    """``df`` marked to be joined by a shuffle: a table with a row for each place or street, however small Spark takes it to be.

    What Spark goes by is the size of files, narrowed to the columns read and not widened where rows are exploded; a table
    that it takes to be small goes through the driver.
    """
    return df.hint("merge")


def drop(table: DataFrame) -> None:
    """Delete what ``kept`` wrote for ``table``, which nothing reads any more."""
    path = table.__dict__.get("_kept_path")
    if path:
        fs, target = file_system(table.sparkSession, path)
        fs.delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            fs, target = file_system(spark, path)
            fs.delete(target, True)
        except Exception:  # the session may have ended already
            return


def meet(rows: DataFrame, tables: DataFrame, key: str, by: str, run, schema: str) -> DataFrame:
    """``run(rows, table)`` for the rows of each ``key`` and its table, in tasks of about CHUNK rows dealt by ``by``.

    A key that very many rows ask for is dealt to many tasks, each with a copy of its table; tables that nothing asks for
    are left out. Keys without a table meet an empty one.
    """
    asked = rows.groupBy(key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    own = rows.join(asked, key).withColumn("_chunk", F.pmod(F.xxhash64(by), F.col("_chunks")).cast("int")).drop("_chunks")
    near = tables.join(asked, key).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    names = StructType.fromDDL(schema).names

    def some(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        return run(asked, table) if len(asked) else pd.DataFrame(columns=names)  # a chunk may have no rows

    return own.groupBy(key, "_chunk").cogroup(near.groupBy(key, "_chunk")).applyInPandas(some, schema)


def levels_for(n: int, leaf: int, bits: int) -> int:
    """How often ``n`` nodes are split 2^bits ways until a part has at most ``leaf``; at least once."""
    return max(1, math.ceil(math.log2(max(n / leaf, 1)) / bits))
