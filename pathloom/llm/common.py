"""Shared pieces: cutting lineage in shared storage, connected components, small checks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._pathloom_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Remove what ``cut`` wrote for frames that nothing will read again."""
    for df in frames:
        path = getattr(df, "_pathloom_path", None)
        if path:
            _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended already
            return


def release() -> None:
    """Give free memory of this process back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


_HELD: dict = {}


def held(key, make: Callable[[], object]):
    """What a Python worker keeps for the step that it is at: one value at a time, made anew for another key.

    Workers are used again by later steps; the vocabularies and word caches of several would add up in their memory.
    """
    if _HELD.get("key") != key:
        _HELD.clear()
        release()
        _HELD.update(key=key, value=make())
    return _HELD["value"]


def forget() -> None:
    """Let go of what an earlier step of this Python worker held; a step that holds nothing says so here."""
    if _HELD:
        _HELD.clear()
        release()


@contextmanager
def short_batches(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` at most for what is run inside: a batch of texts lies in the JVM's buffers, which it keeps, and again in the Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trimmed(run: Callable) -> Callable:
    """``run``, a function of two tables, and then what it took of this Python worker's memory is given back: idle workers count beside later steps."""

    def then(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release()
        return out

    return then


def free_names(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hash_bucket(doc_id: str, mod: int):
    """crc32 of the id's text, modulo ``mod``: the folds that the contracts name."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


#: Links that one task joins, 16 bytes each; more are joined by rounds on the cluster.
FEW_LINKS = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the links (u, v), by joining them one after the other."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(u, v) links, no ends null, to (node, component), component being the smallest node of each connected part.

    At most ``few`` links are joined in one task. Others go through alternating large-star and small-star steps: minima
    are grouped sums with map-side combining and are joined back, so that a hub with very many links is never held by one
    task. Self links keep their node in the result.
    """
    edges = edges.select("u", "v")
    if edges.count() <= few:
        return cut(edges.coalesce(1).mapInArrow(_joined, "node long, component long"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = cut(nodes)
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select("u", F.col("m").alias("v")).union(tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = cut(small)
        is_now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(now)
        now = new
        if is_now == seen:
            break
        seen = is_now
    else:
        raise RuntimeError("connected components did not settle")
    return cut(nodes.join(now, nodes.node == now.u, "left").select("node", F.coalesce("v", "node").alias("component")))
