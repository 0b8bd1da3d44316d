"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a string of 64 bits, the sides of random hyperplanes, and keeps the strings in a sorted
array. A query descends in all trees to its longest matching prefixes and then ascends in all of them together, one bit
at a time, until the vectors under its prefixes are as many as wanted; these are ranked by their exact distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .vectors import matrix, sample, usable

TREES, BITS, SEED = 32, 64, 23
#: Vectors that the hyperplanes and the share of candidates are fitted on, and the queries among them.
SAMPLE, TRIALS, RECALL = 10_000, 100, 0.97
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0)
#: Rows of a shard, for which one task keeps all trees, and queries that are put to it at once.
SHARD, BLOCK = 16_384, 8_192


class Planes:
    """Hyperplanes of all trees; each parts the sample at its median."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.normals = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * BITS))
        self.middle = np.median(vectors @ self.normals, axis=0)
        self.trees = trees

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """A 64-bit string for each tree (row) and vector (column); the first bit is the highest."""
        out = np.zeros((self.trees, len(vectors)), np.uint64)
        for at in range(0, len(vectors), 2048):
            bits = vectors[at : at + 2048] @ self.normals > self.middle
            packed = np.packbits(bits.reshape(len(bits), self.trees, BITS), axis=2)
            out[:, at : at + len(bits)] = packed.copy().view(">u8").reshape(len(bits), self.trees).T.astype(np.uint64)
        return out


class Forest:
    """Sorted arrays over the vectors of a shard."""

    def __init__(self, planes: Planes, vectors: np.ndarray):
        self.vectors, strings = vectors, planes.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def under(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the run of its array that shares the query's first ``depth`` bits."""
        rest = (1 << BITS - depth) - 1
        low, high = strings & np.uint64(~rest & (1 << BITS) - 1), strings | np.uint64(rest)
        return (np.stack([np.searchsorted(s, q, side) for s, q in zip(self.sorted, x)]) for x, side in ((low, "left"), (high, "right")))

    def candidates(self, strings: np.ndarray, wanted: int):
        """Places of the candidates of each query: at least ``wanted``, or all there are."""
        wanted = min(wanted, len(self.vectors))
        open_, found = np.arange(strings.shape[1]), {}
        for depth in range(BITS, -1, -1):
            if not len(open_):
                break
            low, high = self.under(strings[:, open_], depth)
            ready = (high - low).sum(axis=0) >= wanted
            left = []
            for k, q in enumerate(open_):
                if ready[k]:
                    mask = np.zeros(len(self.vectors), bool)
                    for t in range(len(low)):
                        mask[self.order[t, low[t, k] : high[t, k]]] = True
                    if mask.sum() >= wanted:
                        found[q] = np.flatnonzero(mask)
                        continue
                left.append(q)
            open_ = np.array(left, int)
        return found


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares overflow, those of scaled differences."""
    with np.errstate(over="ignore"):
        far = np.sqrt(((vectors - query) ** 2).sum(axis=1))
        for i in np.flatnonzero(np.isinf(far)):
            apart = vectors[i] / 2 - query / 2
            most = np.abs(apart).max()
            far[i] = most * np.sqrt(((apart / most) ** 2).sum()) * 2
    return far


def nearest(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and Euclidean distances of the ``k`` nearest vectors but that of row ``own``; ties go to the smaller id."""
    others = np.flatnonzero(rows != own)
    far, ids = distances(vectors[others], query), ids[others]
    if len(far) > 4 * k:
        edge = np.partition(far, k)[k]
        near = np.flatnonzero(far <= edge)
        far, ids = far[near], ids[near]
    order = np.lexsort((ids, far))[:k]
    return ids[order], far[order]


def fit(rows: DataFrame, k: int, size: int = SAMPLE, recall: float = RECALL) -> tuple[Planes, float, int]:
    """Hyperplanes, the share of a shard that is compared, and the dimension, from a bounded sample.

    The share is the least at which the sample's own queries find ``recall`` of their true neighbours in it.
    """
    ids, vectors = sample(rows, size, SEED)
    if not len(ids):
        return None, 1.0, 0
    planes = Planes(vectors)
    forest, trials = Forest(planes, vectors), range(0, len(ids), max(1, len(ids) // TRIALS))
    strings = planes.strings(vectors[list(trials)])
    places = np.arange(len(ids))
    truth = [set(nearest(vectors, places, places, vectors[i], i, k)[0].tolist()) for i in trials]
    for share in SHARES:
        found = forest.candidates(strings, max(k + 1, math.ceil(share * len(ids))))
        hit = sum(len(t.intersection(found[q].tolist())) for q, t in enumerate(truth))
        if hit >= recall * sum(map(len, truth)):
            break
    return planes, share, vectors.shape[1]


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds its ``k`` nearest others by Euclidean distance.

    Vectors that are null, zero or hold null or non-finite numbers and rows without an id take no part. A vector is
    compared with those of its own length; lengths other than most of the sample's have no forest, their vectors are all
    compared. Rows with one id are vectors of their own and, as queries, have ``k`` rows each. Fewer rows than ``k`` give
    all of them; an empty table gives none. Other columns, whatever their names, are read by ``is_query`` alone, which
    sees ``vec_id`` and ``embedding``.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors).withColumns({"row": F.monotonically_increasing_id(), "size": F.size("embedding")}))
    planes, share, size = fit(rows, k)
    count, asked = rows.agg(F.count("*"), F.coalesce(F.count_if(is_query), F.lit(0))).first()
    shards, blocks = max(1, math.ceil(count / SHARD)), max(1, math.ceil(asked / BLOCK))
    shared = spark.sparkContext.broadcast(planes)

    def look(key: tuple[pa.Scalar, ...], queries: pa.Table, own: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if queries.num_rows and own.num_rows:
            ids, own_rows, data = own.column("vec_id").to_numpy(), own.column("row").to_numpy(), matrix(own.column("embedding"))
            asked, names, asked_rows = matrix(queries.column("embedding")), queries.column("vec_id").to_numpy(), queries.column("row").to_numpy()
            forest = Forest(shared.value, data) if data.shape[1] == size else None
            wanted, every = max(k + 1, math.ceil(share * len(ids))), np.arange(len(ids))
            for at in range(0, len(names), 256):
                some = asked[at : at + 256]
                found = forest.candidates(shared.value.strings(some), wanted) if forest else dict.fromkeys(range(len(some)), every)
                for q, places in found.items():
                    near, far = nearest(data[places], ids[places], own_rows[places], asked[at + q], asked_rows[at + q], k)
                    out[0] += [int(names[at + q])] * len(near)
                    out[1] += near.tolist()
                    out[2] += far.tolist()
                    out[3] += [int(asked_rows[at + q])] * len(near)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64()), "row": pa.array(out[3], pa.int64())})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "row"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    put = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", "row", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    at = ["size", "shard", "block"]
    found = put.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInArrow(look, "query_id long, vec_id long, score double, row long")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_query(spark, sf_dir: str) -> DataFrame:
    """op3: the 10 nearest of each vector whose id is divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
