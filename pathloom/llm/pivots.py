"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order. Inverted lists hold, for each reference point, the
vectors that have it among these; vectors that share enough of them are candidates, whose cosine is then verified.
Reference points stand apart from each other, so that a dense group has few of its own, and vectors with the same
nearest point are all compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, cut
from .vectors import matrix, sample, usable

#: Nearest reference points of a vector, and how many two vectors must share.
NEAR, SHARED = 10, 2
#: A reference point for so many vectors, within bounds; they come from a sample of the different
#: vectors by a hash of the id.
EACH, FEWEST, MOST = 50, 16, 4096
#: Rows of a list that one task compares with as many others.
BLOCK, SEED = 1024, 29


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def apart(points: np.ndarray, cosine: float) -> np.ndarray:
    """The points, of length 1, that no earlier one of these is within twice the angle of ``cosine`` of."""
    limit, kept, n = max(2 * cosine**2 - 1, cosine / 2), np.zeros_like(points), 0
    for v in points:
        if not (kept[:n] @ v >= limit).any():
            kept[n] = v
            n += 1
    return kept[:n]


def forest(i: np.ndarray, j: np.ndarray, count: int) -> list[tuple[int, int]]:
    """Of the links (i, j) between ``count`` nodes some that join the same nodes, without cycles."""
    root, links = np.arange(count), []
    while True:
        p, q = root[i], root[j]
        apart_yet = p != q
        if not apart_yet.any():
            return links
        i, j, high, low = i[apart_yet], j[apart_yet], np.maximum(p, q)[apart_yet], np.minimum(p, q)[apart_yet]
        pick = np.full(count, -1)
        pick[high] = np.arange(len(high))
        pick = pick[pick >= 0]
        links += zip(i[pick].tolist(), j[pick].tolist())
        root[high[pick]] = low[pick]
        while (root[root] != root).any():
            root = root[root]


def _compare(cosine: float, shared: int, count: int):
    """A grouped map over a list's pair of blocks: links of each vector, and links that join what is linked."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pivot, left, right = (k.as_py() for k in key)
        side = table.column("side").to_numpy()
        a, b = np.flatnonzero(side == left), np.flatnonzero(side == right)
        ids, mult, data = table.column("rep").to_numpy(), table.column("mult").to_numpy(), unit(matrix(table.column("embedding")))
        near = matrix(table.column("near")).astype(int)
        pivots, at = np.unique(near, return_inverse=True)
        held = np.zeros((len(ids), len(pivots)), np.float32)
        held[np.arange(len(ids))[:, None], at.reshape(near.shape)] = 1
        before = held[:, pivots < pivot]
        # Pairs with one nearest point are all taken in its list, others in that of the first point that they share.
        home = near[:, 0]
        wanted = np.where(home[a][:, None] == home[b][None, :], (home[a] == pivot)[:, None], (held[a] @ held[b].T >= shared) & (before[a] @ before[b].T == 0))
        if left == right:
            wanted &= ids[a][:, None] < ids[b][None, :]
        if wanted.sum() * 16 > wanted.size:
            i, j = np.nonzero(wanted & (data[a] @ data[b].T >= cosine))
        else:
            i, j = np.nonzero(wanted)
            score = np.concatenate([np.einsum("ij,ij->i", data[a[i[k : k + 65536]]], data[b[j[k : k + 65536]]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
            ok = score >= cosine
            i, j = i[ok], j[ok]
        i, j = a[i], b[j]
        total = np.bincount(i, mult[j], len(ids)) + np.bincount(j, mult[i], len(ids))
        links = forest(i, j, len(ids))
        some = np.flatnonzero(total)
        u = [*ids[some].tolist(), *(int(ids[x]) for x, _ in links)]
        v = [*[None] * len(some), *(int(ids[y]) for _, y in links)]
        n = [*total[some].astype(int).tolist(), *[0] * len(links)]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, near: int = NEAR, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors are one class with a count, by two 64-bit hashes; other pairs are counted where their lists meet, and
    only links that join components leave a task. Vectors that are null, zero or hold null or non-finite numbers link
    with nothing. Vectors link with those of their own length; those of another length than most have no reference points
    and are all compared, in one list for each length. A null id keeps a null component. Rows with one id are vectors of
    their own. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    hashes = {"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(SEED), "embedding")}
    own = cut(rows.withColumns(hashes).select("vec_id", "h1", "h2", "embedding"))
    classes = cut(own.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.min_by("embedding", "vec_id").alias("embedding")))
    most = classes.where(F.size("embedding") == size)
    total = most.count()
    count = min(MOST, max(FEWEST, 1 << max(0, math.ceil(math.log2(max(1, total) / EACH)))))
    _, points = sample(most.select(F.col("rep").alias("vec_id"), "embedding"), count, SEED)
    points = spark.sparkContext.broadcast(apart(unit(points), cosine) if len(points) else points)

    def describe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                score = unit(matrix(some.column("embedding"))) @ points.value.T
                k = min(near, score.shape[1])
                order = np.argsort(-score, axis=1, kind="stable")[:, :k].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * k), pa.array(order.reshape(-1)))
                yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("mult"), some.column("embedding"), lists], names=["rep", "mult", "embedding", "near"])

    kind = dict(rows.dtypes)["embedding"]
    described = most.select("rep", "mult", "embedding").mapInArrow(describe, f"rep long, mult long, embedding {kind}, near array<int>")
    classes = cut(described.union(classes.where(F.size("embedding") != size).select("rep", "mult", "embedding", F.array(-F.size("embedding")))))
    posted = classes.withColumns({"home": F.get("near", F.lit(0)), "pivot": F.explode("near")})
    # Many vectors of another point have blocks of their own in a list: their pairs are taken in that point's list.
    of = posted.groupBy("pivot", "home").agg(F.count("*").alias("n"))
    of = of.groupBy("pivot", F.when((F.col("pivot") != F.col("home")) & (F.col("n") > BLOCK), F.col("home")).alias("home")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    upto = F.sum("blocks").over(Window.partitionBy("pivot").orderBy(F.col("home").asc_nulls_first()))
    of = cut(of.withColumns({"first": (upto - F.col("blocks")).cast("int"), "all": F.sum("blocks").over(Window.partitionBy("pivot")).cast("int")}))
    lists = of.groupBy("pivot").agg(F.first("all").alias("all"), F.coalesce(F.max(F.when(F.col("home").isNull(), F.col("blocks"))), F.lit(1)).alias("mixed"))  # a row for each point
    many = of.where("home is not null").select("pivot", "home", "first", "blocks")
    posted = posted.join(F.broadcast(lists), "pivot").join(many, ["pivot", "home"], "left")
    posted = posted.withColumn("side", (F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64("rep"), F.coalesce("blocks", "mixed"))).cast("int"))
    posted = posted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).where("first is null or o < first or o >= first + blocks")
    posted = posted.withColumns({"left": F.least("side", "o"), "right": F.greatest("side", "o")}).select("pivot", "left", "right", "side", "rep", "mult", "embedding", "near")
    enough = min(shared, near, max(1, len(points.value) if total else 1))
    found = cut(posted.groupBy("pivot", "left", "right").applyInArrow(_compare(cosine, enough, count), "u long, v long, n long"))
    parts = connected_components(found.where("v is not null").select("u", "v"))
    sums = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    named = classes.select("rep", "mult").join(sums, F.col("rep") == F.col("u"), "left").join(parts, F.col("rep") == F.col("node"), "left").select("rep", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = own.select("vec_id", "h1", "h2").join(own.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep")), ["h1", "h2"])
    linked = member.join(named, "rep").select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rest = rest.where(~(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def near_query(spark, sf_dir: str) -> DataFrame:
    """op5: all vectors at a cosine of 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
