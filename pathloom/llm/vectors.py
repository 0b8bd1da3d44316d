"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector of finite numbers that isn't zero."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))


def sample(rows: DataFrame, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, in double precision, of the ``count`` first rows by a hash of the id; vectors of one length."""
    found = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(count).toArrow()
    ids = found.column("vec_id").to_numpy()
    values = [np.array(v, float) for v in found.column("embedding").to_pylist()]
    if not values:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    size = max(sorted({len(v) for v in values}), key=lambda n: sum(len(v) == n for v in values))
    keep = [i for i, v in enumerate(values) if len(v) == size]
    return ids[keep], np.stack([values[i] for i in keep])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column with lists of one length as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
