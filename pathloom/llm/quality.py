"""Quality classifier over supervised subword embeddings.

A word's vector is the mean of learned vectors of its hashed self and its hashed character n-grams; a text's is the mean
over its words. A softmax over the classes is trained with the vectors by stochastic gradient descent in numpy.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bucket, held, release

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 16, 16, 2, 4
EPOCHS, RATE, SEED = 6, 0.5, 11
#: The sample that is learned from: labelled rows in order of a hash of their id, and their characters in all.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000_000
KEPT_WORDS = 250_000
REPEAT = "\u21ba"
THRESHOLD = 0.3


def parts(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, the word's ends marked."""
    data = f"<{word}>"
    crc, found = zlib.crc32, [zlib.crc32(data.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in range(SHORTEST, LONGEST + 1):
        found += [crc(data[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(data) - n + 1)]
    return found


def split(text: str) -> list[str]:
    """Words of a text; one that repeats the word before it is marked, so that all repeats share n-grams."""
    words = text.split()
    return [w if w != before else REPEAT + w for before, w in zip([""] + words, words)]


class Model:
    """Embeddings of buckets and the softmax layer (dim by class, with bias)."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias

    def by_bucket(self) -> np.ndarray:
        """What a bucket adds to the difference of the two classes: vectors are averaged, so scores are, too."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0])


def document(counts: Counter, known: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which add up to 1."""
    total, ids, weights = sum(counts.values()), [], []
    for w, n in counts.items():
        if w not in known:
            known[w] = np.array(parts(w), np.int32)
        ids.append(known[w])
        weights.append(np.full(len(known[w]), n / (total * len(known[w]))))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0)
    unique, at = np.unique(np.concatenate(ids), return_inverse=True)
    return unique, np.bincount(at, np.concatenate(weights))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over the texts in a seeded order, the rate falling to 0 in a line."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    known: dict[str, tuple] = {}
    docs = [document(Counter(split(t)), known) for t in texts]
    known.clear()
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, weights = docs[k]
            now, done = rate * (1 - done / steps), done + 1
            own = vectors[ids]
            hidden = weights @ own
            score = hidden @ out + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[k]] -= 1.0
            back = out @ p
            out -= now * np.outer(hidden, p)
            bias -= 0.1 * now * p
            # A bucket's step is its gradient over the greatest weight of the text: long texts, whose weights are small,
            # move their buckets as far as short ones do.
            if len(ids):
                vectors[ids] = own - (now * weights / weights.max())[:, None] * back
    return Model(vectors, out, bias)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from a bounded sample of labelled documents, chosen by a hash of the id. Without one, all scores are 1/2.

    Labels other than 0 and 1 and null ids teach nothing; a null text counts as empty. An id with both labels counts with
    each; of rows with one id the least text counts.
    """
    spark = docs.sparkSession
    few = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).distinct()
    few = few.orderBy(F.xxhash64(F.lit(SEED), F.col("i").cast("string")), "i", "y").limit(rows)
    chosen = spark.createDataFrame(few.collect(), few.schema)  # at most ``rows`` ids
    taken, texts, marks = 0, [], []
    found = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "i").select("i", "t", "y")
    ids = found.groupBy("i", "y").agg(F.max(F.length("t")).alias("n")).collect()  # at most twice as many as ids
    keep = set()
    for r in sorted(ids, key=lambda r: (zlib.crc32(str(r["i"]).encode()), r["i"], r["y"])):
        if taken < chars:
            keep.add(r["i"])
            taken += r["n"]
    for r in found.where(F.col("i").isin(sorted(keep)) if len(keep) < len({r["i"] for r in ids}) else F.lit(True)).groupBy("i", "y").agg(F.min("t").alias("t")).collect():
        texts.append((r["i"], r["t"], r["y"]))
    texts.sort()
    marks = [y for _, _, y in texts]
    model = train([t for _, t, _ in texts], marks)
    del texts, marks, ids
    release()
    return model


def scorer(spark, model: Model):
    """A function of a list of texts for use in tasks: the probability of label 1 of each.

    The text's vector is a mean and the layer is linear, so a worker keeps one number for each word.
    """
    shared, key = spark.sparkContext.broadcast((model.by_bucket(), float(model.bias[1] - model.bias[0]))), uuid.uuid4().hex

    def score(texts: list[str | None]) -> list[float]:
        table, bias = shared.value
        known = held(key, dict)
        counts = [Counter(split(t or "")) for t in texts]
        if len(known) > KEPT_WORDS:
            known.clear()
        new = [w for w in set().union(*counts) if w not in known]
        if new:
            ids = [parts(w) for w in new]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            values = table[np.fromiter((i for own in ids for i in own), np.int64, int(lengths.sum()))]
            known.update(zip(new, (np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1]))) / lengths).tolist()))
        out = []
        for c in counts:
            n = sum(c.values())
            total = sum(known[w] * k for w, k in c.items()) / n if n else 0.0
            out.append(float(1 / (1 + np.exp(-(total + bias)))))
        return out

    return score


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row: the probability of label 1 for the whole text. Null and empty texts get the bias alone.

    Rows are independent: repeated ids or texts are scored alike, a null id is handed on. Texts of any length are scored
    whole; other columns, whatever their names, are not read. An empty table gives no rows.
    """
    score = scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(score(some.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def good(docs: DataFrame, model: Model, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, with a score of ``least`` at least. Columns of any name keep their values."""
    score, at = scorer(docs.sparkSession, model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                yield some.filter(pa.array([x >= least for x in score(some.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_query(spark, sf_dir: str) -> DataFrame:
    """op10: the quality of every document, learned outside the held-out fifth; ``held_out`` is false for a null id."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(hash_bucket("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, labels.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
