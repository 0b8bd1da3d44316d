"""Language identification by unigram pieces whose segmentations are summed out.

The pieces are a fixed public vocabulary; each language has a probability for every piece. A word's likelihood is the
sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Piece
probabilities are learned by expectation maximisation over the same lattices.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_bucket, held, release

VOCABULARY = "piece_bpe_32k.model"
#: The sample that is learned from: documents of a language, in order of a hash, and their characters in all.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 600_000
PASSES, SMOOTH, LONGEST = 3, 0.02, 16
KEPT_WORDS = 200_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Ranked ids of a language for each that is wanted: a hash below a bound lets about so many by, whatever the input.
SPARE = 4


class Pieces:
    """The vocabulary: its strings by id, and single bytes for characters that it lacks."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.count = model.get_piece_size()
        self.id, self.byte = {}, [0] * 256
        for i in range(self.count):
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.id[model.id_to_piece(i)] = i
        self.find = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if len(piece) <= LONGEST:
                self.find.add_word(piece, i * 64 + len(piece))
        self.find.make_automaton()
        self.odd: dict[str, list[int]] = {}

    def lattice(self, words: list[str]):
        """Edges of all words' lattices: tail node, head node, piece. Nodes of word k are first[k] to first[k + 1] - 1.

        A character that is no piece has one edge, numbered ``count`` + its place in ``odd``: the product of its bytes.
        The words are searched as one string, in which a node is a place and line ends part the words.
        """
        whole = "".join(["▁" + w + "\n" for w in words])
        first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)))
        found = np.fromiter(chain.from_iterable(self.find.iter(whole)), np.int64).reshape(-1, 2)
        head, length = found[:, 0] + 1, found[:, 1] & 63
        tail, piece = head - length, found[:, 1] >> 6
        if strange := [c for c in set(whole) if c not in self.id and c != "\n"]:
            for c in strange:
                self.odd.setdefault(c, [len(self.odd), *(self.byte[b] for b in c.encode("utf-8", "surrogatepass"))])
            code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.flatnonzero(np.isin(code, np.array([ord(c) for c in strange], np.uint32)))
            tail, head = np.append(tail, at), np.append(head, at + 1)
            piece = np.append(piece, [self.count + self.odd[chr(c)][0] for c in code[at]])
            order = np.argsort(head, kind="stable")
            tail, head, piece = tail[order], head[order], piece[order]
        return tail, head, piece.astype(np.int64), first

    def with_odd(self, logs: np.ndarray) -> np.ndarray:
        """Log probabilities of pieces with those of odd characters below them."""
        if not self.odd:
            return logs
        return np.vstack([logs, *(logs[ids[1:]].sum(axis=0, keepdims=True) for ids in self.odd.values())])


def layers(key: np.ndarray, depth: np.ndarray):
    """Edges, sorted by ``key``, by depth; within a layer by node, with the start of each node's run."""
    order = np.argsort(depth.astype(np.int32), kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        k = key[part]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1))
        yield part, starts, k[starts]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log-sum-exp of the rows of each run."""
    most = np.maximum.reduceat(values, starts, axis=0)
    lengths = np.diff(np.append(starts, len(values)))
    return most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, lengths, axis=0)), starts, axis=0))


def forward(edges, logs: np.ndarray) -> np.ndarray:
    """log of the sum over all paths from its word's start, for each node and language."""
    tail, head, piece, first = edges
    alpha = np.full((first[-1], logs.shape[1]), -np.inf)
    alpha[first[:-1]] = 0.0
    depth = head - np.repeat(first[:-1], np.diff(first))[head]
    for part, starts, nodes in layers(head, depth):
        alpha[nodes] = _sums(alpha[tail[part]] + logs[piece[part]], starts)
    return alpha


def backward(edges, logs: np.ndarray) -> np.ndarray:
    """log of the sum over all paths to its word's end."""
    tail, head, piece, first = edges
    beta = np.full((first[-1], logs.shape[1]), -np.inf)
    beta[first[1:] - 1] = 0.0
    order = np.argsort(tail, kind="stable")
    tail, head, piece = tail[order], head[order], piece[order]
    depth = np.repeat(first[1:], np.diff(first))[tail] - tail
    for part, starts, nodes in layers(tail, depth):
        beta[nodes] = _sums(beta[head[part]] + logs[piece[part]], starts)
    return beta


def word_logs(pieces: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    """log likelihood of each word in each language."""
    edges = pieces.lattice(words)
    return forward(edges, pieces.with_odd(logs))[edges[3][1:] - 1]


def split(text: str) -> list[str]:
    return text.lower().split()


def learn(counts: Counter, pieces: Pieces, passes: int = PASSES, smooth: float = SMOOTH) -> np.ndarray:
    """log probability of each piece from word counts, by expectation maximisation with added ``smooth`` counts."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], float)
    logs = np.full((pieces.count, 1), -np.log(pieces.count))
    if not words:
        return logs[:, 0]
    edges = pieces.lattice(words)
    tail, head, piece, first = edges
    word = np.searchsorted(first, tail, "right") - 1
    for _ in range(passes):
        full = pieces.with_odd(logs)
        a, b = forward(edges, full), backward(edges, full)
        use = np.exp(a[tail, 0] + full[piece, 0] + b[head, 0] - a[first[1:] - 1, 0][word]) * weight[word]
        expected = np.bincount(piece, use, len(full))
        total = expected[: pieces.count].copy()
        for k, ids in enumerate(pieces.odd.values()):
            for i in ids[1:]:
                total[i] += expected[pieces.count + k]
        total += smooth
        logs = np.log(total / total.sum())[:, None]
    return logs[:, 0]


class Model:
    """Languages in order and their log probabilities (piece by language)."""

    def __init__(self, languages: list[str], logs: np.ndarray, path: str):
        self.languages, self.logs, self.path = languages, logs, path


def fit(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from a bounded sample: of each language the ``sample_docs`` first rows by a hash of the id, as far as
    ``sample_chars`` characters go. Only ids and languages below a bound of the hash are ranked, a fixed number of them
    whatever the input; the texts of the sample alone are moved. Of rows with one id and language the least text counts.
    Rows with a null text or language teach nothing."""
    label = F.col(lang).cast("string")
    keys = docs.where(label.isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), label.alias("l"), F.length(text).alias("n"), F.xxhash64(F.lit(5), F.col(doc_id).cast("string")).alias("h"))
    counts = keys.groupBy("l").agg(F.least(F.lit(1.0), F.lit(float(SPARE * sample_docs)) / F.count("*")).alias("share"))
    keys = keys.join(F.broadcast(counts), "l").where(F.col("h") / 2.0**64 + 0.5 <= F.col("share")).drop("share")  # a row for each language
    order = Window.partitionBy("l").orderBy("h", "i")
    few = keys.withColumn("k", F.row_number().over(order)).where(f"k <= {sample_docs}")
    few = few.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(f"upto - n < {sample_chars}")
    chosen = few.select("l", "i").collect()  # at most sample_docs ids of a language
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, few.select("l", "i").schema)
    rows = docs.select(F.col(doc_id).alias("i"), label.alias("l"), F.col(text).cast("string").alias("t")).join(F.broadcast(ids), ["i", "l"], "left_semi").groupBy("l", "i").agg(F.min("t").alias("t")).collect()
    pieces, counts = Pieces(path), {}
    for r in rows:
        counts.setdefault(r["l"], Counter()).update(split(r["t"]))
    languages = sorted(counts)
    model = Model(languages, np.stack([learn(counts[x], pieces) for x in languages], axis=1) if languages else np.zeros((pieces.count, 0)), path)
    del rows, counts, pieces
    release()
    return model


def _ready(key, model: Model) -> dict:
    """A worker's pieces and the words that it has scored with a model."""
    return held(key, lambda: {"pieces": Pieces(model.path), "words": {}, "table": np.zeros((1024, len(model.languages)))})


def scorer(spark, model: Model):
    """A function of a list of texts for use in tasks: (language, posterior) of each."""
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(texts: list[str | None]) -> list[tuple[str, float]]:
        model = shared.value
        state = _ready(key, model)
        pieces, known = state["pieces"], state["words"]
        counts = [Counter(split(t)) if t and model.languages and LETTER.search(t) else None for t in texts]
        if len(known) > KEPT_WORDS:
            known.clear()
        new = [w for w in set().union(*(c for c in counts if c)) if w not in known]
        begin = len(known)
        while len(state["table"]) < begin + len(new):
            state["table"] = np.vstack([state["table"], np.zeros_like(state["table"])])
        new.sort(key=len)
        for a in range(0, len(new), 4000):
            part = new[a : a + 4000]
            state["table"][begin + a : begin + a + len(part)] = word_logs(pieces, part, model.logs)
        known.update(zip(new, range(begin, begin + len(new))))
        table, out = state["table"], []
        for c in counts:
            if c is None:
                out.append((UNKNOWN, 0.0))
                continue
            ids = np.fromiter((known[w] for w in c), np.int64, len(c))
            total = np.fromiter(c.values(), float, len(c)) @ table[ids]
            best = int(np.argmax(total))
            out.append((model.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out

    return score


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row: the likeliest language of the whole text and its posterior probability.

    A text that is null or has no letter, and any text if nothing was learned, gets ``und`` and score 0; numerals such as
    fractions are no letters. Ties go to the language that is first in order. Rows are independent: repeated ids or texts
    are scored alike, a null id is handed on. Texts of any length are scored whole; other columns, whatever their names,
    are not read. An empty table gives no rows.
    """
    score = scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = score(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def known_language(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is told with a posterior of ``least`` at least.

    Texts without a letter go. If nothing was learned, only these go. Columns of any name keep their values.
    """
    score, at, learned = scorer(docs.sparkSession, model), docs.columns.index(text), bool(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                texts = some.column(at).to_pylist()
                keep = [x != UNKNOWN and p >= least for x, p in score(texts)] if learned else [bool(t and LETTER.search(t)) for t in texts]
                yield some.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def language_query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every document, learned outside the held-out third; ``held_out`` is false for a null id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(hash_bucket("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~held), vocabulary_path())
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
