"""Bounded-space online packing of tokenised documents into windows of a fixed length.

Each task keeps a fixed number of open windows. A document's full windows are cut off first; what remains goes into the
open window that it fills best. When none can hold it, the fullest is topped up with the head of the piece and emitted.
Windows still open when a task ends are leftovers: their pieces, metadata only by then, are merged in two levels.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, release

VOCABULARY = "word_bpe_49k.json"
WINDOW, END_ID, OPEN_WINDOWS, LEAST_CUT = 2048, 1, 32, 24
#: Words whose ids a Python worker keeps; when they are as many, it starts anew. A bound on memory only.
KEPT_WORDS = 250_000
#: Partitions whose leftovers are merged together, and groups of these that are merged in turn; windows still open then
#: are closed, a few for so many partitions, and no task grows with the input.
FAN_IN = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part int"
#: Characters that str.split takes as white space and the tokenizer doesn't, and the start of its special tokens.
ODD = "\x1c", "\x1d", "\x1e", "\x1f", "<|"


#: A word, lower-cased, that is a run of letters and then a run of other signs; both are pieces of the tokenizer.
#: The letters keep their form under its normalisation; the apostrophe begins pieces of its own and is left out.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
#: Stands for a word's end in byte ranks: no text has this byte in UTF-8.
END = b"\xff"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as byte strings with their ids, a word's end being a byte; None if merging by these would differ.

    Merging the neighbours whose joined string has the least id equals merging by the list of merges if ids are in the
    order of merges and each entry, cut into its bytes, is merged back to itself by that list: then neighbours whose
    joined string is an entry are always a listed pair.
    """
    data = json.loads(Path(path).read_text())
    vocabulary, merges = data["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
    suffix, special = data["model"]["end_of_word_suffix"], {t["content"] for t in data["added_tokens"]}
    place = {m: i for i, m in enumerate(merges)}
    if any(vocabulary["".join(m)] != vocabulary["".join(merges[0])] + i for i, m in enumerate(merges)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {}
    for token, i in vocabulary.items():
        if token in special:
            continue
        last = token.endswith(suffix) and token != suffix
        signs = list(token.removesuffix(suffix) if last else token)
        ranks[bytes(byte[c] for c in signs) + END * last] = i
        if last:
            signs[-1] += suffix
        while len(signs) > 1:
            least, k = min((place.get(pair, len(place)), k) for k, pair in enumerate(zip(signs, signs[1:])))
            if least == len(place):
                return None
            signs[k : k + 2] = [signs[k] + signs[k + 1]]
    return ranks


class Words(dict):
    """Ids by word. A new word of a plain form is merged when it is first asked for; others are noted in ``odd``, and have none yet."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.tails, self.odd = merge, {"": b""}, []

    def __missing__(self, word: str) -> bytes:
        if self.merge and (found := PLAIN(word.lower())):
            letters, signs = found.groups()
            if (tail := self.tails.get(signs)) is None:
                tail = self.tails[signs] = array("I", self.merge(signs.encode() + END)).tobytes()
            ids = self[word] = array("I", self.merge(letters.encode() + END)).tobytes() + tail
            return ids
        self.odd.append(word)
        return b""


class Ids:
    """Token ids of whole texts as little-endian 32-bit integers, equal to ``encode(text, add_special_tokens=False).ids``.

    The tokenizer never joins characters across white space, so ids are kept by word. New words of a plain form are
    merged by byte ranks, which takes a fifth of the time; other new words are encoded together. Texts with characters
    that break the rule on white space are encoded as a whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, ranks = Tokenizer.from_file(path), byte_ranks(path)
        self.merge = ranks and tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known = Words(self.merge)
        del ranks
        release()  # reading the vocabulary takes more than it leaves

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't plain."""
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, end, begin = array("I", found.ids), 0, 0
            starts = [a for a, _ in found.offsets]
            for w in some:
                end += len(w) + 1
                k = bisect.bisect_left(starts, end, begin)
                self.known[w] = ids[begin:k].tobytes()
                begin = k

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) + len(self.known.tails) > KEPT_WORDS:
            self.known = Words(self.merge)
        known, out, again = self.known, [], []
        get = known.__getitem__
        for i, text in enumerate(texts):
            if any(x in text for x in ODD):
                out.append(self.whole(text))
                continue
            before, words = len(known.odd), text.split()
            out.append(b"".join(map(get, words)))
            if len(known.odd) > before:
                again.append((i, words))
        if again:
            self.learn(list(dict.fromkeys(known.odd)))
            known.odd.clear()
            for i, words in again:
                out[i] = b"".join(map(get, words))
        return out


def ids_of(path: str) -> Ids:
    return held(("ids", path), lambda: Ids(path))


class Windows:
    """The open windows of one task; ``add`` gives the pieces of windows that were closed."""

    def __init__(self, size: int, count: int, least: int, first_id: int):
        self.size, self.count, self.least, self.next = size, count, least, first_id
        self.open: list[list] = []  # [fill, sequence id, pieces]

    def _new(self) -> list:
        self.open.append([0, self.next, []])
        self.next += 1
        return self.open[-1]

    def _put(self, window: list, piece: tuple) -> None:
        window[2].append((*piece, window[1], window[0]))
        window[0] += piece[2]

    def _close(self, window: list) -> list:
        self.open.remove(window)
        return window[2]

    def add(self, doc: int, total: int, crc) -> list:
        """Place a document of ``total`` ids; ``crc(start, length)`` describes a piece. Returns closed pieces."""
        out, at = [], 0
        while total - at >= self.size:
            out.append((doc, at, self.size, crc(at, self.size), total, self.next, 0))
            self.next += 1
            at += self.size
        rest = total - at
        while rest:
            fits = [w for w in self.open if self.size - w[0] >= rest]
            if fits:
                window = max(fits, key=lambda w: (w[0], -w[1]))
            elif len(self.open) < self.count:
                window = self._new()
            else:
                window = max(self.open, key=lambda w: (w[0], -w[1]))
                if (gap := self.size - window[0]) >= self.least:
                    self._put(window, (doc, at, gap, crc(at, gap), total))
                    at, rest = at + gap, rest - gap
                out += self._close(window)
                continue
            self._put(window, (doc, at, rest, crc(at, rest), total))
            rest = 0
            if window[0] == self.size:
                out += self._close(window)
        return out


def _merge(pieces, size: int):
    """Leftover pieces, longest first, each into the window that it fills best. Gives (window number, offset, fill) by piece."""
    room: list[tuple[int, int]] = []  # (free, window), sorted
    fill: list[int] = []
    place = []
    for n in pieces:
        k = bisect.bisect_left(room, (n, -1))
        if k == len(room):
            free, window = size, len(fill)
            fill.append(0)
        else:
            free, window = room.pop(k)
        place.append((window, fill[window]))
        fill[window] += n
        if free > n:
            bisect.insort(room, (free - n, window))
    return place, fill


def _merged(base: int, size: int, last: bool):
    """A grouped map that puts the leftovers of a group of tasks together; a window that isn't near full goes on."""

    def run(rows):
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        place, fill = _merge(rows["length"].tolist(), size)
        group = int(rows["part"].iloc[0])
        rows["sequence_id"] = [-1 - (base + group * (1 << 32) + w) for w, _ in place]
        rows["offset"] = [o for _, o in place]
        rows["open"] = [not last and fill[w] < size - LEAST_CUT for w, _ in place]
        return rows

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the closing id 1; a null text counts as empty. Each id lies in one piece, no sequence is
    over ``size``, offsets of a sequence are gapless from 0. A row with a null id keeps it; repeated rows
    are packed each. Texts of any length are packed whole; other columns, whatever their names, are not read. Sequence
    ids of leftovers are negative; they are unique but not dense. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = ids_of(tokenizer), TaskContext.get().partitionId()
        packer = Windows(size, windows, LEAST_CUT, part << 32)
        end = END_ID.to_bytes(4, "little")

        def rows(pieces, is_open):
            columns = list(zip(*pieces)) if pieces else [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([is_open] * len(pieces), pa.bool_()), pa.array([part] * len(pieces), pa.int32())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "part"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = [t or "" for t in some.column(1).to_pylist()]
                done = []
                for doc, found in zip(some.column(0).to_pylist(), coder.many(texts)):
                    ids = memoryview(found + end)
                    done += packer.add(doc, len(ids) // 4, lambda start, n: zlib.crc32(ids[4 * start : 4 * (start + n)]))
                if done:
                    yield rows(done, False)
        if left := [p for w in packer.open for p in w[2]]:
            yield rows(left, True)

    found = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECE))
    few = found.where("open").withColumn("part", (F.col("part") / FAN_IN).cast("int"))
    few = cut(few.groupBy("part").applyInPandas(_merged(0, size, False), PIECE))
    rest = few.where("open").withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInPandas(_merged(1 << 62, size, True), PIECE)
    return found.where("not open").union(few.where("not open")).union(rest).drop("open", "part")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_query(spark, sf_dir: str) -> DataFrame:
    """op4: the pieces of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
