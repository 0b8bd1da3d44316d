"""N-gram Jaccard self-join by signature trees.

A document is the set of its distinct word shingles, as sorted 64-bit hashes. Sets that can't be linked are put aside by
two exact counts, the others meet in groups by a shared shingle, and in a group a signature tree is traversed against
itself: nodes hold the OR of their members' token bitmaps, the range of their sizes and their component, and a pair of
nodes goes no further if its greatest possible overlap is too small or if both lie in one component already. Pairs of
leaves are verified on the sets themselves.

Counts. A set of n shingles lacks at most n - ceil(t n) of them in any set that it is linked to. So with
p = n - ceil(t n) + 1, at least 1 + e of its first p + e shingles by hash are among the first of the other set, too. A
set of whose first p + e shingles fewer are held by any other set has no link. The first count takes e = p / 2 of every
document, the second takes all shingles of what remains. It tells in how many of these sets a shingle is; in that order
a remaining set's first p shingles are its groups, less those that no other set has.
Shingles are counted as 32-bit numbers in buckets, each once for a chunk of documents, so that a shingle of very many
documents is no load for its bucket; numbers that clash let more sets by, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, cut, drop, free_names, held, release, trimmed

LEAF, FANOUT, BLOCK = 8, 4, 256
#: Bits of a bitmap: a power of two, this many for each shingle or more; a larger one folds to a smaller.
BITS, FEWEST = 8, 512
#: Rounds in which nodes of groups above a block meet leaders in new blocks, before signatures are compared.
ROUNDS = 3
#: Members of a unit whose signatures are compared with another unit's.
UNIT = 1024
#: Most bits of a filter that thins rows ahead of a join; beyond an eighth as many ids the rows are joined instead.
FILTER_BITS = 1 << 26
#: Documents and shingles of a chunk of postings, and the bytes of a table for each of their buckets.
CHUNK_DOCS, CHUNK_TOKENS, BUCKET_BYTES = 1 << 16, 1 << 20, 1 << 26
FOUND = "doc_id long, hash long, node long, n long, need long, chunk long, place int, bucket int, keys binary, owners binary, many binary, times binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, with A-Z in lower case; all words if they are fewer."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mixed(total + h[k : k + n])
    return np.unique(total)


def node_of(hashes: np.ndarray) -> int:
    """A set's number among all sets, by a 64-bit hash of it."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def first_shingles(n: int, threshold: Fraction) -> int:
    """How many of a set's first shingles hold one at least of any linked set's first ones."""
    return n + threshold.numerator * -n // threshold.denominator + 1


class Chunk:
    """The shingles of a run of documents: which of them they share, and the others by bucket."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.docs: list[tuple] = []  # (doc_id, hash of the text, node, n, need, place or None)
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, text_hash: int | None, node: int | None, n: int, need: int, tokens: np.ndarray | None) -> None:
        self.docs.append((doc, text_hash, node, n, need, None if tokens is None else len(self.tokens)))
        if tokens is not None:
            self.tokens.append(tokens)
            self.size += len(tokens)

    def full(self) -> bool:
        return len(self.docs) >= CHUNK_DOCS or self.size >= CHUNK_TOKENS

    def batch(self) -> pa.RecordBatch:
        """A row for each document, one for each bucket and, as bucket -1, one with the shared shingles and their owners."""
        count = len(self.tokens)
        h = mixed(np.concatenate(self.tokens) if count else np.zeros(0, np.uint64))
        owner = np.repeat(np.arange(count, dtype=np.uint16), np.fromiter(map(len, self.tokens), np.int64, count))
        at = (h % np.uint64(self.buckets)) << np.uint64(32) | h >> np.uint64(32)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        same = at[1:] == at[:-1]
        alone = ~(np.append(same, False) | np.append(False, same))
        common, own = at[~alone], owner[~alone]
        many, times = np.unique(common, return_counts=True)
        at, owner = at[alone], owner[alone]
        edges = np.arange(self.buckets + 1, dtype=np.uint64) << np.uint64(32)
        a, b = np.searchsorted(at, edges), np.searchsorted(many, edges)
        keys, many, times = at.astype(np.uint32), many.astype(np.uint32), times.astype(np.uint32)
        some = np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1])).tolist()
        none, rest = [None] * len(self.docs), [None] * (1 + len(some))
        blob = lambda first, x, cuts: pa.array([*none, first, *(x[cuts[k] : cuts[k + 1]].tobytes() for k in some)], pa.binary())
        columns = {
            **{c: pa.array([d[k] for d in self.docs] + rest, pa.int64()) for k, c in enumerate(("doc_id", "hash", "node", "n", "need"))},
            "chunk": pa.array([self.number] * (len(none) + len(rest)), pa.int64()),
            "place": pa.array([d[5] for d in self.docs] + rest, pa.int32()),
            "bucket": pa.array([*none, -1, *some], pa.int32()),
            "keys": blob(common.tobytes(), keys, a),
            "owners": blob(own.tobytes(), owner, a),
            "many": blob(None, many, b),
            "times": blob(None, times, b),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


REPLY = "chunk long, keys binary, owners binary, counts binary, many binary, times binary"


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """REPLY to a bucket's chunks: in how many documents their shared shingles are, their own included."""
    read = lambda c, kind: [np.frombuffer(k, kind) for k in table.column(c).to_pylist()]
    keys, many, times = read("keys", np.uint32), read("many", np.uint32), read("times", np.uint32)
    every = np.concatenate([*keys, *many])
    every, at = np.unique(every, return_inverse=True)
    count = np.bincount(at, np.concatenate([np.ones(sum(map(len, keys))), *times]), len(every)).astype(np.uint32)
    high, out = np.uint64(key[0].as_py() << 32), []
    for chunk, own, k, m in zip(table.column("chunk").to_pylist(), read("owners", np.uint16), keys, many):
        found = count[np.searchsorted(every, k)]
        hit = found > 1
        if hit.any() or len(m):
            out.append((chunk, (high | k[hit]).tobytes(), own[hit].tobytes(), found[hit].tobytes(), (high | m).tobytes(), count[np.searchsorted(every, m)].tobytes()))
    columns = list(zip(*out)) if out else [()] * 6
    return pa.table({c: pa.array(x, pa.int64() if c == "chunk" else pa.binary()) for c, x in zip(("chunk", "keys", "owners", "counts", "many", "times"), columns)})


def _judged(threshold: Fraction):
    """A grouped map over a chunk's documents and the replies to it: (node, keys) of sets with enough shared shingles."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(replies.column(c).to_pylist()), kind)
        place, node, n, need = (docs.column(c).to_pylist() for c in ("place", "node", "n", "need"))
        out = [[], []]
        own = next((i for i, x in enumerate(place) if x is None), None)
        if own is not None:
            common, owner = np.frombuffer(docs.column("keys")[own].as_py(), np.uint64), np.frombuffer(docs.column("owners")[own].as_py(), np.uint16)
            many, times = read("many", np.uint64), read("times", np.uint32)
            order = np.argsort(many)
            times = times[order][np.searchsorted(many[order], common)] if len(common) else np.zeros(0, np.uint32)
            keys, owner, count = np.append(read("keys", np.uint64), common), np.append(read("owners", np.uint16), owner), np.append(read("counts", np.uint32), times)
            order = np.lexsort((keys, count, owner))
            keys, owner = keys[order], owner[order]
            for k, i in enumerate(place):
                if i is not None:
                    a, b = np.searchsorted(owner, [i, i + 1])
                    if b - a >= need[k]:
                        alone = n[k] - int(b - a)
                        out[0].append(node[k])
                        out[1].append(keys[a : a + max(0, first_shingles(n[k], threshold) - alone)].view(np.int64))
        ends = np.cumsum([0, *map(len, out[1])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)))
        return pa.table({"node": pa.array(out[0], pa.int64()), "keys": lists})

    return run


def _postings(rows: DataFrame, width: int, threshold: Fraction, whole: bool) -> DataFrame:
    """FOUND: a row for each of ``rows`` (doc_id, hash, text), and rows for the buckets of each chunk of them.

    A set that a task has seen before has no place in a chunk: its first document stands for it.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 17, size // BUCKET_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard", dict)
        number = TaskContext.get().partitionId() << 32
        chunk, seen = Chunk(number, buckets), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for doc, text_hash, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    h = shingles(text, width)
                    n, node, need, tokens = len(h), None, 0, None
                    if n:
                        node = node_of(h)
                        p = first_shingles(n, threshold)
                        more = n - p if whole else min((p + 1) // 2, n - p)
                        if node not in seen:
                            seen.add(node)
                            need, tokens = 1 + more, h[: p + more]
                    chunk.add(doc, text_hash, node, n, need, tokens)
                    if chunk.full():
                        yield chunk.batch()
                        number += 1
                        chunk = Chunk(number, buckets)
        if chunk.docs:
            yield chunk.batch()
        del chunk, seen
        release()

    return cut(rows.mapInArrow(run, FOUND))


def _may_link(found: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, keys) of the sets with enough shingles that others hold, and their groups if all shingles were counted."""
    met = found.where("bucket >= 0").select("chunk", "bucket", "keys", "owners", "many", "times").groupBy("bucket").applyInArrow(_meet, REPLY)
    own = found.where("place is not null or bucket = -1").select("chunk", "place", "node", "n", "need", "keys", "owners")
    return own.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(trimmed(_judged(threshold)), "node long, keys array<long>")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    size = max(FEWEST, 1 << (BITS * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one size, that of the smallest: bits of one place in it are joined."""
    size = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, size), axis=0) for m in maps])


class SignatureTree:
    """A tree over sets ordered by component, then by size and bitmap. A node has the OR of its bitmaps and size bounds."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, groups: list[int]):
        self.sizes, self.maps, n = sizes, maps, len(sizes)
        self.over = sizes - np.bitwise_count(maps).sum(axis=1)  # shingles that share a bit
        order = np.lexsort((maps[:, 0], sizes, np.asarray(groups)))
        self.nodes: list[tuple] = []  # (members or None, children, OR, least size, most size, most shared bits)
        level = [self._node(order[i : i + LEAF].tolist(), ()) for i in range(0, n, LEAF)]
        while len(level) > 1:
            level = [self._node(None, tuple(level[i : i + FANOUT])) for i in range(0, len(level), FANOUT)]
        self.root = level[0]

    def _node(self, members, children) -> int:
        if members is not None:
            own = np.array(members)
            row = (members, (), np.bitwise_or.reduce(self.maps[own]), int(self.sizes[own].min()), int(self.sizes[own].max()), int(self.over[own].max()))
        else:
            kids = [self.nodes[c] for c in children]
            row = (None, children, np.bitwise_or.reduce([k[2] for k in kids]), min(k[3] for k in kids), max(k[4] for k in kids), max(k[5] for k in kids))
        self.nodes.append(row)
        return len(self.nodes) - 1


def traverse(sizes: np.ndarray, maps: np.ndarray, components: list[int], threshold: Fraction, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of members in different components that may be linked.

    With ``sets`` each pair is verified at once and joins its components, so that the links span all linked sets and are
    fewer than the members; ``components`` is brought up to date. Without, all pairs that the signatures allow are given.
    """
    tree = SignatureTree(sizes, maps, components)
    parent: dict[int, int] = {c: c for c in components}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    num, den = threshold.numerator, threshold.denominator
    one: list[int | None] = []  # a node's component if all its members share one

    def single(x: int) -> int | None:
        members, children = tree.nodes[x][:2]
        found = {find(components[m]) for m in members} if members is not None else {None if one[c] is None else find(one[c]) for c in children}
        return found.pop() if len(found) == 1 else None

    for x in range(len(tree.nodes)):
        one.append(single(x))
    links, stack = [], [(tree.root, tree.root)]
    while stack:
        x, y = stack.pop()
        a, b = tree.nodes[x], tree.nodes[y]
        if sets:
            for z in (x, y):
                if one[z] is None:
                    one[z] = single(z)
        if one[x] is not None and one[y] is not None and find(one[x]) == find(one[y]):
            continue
        if x != y:
            least = num * (a[3] + b[3])  # overlap * (num + den) has to reach it
            most = min(int(np.bitwise_count(a[2] & b[2]).sum()) + min(a[5], b[5]), a[4], b[4])
            if most * (num + den) < least or den * a[4] < num * b[3] or den * b[4] < num * a[3]:
                continue
        if a[0] is not None and b[0] is not None:
            left, right = np.array(a[0]), np.array(b[0])
            m, n = sizes[left][:, None], sizes[right][None, :]
            need = -(-num * (m + n) // (num + den))
            p, q = maps[left][:, None, :], maps[right][None, :, :]
            may = (need <= np.minimum(m, n)) & (m - np.bitwise_count(p & ~q).sum(axis=2) >= need) & (n - np.bitwise_count(q & ~p).sum(axis=2) >= need)
            if x == y:
                may = np.triu(may, 1)
            for i, j in zip(*np.nonzero(may)):
                u, v = int(left[i]), int(right[j])
                if find(components[u]) == find(components[v]):
                    continue
                if not sets:
                    links.append((u, v))
                elif int(sizes[u] + sizes[v]) - len(np.unique(np.concatenate((sets[u], sets[v])))) >= need[i, j]:
                    links.append((u, v))
                    parent[find(components[u])] = find(components[v])
        elif x == y:
            kids = a[1]
            stack += [(kids[p], kids[q]) for p in range(len(kids)) for q in range(p, len(kids))]
        elif a[0] is None and (b[0] is not None or a[4] - a[3] >= b[4] - b[3]):
            stack += [(c, y) for c in a[1]]
        else:
            stack += [(x, c) for c in b[1]]
    components[:] = [find(c) for c in components]
    return links


def thinned(rows: DataFrame, column: Column, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be among ``wanted`` (one column of longs): a superset, by a filter of bounded size.

    The filter is a bitmap made by a grouped OR; as a table of words it is broadcast, at most FILTER_BITS / 64 rows of
    it. Where the wanted are too many for it, the rows are joined with them.
    """
    wanted = wanted.toDF("_wanted")
    count = wanted.count()
    if count > FILTER_BITS // 8:
        return rows.join(wanted, column == F.col("_wanted"), "left_semi")
    own = Filter(wanted, "_wanted", count)
    return rows.join(own.words, own.word(column) == F.col("_word")).where(own.holds(column)).drop("_word", "_bits")


class Filter:
    """A bitmap of the numbers in a column, 128 bits for each, as a table of words to join by ``word``."""

    def __init__(self, wanted: DataFrame, column: str, count: int, names: tuple[str, str] = ("_word", "_bits")):
        self.size, self.bits = min(FILTER_BITS, max(1 << 16, 1 << (128 * count).bit_length())), F.col(names[1])
        own = F.col(column)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), self._place(own).bitwiseAND(F.lit(63)).cast("int"))
        self.words = F.broadcast(wanted.groupBy(self.word(own).alias(names[0])).agg(F.bit_or(mask).alias(names[1])))

    def _place(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.size))

    def word(self, c: Column) -> Column:
        return F.shiftright(self._place(c), 6).cast("int")

    def holds(self, c: Column) -> Column:
        """Whether the number may be among those of the filter, on a row that is joined with its word or with none."""
        bit = F.call_function("shiftright", self.bits, self._place(c).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        return F.coalesce(bit == 1, F.lit(False))


def _traversed(table: pa.Table, threshold: Fraction, exact: bool) -> list[list[int]]:
    """Pairs of nodes that a traversal of (node, component, n, map, and hashes if ``exact``) finds."""
    nodes = table.column("node").to_pylist()
    rows = sorted({n: i for i, n in enumerate(nodes)}.values(), key=lambda i: nodes[i])
    pick = lambda c: table.column(c).take(rows).to_pylist()
    if len(rows) < 2:
        return []
    sizes, maps, components = np.array(pick("n"), np.int64), [np.frombuffer(m, np.uint64) for m in pick("map")], pick("component")
    sets = [np.frombuffer(h, np.uint64) for h in pick("hashes")] if exact else None
    # Bitmaps are as long as their sets are large, so those of linked sets are folded at most once or twice.
    length, found = np.fromiter(map(len, maps), np.int64, len(maps)), set()
    for least in np.unique(length).tolist():
        own = np.flatnonzero((length >= least) & (length * threshold.numerator <= 2 * least * threshold.denominator)).tolist()
        if len(own) > 1:
            some = [components[i] for i in own]
            for i, j in traverse(sizes[own], folded([maps[i] for i in own]), some, threshold, [sets[i] for i in own] if exact else None):
                found.add((own[i], own[j]))
            if exact:
                joined = dict(zip([components[i] for i in own], some))
                components = [joined.get(c, c) for c in components]
    return [sorted((nodes[rows[i]], nodes[rows[j]])) for i, j in sorted(found)]


def _links(threshold: Fraction):
    """A grouped map over sets: links that join all linked members."""

    def run(table: pa.Table) -> pa.Table:
        pairs = _traversed(table, threshold, True)
        return pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})

    return run


def _candidates(threshold: Fraction):
    """A grouped map over signatures: the members that may be linked with another component's."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nodes = sorted({n for pair in _traversed(table, threshold, False) for n in pair})
        same = {c: pa.array([k.as_py()] * len(nodes), pa.int64()) for c, k in zip(("canopy", "unit", "unit2"), key)}
        return pa.table({**same, "node": pa.array(nodes, pa.int64())})

    return run


def _with_component(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``members`` (node, ...) with ``component``: that of ``parts`` (node, component), or the node itself."""
    if parts is None:
        return members.withColumn("component", F.col("node"))
    return members.join(parts.withColumnRenamed("component", "_c"), "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")


def _sets_of(members: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Of ``sets`` the rows whose node may be among ``members`` (node, ...), with ``columns`` or else with all.

    They are picked where they lie: a join by node would shuffle the sets of all nodes to meet a few.
    """
    own = sets.select(*(columns or ("node", "n", "map", "hashes")))
    return thinned(own, F.col("node"), members.select("node").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, parts: DataFrame | None, threshold: Fraction, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Links among each leader ``u`` and its ``v``, in blocks that all hold the leader; and (node, leader, block) of each v.

    A block is compared whole. ``parts`` (node, component) tells what is joined already. Of ``sets`` only those of the
    pairs are shuffled.
    """
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v"))
    sized = pairs.join(pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "u")
    sized = sized.select(F.col("u").alias("leader"), F.pmod(F.xxhash64("v", F.lit(seed)), F.col("blocks")).cast("int").alias("block"), F.col("v").alias("node"))
    heads = sized.select("leader", "block").distinct().select("leader", "block", F.col("leader").alias("node"))
    groups = _with_component(sized.union(heads), parts).join(_sets_of(asked, sets), "node")
    return cut(groups.groupBy("leader", "block").applyInArrow(_links(threshold), "u long, v long")), sized


def _open_groups(groups: DataFrame, parts: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, node, lo, component, m) of groups (key, node, lo) that hold several components and weren't compared whole.

    A group was if its members were all in one block of ``placed``, its first one perhaps as the leader of the block. Of
    groups with the same members one is kept; ``m`` is their number.
    """
    now = groups.join(parts.select("node", F.col("component").alias("c")), "node", "left").join(placed, "node", "left")
    now = cut(now.select("key", "node", "lo", F.coalesce("c", "node").alias("component"), F.when(F.col("leader").isNotNull(), F.struct("leader", "block")).alias("at")))
    first, led_by = F.col("node") == F.col("lo"), F.when(F.col("node") != F.col("lo"), F.col("at"))
    own = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min(led_by).alias("p"), F.max(led_by).alias("q"), F.max(F.when(first, F.col("at"))).alias("own"), F.max("lo").alias("lo"), F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("same2"))
    done = (F.col("p") == F.col("q")) & ((F.col("p.leader") == F.col("lo")) | (F.col("p") == F.col("own")))
    own = cut(own.where("a <> b").where(~F.coalesce(done, F.lit(False))).groupBy("m", "same", "same2").agg(F.min("key").alias("key")).select("key", "m"))
    out = cut(now.join(own, "key").select("key", "node", "lo", "component", "m"))
    drop(now, own)
    return out


def _canopies(groups: DataFrame) -> DataFrame:
    """(canopy, node, component): groups (key, node, component) merged where they overlap with the first group of one of
    their members, so that a node is in few of them. Members of a group are in one canopy."""
    least = groups.groupBy("node").agg(F.min("key").alias("least"))
    into = cut(groups.join(least, "node").groupBy("key").agg(F.min("least").alias("canopy")))
    out = cut(groups.join(into, "key").select("canopy", "node", "component").distinct())
    several = cut(out.groupBy("canopy").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("canopy"))
    return out.join(several, "canopy")


def _units(canopies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canopy, node, component, unit) and the pairs (canopy, unit, unit2) of units to compare.

    Small components are dealt to units whole, a larger one has units of its own, which aren't compared with each other.
    """
    big = canopies.groupBy("canopy", "component").agg(F.count("*").alias("c"))
    rows = canopies.join(big, ["canopy", "component"])
    small = F.col("c") <= UNIT
    rows = rows.join(rows.where(small).groupBy("canopy").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("s")), "canopy", "left")
    unit = F.when(small, F.pmod(F.xxhash64("component"), F.col("s"))).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / UNIT))))
    rows = cut(rows.select("canopy", "node", "component", unit.alias("unit")))
    each = rows.groupBy("canopy", "unit").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    each = cut(each.select("canopy", "unit", F.when(F.col("a") == F.col("b"), F.col("a")).alias("one")))  # null if mixed
    single, other = each.where("one is not null"), each.toDF("canopy", "unit2", "two")
    mixed_pairs = each.where("one is null").join(other, "canopy").where("two is not null or unit <= unit2")
    ones = single.select("canopy", "one").distinct()
    apart = ones.join(ones.toDF("canopy", "two"), "canopy").where("one < two")
    apart = apart.join(single, ["canopy", "one"]).join(other, ["canopy", "two"])
    return rows, cut(mixed_pairs.select("canopy", "unit", "unit2").union(apart.select("canopy", "unit", "unit2")))


def _labelled(docs: DataFrame, doc_id: str, text: str, width: int, threshold: Fraction) -> DataFrame:
    """(doc_id, hash, n, component, component_id) of every row; ``hash`` is of the text, ``component`` a set's number.

    Both components are null for rows without an id or without shingles.
    """
    value = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(value).alias("hash"), value.alias("text"))
    found = _postings(rows, width, threshold, False)
    named = cut(found.where("bucket is null").select("doc_id", "hash", "node", "n"))
    firsts = cut(named.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    pick = cut(firsts.join(_may_link(found, threshold).select("node").distinct(), "node").select("node", "doc_id"))
    drop(found)

    # Every row is read again, but only texts of documents that may be linked are cut into shingles; no text is shuffled.
    again = _postings(thinned(rows, F.col("doc_id"), pick.select("doc_id")).select("doc_id", "hash", "text"), width, threshold, True)
    keyed = cut(_may_link(again, threshold))
    fewer = cut(pick.join(keyed.select("node").distinct(), "node"))
    drop(again, pick)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out: dict[int, np.ndarray] = {}
                for t in batch.column(0).slice(at, 200).to_pylist():
                    if len(h := shingles(t, width)) and (node := node_of(h)) not in seen:
                        seen.add(node)
                        out[node] = h
                own = list(out.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(map(len, own)), pa.int64()), pa.array([bitmap(h).tobytes() for h in own], pa.binary()), pa.array([h.tobytes() for h in own], pa.binary())], names=["node", "n", "map", "hashes"])

    sets = cut(thinned(rows, F.col("doc_id"), fewer.select("doc_id")).select("text").mapInArrow(hashed, "node long, n long, map binary, hashes binary"))
    keys = keyed.join(fewer.select("node"), "node").select("node", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", "lo"))
    members = cut(keys.join(shared, "key").select("key", "node", "lo").distinct())
    drop(shared, keyed, fewer)

    # Each node with its smallest leader, at first of all its groups, then of large ones that hold several components.
    rest, parts, links = members, None, None
    for at in range(ROUNDS):
        led = rest if parts is None else rest.where(F.col("m") > BLOCK)
        led = cut(led.where("node <> lo").groupBy("node").agg(F.min("lo").alias("leader")).select(F.col("leader").alias("u"), F.col("node").alias("v")))
        if parts is not None and led.isEmpty():
            break
        found_links, placed = _verified(led, sets, parts, threshold, at)
        links = found_links if links is None else links.union(found_links)
        parts = connected_components(links)
        new = _open_groups(rest.select("key", "node", "lo"), parts, placed)
        drop(rest)
        rest = new

    # What is left is compared by signatures alone; members that these leave are compared by their sets.
    units, pairs = _units(_canopies(rest.select("key", "node", "component")))
    sides = units.join(pairs, ["canopy", "unit"]).select("canopy", "unit", "unit2", "node", "component").union(units.withColumnRenamed("unit", "unit2").join(pairs.where("unit <> unit2"), ["canopy", "unit2"]).select("canopy", "unit", "unit2", "node", "component"))
    at = ["canopy", "unit", "unit2"]
    maybe = cut(sides.join(_sets_of(units, sets, "node", "n", "map"), "node").groupBy(*at).applyInArrow(_candidates(threshold), "canopy long, unit long, unit2 long, node long"))
    if not maybe.isEmpty():
        more = cut(_with_component(maybe, parts).join(_sets_of(maybe, sets), "node").groupBy(*at).applyInArrow(_links(threshold), "u long, v long"))
        parts = connected_components(links.union(more))
    drop(rest, units, pairs, maybe, sets)

    own = parts.join(firsts, "node")
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = own.select("node", "component").join(least, "component")
    labels = cut(firsts.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id")))
    linked = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    out = named.where(linked).join(labels, "node").select("doc_id", "hash", "n", "component", "component_id")
    none = F.lit(None).cast("long")
    return out.union(named.where(~linked).select("doc_id", "hash", "n", none, none))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable by links of Jaccard >= ``threshold``.

    Rows with null or wordless texts have no shingles and stay alone. Rows with equal sets are one node of the join, by
    a 64-bit hash of the set; rows with equal ids are told apart only by their texts. Ids must not be null to be linked:
    a null id keeps a null component of its own. Texts of any length are taken whole. Other columns of ``docs`` are not
    read, whatever their names. An empty table gives no rows.
    """
    found = _labelled(docs, doc_id, text, width, threshold)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs``, unchanged, less all but one of each component: the one with the smallest id and, where ids
    recur, the smallest hash of its text.

    Of rows with one id and one text a single one stays, whatever their other columns hold; rows without shingles or
    without an id are components of their own. Columns of any name are handed on with their values.
    """
    found = cut(_labelled(docs, "doc_id", "text", width, threshold))
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("f")).select("component", "f.doc_id", "f.hash")
    pairs = found.where("doc_id is not null").groupBy("doc_id", "hash").agg(F.max("component").alias("component"), F.count("*").alias("rows"))
    kept = first.select("doc_id", "hash", F.lit(True).alias("first"))
    pairs = pairs.join(kept, ["doc_id", "hash"], "left").select("doc_id", "hash", "rows", (F.col("component").isNull() | F.coalesce("first", F.lit(False))).alias("stays"))
    # Only rows that may go or recur are joined and ranked; all others are kept where they are.
    pairs = cut(pairs.where("not stays or rows > 1"))
    i, h, mark, stays, word, bits = free_names(docs, "id", "hash", "mark", "stays", "word", "bits")
    suspect = pairs.select(F.col("doc_id").alias(i), F.col("hash").alias(h), F.col("stays").alias(stays))
    key = F.xxhash64(F.col(i), F.col(h))
    own = Filter(suspect.select(key.alias("key")), "key", suspect.count(), (word, bits))
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64(F.col("text").cast("string"))})
    rows = rows.join(own.words, own.word(key) == F.col(word), "left")
    hit = own.holds(key) & F.col("doc_id").isNotNull()
    asked = rows.where(hit).drop(word, bits).join(suspect, [i, h], "left").where(F.coalesce(F.col(stays), F.lit(True)))
    asked = asked.withColumn(mark, F.row_number().over(Window.partitionBy(i, h).orderBy(h))).where(F.col(mark) == 1)
    return rows.where(~hit).select(*docs.columns).union(asked.select(*docs.columns))


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    """op6: components of three-word shingle sets at a Jaccard similarity of 0.9."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, threshold=Fraction(9, 10))
