"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are summed by membership pattern (the set of sources that hold them). A flow network routes word capacity
from patterns to source quotas; a pattern can be used several times over, each further time at a higher cost, so words
are repeated only where a quota can't be met otherwise. Documents are then picked by a seeded hash, pattern by pattern:
large ones are passed over where they don't fit, and the others are cut at one hash.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, forget, free_names

WORD = r"[^\x20\x09-\x0D]+"
#: Relative cost of a pattern's first, second and third use: convex, so no third use comes before all second uses.
COSTS = (0, 1, 4)
BUCKETS = 1 << 14
#: Documents after the cut of a pattern that may close what is left of its words.
FILLERS = 64
#: Documents above this part of a pattern's words are tried one by one: at most so many a pattern, fewer if patterns are many.
LARGE, ALL_LARGE = 1024, 1 << 20
#: Large documents that the last subset sum may take back or add, and the bits of its sums that taking back may cost.
SWAPS, BITS = 32, 1 << 22


def word_count(text: str):
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> dict:
    """Words wanted of each source: shares of the whole by weight, at most ``cap`` times a source's own size.

    What a capped source can't take is shared out again by weight until no source is above its cap.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if total * weight[s] / whole > cap * sizes[s]]
        if not over:
            return {s: out.get(s, total * weight[s] / whole) for s in names}
        for s in over:
            out[s] = float(cap * sizes[s])
        total -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in names}


def min_cost_flow(arcs: list[tuple], source, sink) -> dict[int, int]:
    """Flow on each arc (tail, head, capacity, cost) of a maximum flow of least cost, by successive shortest paths."""
    graph, to, room, price = defaultdict(list), [], [], []
    for tail, head, capacity, cost in arcs:
        graph[tail].append(len(to))
        graph[head].append(len(to) + 1)
        to += [head, tail]
        room += [capacity, 0]
        price += [cost, -cost]
    while True:
        far, by, queue, waiting = {source: 0}, {}, deque([source]), {source}
        while queue:
            waiting.discard(x := queue.popleft())
            for e in graph[x]:
                if room[e] and far[x] + price[e] < far.get(to[e], float("inf")):
                    far[to[e]], by[to[e]] = far[x] + price[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if sink not in far:
            return {i: room[2 * i + 1] for i in range(len(arcs))}
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        least = min(room[e] for e in path)
        for e in path:
            room[e] -= least
            room[e ^ 1] += least


def route(patterns: dict[tuple, int], wanted: dict, costs: Sequence[int] = COSTS) -> dict[tuple, dict]:
    """Words of each pattern that go to each of its sources. Parts of the network that share no source are solved apart."""
    parent = {s: s for s in wanted}

    def find(s):
        while parent[s] != s:
            parent[s] = s = parent[parent[s]]
        return s

    for pattern in patterns:
        for s in pattern[1:]:
            parent[find(s)] = find(pattern[0])
    parts = defaultdict(list)
    for pattern in patterns:
        if pattern:
            parts[find(pattern[0])].append(pattern)
    out = {p: {} for p in patterns}
    for group in parts.values():
        arcs, where = [], []
        for p in group:
            arcs += [("from", ("p", p), patterns[p], c) for c in costs]
            for s in p:
                where.append((len(arcs), p, s))
                arcs.append((("p", p), ("s", s), len(costs) * patterns[p], 0))
        arcs += [(("s", s), "to", round(wanted[s]), 0) for s in sorted({s for p in group for s in p}, key=lambda s: (s is None, s or ""))]
        flow = min_cost_flow(arcs, "from", "to")
        for i, p, s in where:
            out[p][s] = flow[i]
    return out


class Mix:
    """A solved mix: per source ``sizes`` and ``wanted``; ``apply`` adds each document's number of uses."""

    def __init__(self, sizes: dict, wanted: dict, rows: list[tuple], seed: int):
        self.sizes, self.wanted, self.rows, self.seed = sizes, wanted, rows, seed

    def apply(self, docs: DataFrame, doc_id: str, membership) -> DataFrame:
        """``docs`` with a column ``uses``: how many times the mix takes each row. No row is moved between tasks.

        Columns of any name keep their values; ``uses`` gets another name if there is a column of that name.
        """
        names = free_names(docs, "uses", "key", "full", "bucket", "hash", "id", "extra", "out", "place", "text")
        self.uses, key, full, bucket, cut_hash, cut_id, extra, out, place, name = names
        kinds = ("string", "int", "int", "long", "string", "array<string>", "array<string>")
        plan = docs.sparkSession.createDataFrame(self.rows, ", ".join(f"`{n}` {k}" for n, k in zip(names[1:8], kinds)))
        if len(self.rows) <= 20_000:  # about 2 MB; a longer plan is joined by key
            plan = F.broadcast(plan)
        own = docs.withColumns({key: _key(membership), place: _seeded(self.seed, doc_id), name: F.coalesce(F.col(doc_id).cast("string"), F.lit(""))})
        u, t, at = F.col(place), F.col(name), F.pmod(place, F.lit(BUCKETS))
        more = (at < F.col(bucket)) | ((at == F.col(bucket)) & ((u < F.col(cut_hash)) | ((u == F.col(cut_hash)) & (t <= F.col(cut_id)))))
        more = F.coalesce(more, F.lit(False)) & ~F.coalesce(F.array_contains(out, t), F.lit(False))
        uses = F.coalesce(F.col(full) + (more | F.coalesce(F.array_contains(extra, t), F.lit(False))).cast("int"), F.lit(0))
        return own.join(plan, key, "left").select(*docs.columns, uses.alias(self.uses))


def _members(membership):
    """The sources of a membership, sorted; a null one is the null source alone."""
    return F.array_sort(F.array_distinct(F.coalesce(membership, F.array(F.lit(None).cast("string")))))


def _key(membership):
    return F.to_json(_members(membership))


def _seeded(seed: int, doc_id: str):
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def _try_large(rows):
    """First fit of a pattern's large documents in order; what the smaller ones before a document take is in ``before``."""
    forget()
    rows = rows.sort_values(["b", "u", "t"]).reset_index(drop=True)
    rest, taken, bits, swap = int(rows["rest"].iloc[0]), [], 0, set()
    for before, size in zip(rows["before"].tolist(), rows["size"].tolist()):
        taken.append(before + size <= rest)
        rest -= size * taken[-1]
    for i in [i for i, x in enumerate(taken) if x][-SWAPS:][::-1]:
        if bits + int(rows["size"].iloc[i]) <= BITS:
            bits += int(rows["size"].iloc[i])
            swap.add(i)
    rows["taken"], rows["swap"] = taken, [i in swap or not x for i, x in enumerate(taken)]
    return rows[["key", "b", "u", "t", "size", "taken", "swap"]]


def _fill(rows):
    """The rows whose sizes come nearest to the gap from below: subset sums as bits of an integer.

    Rows with ``back`` are taken already; their sizes are added to the gap and they may be picked again. Gives the rows
    whose choice changes.
    """
    import pandas as pd

    forget()

    gap = int(rows["gap"].iloc[0]) + int(rows["size"][rows["back"]].sum())
    rows = rows[rows["size"] <= gap].sort_values(["u", "t"])
    more = rows[rows["large"] & ~rows["back"]].head(SWAPS)
    rows = pd.concat([rows[rows["back"] | ~rows["large"]], more]).sort_values(["size", "t"], ascending=[False, True])
    sums = [1]
    for n in rows["size"]:
        sums.append((sums[-1] | sums[-1] << int(n)) & ((1 << gap + 1) - 1))
    at, now = sums[-1].bit_length() - 1, [False] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        if not sums[i] >> at & 1:
            now[i] = True
            at -= int(rows["size"].iloc[i])
    rows["now"] = now
    return rows[rows["now"] != rows["back"]][["key", "t", "now"]]


def solve(docs: DataFrame, doc_id: str = "doc_id", size: str = "size", membership=None, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 17, max_patterns: int = 200_000) -> Mix:
    """Fit a mix to ``docs`` (id, size in words, array of sources).

    Sources are ordered by code point with null last and take ``weights`` in turn. A null membership counts as the null
    source; documents of an empty one belong to no source and are never taken. Patterns are summed on the cluster; their table, not the documents, comes to the driver, and more than
    ``max_patterns`` of them is an error. Rows with equal ids share one decision. An empty table gives an empty mix.
    """
    membership = F.array("source") if membership is None else membership
    base = cut(docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("t"), F.col(size).cast("long").alias("size"), _members(membership).alias("m"), _key(membership).alias("key"), _seeded(seed, doc_id).alias("u")))
    found = base.groupBy("key", "m").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns, sizes = {}, defaultdict(int)
    for r in found:
        patterns[tuple(r["m"])] = (r["key"], r["size"])
        for s in r["m"]:
            sizes[s] += r["size"]
    wanted = targets(dict(sizes), weights, cap)
    flow = route({p: n for p, (_, n) in patterns.items()}, wanted)
    need = []
    for p, (key, n) in patterns.items():
        taken = sum(flow[p].values())
        full = min(taken // n, cap) if n else 0
        need.append((key, int(full), int(taken - full * n)))
    spark = docs.sparkSession
    near = F.broadcast if len(need) <= 20_000 else (lambda df: df)
    part = max(FILLERS, min(LARGE, ALL_LARGE // max(1, len(need))))
    words = dict(patterns.values())
    ask = near(spark.createDataFrame([(k, r, words[k]) for k, _, r in need if r], "key string, rest long, words long"))
    at = F.pmod("u", F.lit(BUCKETS)).cast("int")
    ids = base.groupBy("key", "u", "t").agg(F.sum("size").alias("size")).join(ask, "key")
    ids = cut(ids.select("key", at.alias("b"), "u", "t", "size", "rest", (F.col("size") * part > F.col("words")).alias("large")))
    base = ids.where("not large").drop("rest", "large")
    sums = base.groupBy("key", "b").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("b"))
    sums = cut(sums.select("key", "b", (upto - F.col("n")).alias("before"), upto.alias("after")))
    prior = F.max("after").over(Window.partitionBy("key").orderBy("b").rangeBetween(Window.unboundedPreceding, -1))
    large = ids.where("large").drop("large").unionByName(sums.select("key", "b", "after"), allowMissingColumns=True)
    large = large.withColumn("before", F.coalesce(prior, F.lit(0)).cast("long")).where("t is not null").select("key", "b", "u", "t", "size", "rest", "before")
    large = cut(large.groupBy("key").applyInPandas(_try_large, "key string, b int, u long, t string, size long, taken boolean, swap boolean"))  # at most ``part`` a pattern
    used = large.where("taken").groupBy("key").agg(F.sum("size").alias("used"))
    wants = cut(ask.join(used, "key", "left").select("key", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest")))
    whole = sums.groupBy("key").agg(F.max("after").alias("whole"))
    # Where all the smaller documents fit, the cut stands behind the last bucket.
    ends = wants.join(whole, "key", "left").where("rest >= coalesce(whole, 0)").select("key", F.lit(BUCKETS).alias("b"), F.coalesce("whole", F.lit(0)).alias("before"), "rest")
    edge = sums.join(near(wants), "key").where("before <= rest and rest < after").groupBy("key").agg(F.min("b").alias("b"), F.min_by("before", "b").alias("before"), F.first("rest").alias("rest"))
    edge = cut(edge.union(ends))  # a row for each pattern
    inner = base.join(near(edge.withColumnRenamed("b", "eb")), "key").where(F.col("b") == F.col("eb"))
    run = F.sum("size").over(Window.partitionBy("key").orderBy("u", "t").rangeBetween(Window.unboundedPreceding, 0)) + F.col("before")
    last = inner.withColumn("run", run).where("run <= rest").groupBy("key").agg(F.max(F.struct("u", "t")).alias("cut"), F.max("run").alias("run"))
    edge = cut(edge.join(last, "key", "left").select("key", "b", "cut.u", "cut.t", (F.col("rest") - F.coalesce("run", "before")).alias("gap")))
    held = near(edge.select("key", F.col("b").alias("eb"), F.col("u").alias("cu"), F.col("t").alias("ct"), "gap"))
    within = (F.col("b") < F.col("eb")) | ((F.col("b") == F.col("eb")) & F.coalesce((F.col("u") < F.col("cu")) | ((F.col("u") == F.col("cu")) & (F.col("t") <= F.col("ct"))), F.lit(False)))
    left = base.join(held, "key").where(~within).where("size > 0 and size <= gap")
    fill = left.groupBy("key", F.pmod(F.shiftright("u", 20), F.lit(FILLERS)).alias("part")).agg(F.min_by(F.struct("u", "t", "size", "gap"), F.struct("u", "t")).alias("f")).select("key", "f.*", F.lit(False).alias("back"), F.lit(False).alias("large"))
    tried = large.join(held, "key").withColumn("within", within)
    fill = fill.unionByName(tried.where("swap and gap > 0").select("key", "u", "t", "size", "gap", F.col("taken").alias("back"), F.lit(True).alias("large")))
    changed = fill.groupBy("key").applyInPandas(_fill, "key string, t string, now boolean")
    final = tried.select("key", "t", "taken", "within").join(changed, ["key", "t"], "full")
    final = final.select("key", "t", F.coalesce("now", "taken").alias("taken"), F.coalesce("within", F.lit(False)).alias("within")).where("taken <> within")
    extra = final.groupBy("key").agg(F.collect_list(F.when(F.col("taken"), F.col("t"))).alias("extra"), F.collect_list(F.when(~F.col("taken"), F.col("t"))).alias("out"))
    chosen = {r["key"]: r for r in edge.join(extra, "key", "left").collect()}
    rows = [(k, full, *((c["b"], c["u"], c["t"], c["extra"], c["out"]) if (c := chosen.get(k)) else (None,) * 5)) for k, full, _ in need]
    return Mix(dict(sizes), wanted, rows, seed)


def mix_query(spark, sf_dir: str) -> DataFrame:
    """op9: every document with the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size")))
    mix = solve(base)
    of = spark.createDataFrame([(s, mix.sizes[s], float(mix.wanted[s])) for s in mix.sizes], "s string, source_size long, target double")
    of = F.broadcast(of) if len(mix.sizes) <= 20_000 else of
    out = mix.apply(base, "doc_id", F.array("source"))
    return out.join(of, out.source.eqNullSafe(of.s)).select("doc_id", "size", "source_size", "target", (F.col("uses") * F.col("size")).cast("long").alias("taken"), "source", "uses")


def mixed_documents(spark, docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of ``docs`` and their values."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    mix = solve(sized, **options)
    out = mix.apply(docs, "doc_id", F.array(F.col("source").cast("string")))
    (copy,) = free_names(out, "copy")
    return out.where(F.col(mix.uses) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(mix.uses)))).select(*docs.columns)
