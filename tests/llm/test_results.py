"""Results against brute force, exact round trips and held-out accuracy."""

import collections
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import forest, jaccard, langid, mixing, packing, pivots, quality, sharding, urls
from pathloom.llm.common import connected_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")


def sets(texts, width):
    out = {}
    for i, x in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        k = min(width, len(w))
        out[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset()
    return out


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_copies():
    """Texts whose similarities lie about the threshold: edits of a few bases, of many lengths."""
    rng = random.Random(3)
    out, n = {}, 0
    for size in (9, 12, 20, 45, 90, 200):
        base = [f"t{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + size // 25 + 1)):
                at = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[at] = f"e{rng.randrange(50)}"
                else:
                    words.insert(at, f"i{rng.randrange(50)}")
            out[n] = " ".join(words)
            n += 1
    return out


def test_jaccard_shuffles_only_sets_of_the_pairs(spark):
    """A round that compares one pair of 4,000 sets moves these two; all would be 5 MB."""
    store, no_quantiles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, no_quantiles, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rng = np.random.default_rng(5)
    own = [np.unique(rng.integers(0, 1 << 63, 150, np.uint64)) for _ in range(4000)]
    own[9] = own[7][1:]
    rows = [(i, len(h), bytearray(jaccard.bitmap(h).tobytes()), bytearray(h.tobytes())) for i, h in enumerate(own)]
    stored = jaccard.cut(spark.createDataFrame(rows, "node long, n long, map binary, hashes binary"))
    pairs = spark.createDataFrame([(7, 9)], "u long, v long")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        links, _ = jaccard._verified(pairs, stored, None, Fraction(9, 10))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert [tuple(r) for r in links.collect()] == [(7, 9)]
    assert 0 < moved < 1_000_000


@pytest.mark.parametrize("width,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard(spark, docs, width, t):
    texts = near_copies() | {10_000 + i: x for i, x in docs.text.items()}
    s = sets(texts, width)
    want = components(s, lambda a, b: s[a] and s[b] and len(s[a] & s[b]) * (t.numerator + t.denominator) >= t.numerator * (len(s[a]) + len(s[b])))
    found = jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), width=width, threshold=t).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(s[i]), c) for i, c in want.items()}


def test_components_by_rounds_and_in_one_task(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5), (7777, 7777)]
    want = components({x for p in pairs for x in p}, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    links = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    for few in (0, 1 << 20):
        assert {r["node"]: r["component"] for r in connected_components(links, few=few).collect()} == want
    assert connected_components(links.where("false")).count() == 0


def test_traversal_joins_all_links():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    all_sets = []
    for _ in range(80):
        own = base.copy()
        own[rng.integers(0, 60, rng.integers(0, 6))] = rng.integers(0, 1 << 63)
        all_sets.append(np.unique(own))
    t = Fraction(9, 10)
    plain = components(range(80), lambda a, b: len(np.intersect1d(all_sets[a], all_sets[b])) * 19 >= 9 * (len(all_sets[a]) + len(all_sets[b])))
    sizes, maps = np.array([len(x) for x in all_sets]), jaccard.folded([jaccard.bitmap(x) for x in all_sets])
    links = set(jaccard.traverse(sizes, maps, list(range(80)), t, all_sets))
    allowed = {frozenset(x) for x in jaccard.traverse(sizes, maps, list(range(80)), t)}
    assert all(frozenset(x) in allowed for x in links)
    assert components(range(80), lambda a, b: (a, b) in links or (b, a) in links) == plain


def test_language_forward_is_the_sum_over_segmentations():
    pieces = langid.Pieces(langid.vocabulary_path())
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(pieces.count)))

    def total(word):
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - langid.LONGEST), j):
                if word[i:j] in pieces.id:
                    sums[j] += sums[i] * math.exp(logs[pieces.id[word[i:j]]])
                elif j == i + 1:
                    sums[j] += sums[i] * math.exp(sum(logs[pieces.byte[b]] for b in word[i:j].encode()))
        return math.log(sums[-1])

    words = ["the", "segmentation", "ñandú", "日本", "a!b"]
    assert np.allclose(langid.word_logs(pieces, words, logs[:, None])[:, 0], [total("▁" + w) for w in words])


def test_language_and_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = langid.language_query(spark, sf).where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()
    found = quality.quality_query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert found.where("predicted = quality").count() >= 0.95 * found.count()


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: np.array(coder.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in docs.text.items()}
    found = packing.pack_query(spark, SF).toPandas()
    for r in found.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for by, at in (("doc_id", "start"), ("sequence_id", "offset")):
        own = found.sort_values([by, at])
        assert (own.groupby(by).length.cumsum() - own.length == own[at]).all()
    assert found.length.sum() == sum(map(len, ids.values()))
    full = found.groupby("sequence_id").length.sum()
    assert full.max() <= 2048 and full.sum() >= 0.95 * 2048 * len(full)


@pytest.mark.parametrize("text", ["don't it's WE'LL café é Á 12345 a1b2 ...", "foo\x1cbar", "<|endoftext|> x", "日本語 ﬁ a​b \u0085 z", "İstanbul ΣΑΣ 'S", "́ ̈a", "🏴‍☠️ x", "a\x00b \x0bq", ""])
def test_packing_ids(text):
    coder = packing.ids_of(packing.tokenizer_path())
    assert coder.many([text])[0] == coder.whole(text)


def test_hilbert_steps_are_neighbours(spark):
    cells = spark.createDataFrame(list(itertools.product(range(8), repeat=3)), "a int, b int, c int")
    found = sharding.hilbert(cells, ["a", "b", "c"], 3, "h").toPandas().sort_values("h")
    assert found.h.tolist() == list(range(512)) and (found[["a", "b", "c"]].diff().abs().sum(axis=1).iloc[1:] == 1).all()


def test_shards(spark, docs):
    found = sharding.shard_query(spark, SF).toPandas()
    assert all(zlib.crc32(docs.text[i].encode()) == c and len(docs.text[i].encode()) + 1 == n for i, c, n in zip(found.doc_id, found.text_crc32, found["size"]))
    assert found.groupby("shard").slot.max().tolist() == [24] * 8


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 32))
    data = np.concatenate([base, base[:100] + 0.12 * rng.standard_normal((100, 32)), base[:20], base[:1] + 0.05 * rng.standard_normal((60, 32))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    exact = pivots.unit(data.astype(float))
    linked = exact @ exact.T >= 0.95
    want = components(range(len(data)), lambda a, b: linked[a, b])
    found = {r["vec_id"]: r for r in pivots.near_duplicates(rows).collect()}
    counts = linked.sum(axis=1) - 1
    assert all(found[i]["n_links"] <= counts[i] for i in found) and sum(r["n_links"] for r in found.values()) >= 0.98 * counts.sum()
    assert sum(found[i]["component_id"] == want[i] for i in found) >= 0.98 * len(found)
    near = forest.search(rows, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for q, own in near.groupby("query_id"):
        far = np.sqrt(((data.astype(float) - data[q].astype(float)) ** 2).sum(axis=1))
        assert np.array_equal(own.sort_values("rank").score, far[own.sort_values("rank").vec_id]) and own["rank"].tolist() == list(range(1, 11))
        order = [i for i in np.lexsort((np.arange(len(far)), far)) if i != q][:10]
        hits += len(set(order) & set(own.vec_id))
    assert hits >= 0.9 * len(near) and len(near) == 240


@pytest.mark.parametrize("noise", [0.1, 0.26])
def test_vectors_of_a_dense_group(spark, noise):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    group = centre / np.linalg.norm(centre) + noise / 8 * rng.standard_normal((6_700, 64))  # cosines of about 0.99 or 0.94
    data = pivots.unit(np.concatenate([rng.standard_normal((13_300, 64)), group])).astype(np.float32)
    lists = pa.ListArray.from_arrays(np.arange(0, data.size + 1, 64, dtype=np.int32), data.reshape(-1))
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(data)), "embedding": lists}))
    found = pivots.near_duplicates(rows).toPandas().set_index("vec_id").n_links.sort_index()
    exact = pivots.unit(data.astype(float))
    counts = np.concatenate([(exact[k : k + 2000] @ exact.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(data), 2000)])
    assert (found.values <= counts).all() and found.sum() >= 0.999 * counts.sum()


def test_vectors_beside_many_copies_of_one(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1, 32))
    data = np.concatenate([np.repeat(rng.standard_normal((1, 32)), 3_000, axis=0), base + 0.05 * rng.standard_normal((4, 32))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(rows).collect()}
    assert all(found[i] == (2_999, 0) for i in range(3_000)) and all(found[i] == (3, 3_000) for i in range(3_000, 3_004))


def test_urls_equal_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    assert sorted(map(tuple, urls.url_query(spark, SF).collect())) == sorted(db.execute(urls.URL_SQL).fetchall())


def test_targets():
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == {"a": 30.0, "b": 120.0, None: 60.0}
    assert mixing.targets({}) == {}


def test_flow_over_overlapping_sources():
    flow = mixing.route({("a",): 50, ("a", "b"): 100, ("b",): 10}, {"a": 60, "b": 100})
    assert sum(f.get("a", 0) for f in flow.values()) == 60 and sum(f.get("b", 0) for f in flow.values()) == 100
    used = {p: sum(f.values()) for p, f in flow.items()}
    assert used[("a",)] == 50 and used[("a", "b")] == 100 and used[("b",)] == 10  # every word once before any twice


def test_flow_of_single_sources(monkeypatch):
    solved, flow = [], mixing.min_cost_flow
    monkeypatch.setattr(mixing, "min_cost_flow", lambda *args: solved.append(args) or flow(*args))
    found = mixing.route({("a",): 50, ("b",): 10, (None,): 0}, {"a": 60.4, "b": 100, None: 0.0})
    assert found == {("a",): {"a": 60}, ("b",): {"b": 30}, (None,): {None: 0}} and len(solved) == 3


def test_mix(spark):
    found = mixing.mix_query(spark, "/root/testdata/sf0.01").toPandas()
    assert (found.taken <= 3 * found["size"]).all()
    own = found.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((own.taken - own.target).abs() <= 0.05 * own.target).all()


def test_mix_passes_over_a_long_document(spark):
    rng = random.Random(6)
    sizes = [(s, rng.randrange(20, 700)) for s in "ab" for _ in range(1500)] + [("a", 250_000), ("b", 250_000)]
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, size long").cache()
    for seed in range(3):
        mix = mixing.solve(rows, weights=(3, 1), seed=seed)
        found = mix.apply(rows, "doc_id", F.array("source")).groupBy("source").agg(F.sum(F.col("uses") * F.col("size")).alias("n")).collect()
        assert all(0.99 * mix.wanted[r["source"]] <= r["n"] <= round(mix.wanted[r["source"]]) for r in found)


def test_pipeline(spark):
    import corpus_pipeline as P

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [rows]
    for _, stage in P.STAGES[:4]:
        kept.append(P.cut(stage(spark, kept[-1], SF)))
        assert kept[-1].schema == rows.schema
    language, good, single, mixed = (k.toPandas() for k in kept[1:])
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    assert len(language) == rows.count()
    judged = language[language.doc_id.isin(labels.index)]
    assert (judged.doc_id.isin(good.doc_id) == (labels[judged.doc_id].values == 1)).mean() >= 0.95
    s = sets(dict(zip(good.doc_id, good.text)), 5)
    want = components(s, lambda a, b: s[a] and s[b] and len(s[a] & s[b]) * 9 >= 4 * (len(s[a]) + len(s[b])))
    assert sorted(single.doc_id) == sorted(set(want.values()))
    assert set(mixed.doc_id) <= set(single.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    packed = P.STAGES[4][1](spark, kept[4], SF).toPandas()
    assert set(packed.doc_id) == set(mixed.doc_id)
