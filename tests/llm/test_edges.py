"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from pathloom.llm import forest, jaccard, langid, licences, mixing, packing, pivots, quality, sharding, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, node string, `_key` string, component string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs", "en", "b", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs", "en", "b", 1),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (5, LONG, "de", "a", 9),
    (6, "12 34 !!", None, "b", 2),
    (7, "der schnelle braune Fuchs springt über den faulen Hund", "de", None, 3),
    (None, "the quick brown fox", "en", "a", 3),
    (8, "x" * 200_000, "en", "a", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, "x", "y", "z", "c") for r in ROWS], SCHEMA).repartition(2).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_language(docs, none):
    model = langid.fit(docs, langid.vocabulary_path())
    found = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(found) == 9 and langid.predict(docs, model).count() == 10
    assert [found[i]["lang_pred"] for i in (1, 3, 4, 6, 7)] == ["en", "und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    empty = langid.fit(none, langid.vocabulary_path())
    assert langid.predict(none, empty).count() == 0 and langid.predict(docs, empty).where("lang_pred <> 'und'").count() == 0
    assert langid.known_language(docs, model).columns == docs.columns
    assert langid.known_language(docs, model).where("doc_id in (3, 4, 6)").count() == 0
    assert langid.known_language(docs, empty).count() == 7


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.predict(docs, model).collect()}
    assert scores[1] > scores[7] and scores[3] == scores[4]
    assert quality.fit(docs, labels.where("false")).bias.tolist() == [0, 0]
    assert quality.predict(none, model).count() == 0 and quality.good(docs, model, least=0.0).count() == 10


def test_jaccard(docs, none):
    found = jaccard.join(docs).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert len(found) == 10 and by[1] == by[2] == (7, 1) and by[3] == (0, 3) and by[4] == (0, 4) and by[8] == (1, 8)
    assert by[5] == (29_996, 5) and by[6] == (1, 6)
    assert jaccard.join(none).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert kept.exceptAll(docs).count() == 0


def test_jaccard_keeps_clashing_columns(spark):
    names = ["id", "hash", "mark", "stays", "word", "bits", "_text", "_mark", "component"]
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "p q r s t u v"), (3, "a b c d e f g h"), (3, "a b c d e f g"), (4, None), (4, None), (None, "a b c d e f g")]
    docs = spark.createDataFrame([(*r, *[f"{n}{k}" for n in names]) for k, r in enumerate(rows)], ["doc_id", "text", *names])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=str) == sorted([(0, "a b c d e f g"), (1, "a b c d e f g"), (3, "a b c d e f g h"), (3, "p q r s t u v"), (4, None)], key=str)


def test_mixing(docs, none, spark):
    sized = docs.withColumn("size", mixing.word_count("text"))
    mix = mixing.solve(sized)
    assert set(mix.sizes) == {"a", "b", None} and mix.sizes[None] == 9
    uses = mix.apply(sized, "doc_id", F.array("source"))
    assert uses.count() == 10 and uses.agg(F.max("uses"), F.min("uses")).first() == (3, 0)
    assert uses.select("doc_id", "uses").exceptAll(mixing.solve(sized).apply(sized, "doc_id", F.array("source")).select("doc_id", "uses")).count() == 0
    assert mixing.mixed_documents(spark, docs).columns == docs.columns
    assert mixing.mixed_documents(spark, none).count() == 0


def test_packing(docs, none):
    found = packing.pack(docs, packing.tokenizer_path()).toPandas()
    assert packing.pack(none, packing.tokenizer_path()).count() == 0
    assert set(found.doc_id.dropna()) == {1, 2, 3, 4, 5, 6, 7, 8} and found.length.min() > 0
    assert found[found.doc_id.isin([3, 4])].length.tolist() == [1, 1]
    assert found.groupby("sequence_id").length.sum().max() <= 2048


def test_sharding(docs, none):
    found = sharding.hilbert_shards(docs).toPandas()
    assert len(found) == 10 and sharding.hilbert_shards(none).count() == 0
    assert found[found.doc_id == 4][["size", "text_crc32"]].values.tolist() == [[1, 0]]
    counts = found.groupby("shard").slot.agg(["count", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] == counts["count"] - 1).all() and set(counts.index) == set(range(8))


VECTORS = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (11, [3.0]), (None, [1.0, 0.0]), (100, [0.9, 0.1]), (9, [1e-300, 0.0]), (10, [float("inf"), 1.0])]


def test_vectors(spark):
    rows = spark.createDataFrame([(*r, 3) for r in VECTORS], "vec_id long, embedding array<double>, component int")
    found = pivots.near_duplicates(rows).collect()
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert len(found) == len(VECTORS) and by[1] == [(4, 1)] and by[3] == [(4, 1)] and by[9] == [(4, 1)] and sorted(by[2]) == [(0, 2), (4, 1)]
    assert all(by[i] == [(0, i)] for i in (4, 5, 6, 7, 10)) and by[None] == [(0, None)]
    assert by[8] == [(1, 8)] and by[11] == [(1, 8)]
    assert pivots.near_duplicates(rows.where("false")).count() == 0
    near = forest.search(rows, F.col("vec_id") % 100 == 0, k=10)
    found = [(r["rank"], r["vec_id"], round(r["score"], 9)) for r in near.orderBy("rank").collect()]
    assert found == [(1, 1, round(0.02**0.5, 9)), (2, 2, round(0.02**0.5, 9)), (3, 9, round(0.82**0.5, 9)), (4, 3, round(1.22**0.5, 9)), (5, 2, round(1.62**0.5, 9))]
    odd = spark.createDataFrame([(100, [1.0]), (7, [4.0]), (8, [-1e300, 1e300]), (200, [1e300, -1e300]), (100, [2.0]), (9, [2.0])], "vec_id long, embedding array<double>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in forest.search(odd, F.col("vec_id") % 100 == 0).collect())
    assert found[:6] == [(100, 1, 9, 0.0), (100, 1, 9, 1.0), (100, 2, 100, 1.0), (100, 2, 100, 1.0), (100, 3, 7, 2.0), (100, 3, 7, 3.0)]
    assert found[6][:3] == (200, 1, 8) and abs(found[6][3] / 8**0.5 / 1e300 - 1) < 1e-12 and len(found) == 7
    assert forest.search(rows.where("false"), F.lit(True)).count() == 0


def test_urls(spark):
    entries = spark.createDataFrame([("bad.org", "add", "2020-01-01"), ("bad.org", "remove", "2020-02-01"), ("bad.org", "add", "2020-02-01"), ("h.com/x", "add", "2020-01-01"), (None, "add", "2020-01-01"), ("bad.org", "add", None)], "pattern string, action string, date string").withColumn("date", F.to_date("date"))
    rows = spark.createDataFrame([(1, "http://BAD.org/", "2020-01-05", "q"), (1, "http://a.bad.org", "2020-01-05", "q"), (2, "http://bad.org", "2020-02-01", "q"), (3, "http://notbad.org", "2020-01-05", "q"), (4, "https://u@h.com:80/xyz", "2020-01-05", "q"), (5, "http://h.com/y", "2020-01-05", "q"), (6, None, "2020-01-05", "q"), (7, "", None, "q"), (8, "http://bad.org", None, "q")], "k long, url string, at string, pattern string").withColumn("at", F.to_date("at"))
    found = [(r["k"], r["blocked"]) for r in urls.filter_urls(rows, entries, "k", "url", "at").orderBy("k").collect()]
    assert found == [(1, True), (1, True), (2, False), (3, False), (4, True), (5, False), (6, False), (7, False), (8, False)]
    assert urls.filter_urls(rows.where("false"), entries, "k", "url", "at").count() == 0
    assert urls.filter_urls(rows, entries.where("false"), "k", "url", "at").where("blocked").count() == 0


def test_urls_tell_no_cases_apart(spark):
    entries = spark.createDataFrame([("Bad.org", "add", "2020-01-01"), ("bad.org", "remove", "2020-02-01")], "pattern string, action string, date string").withColumn("date", F.to_date("date"))
    rows = spark.createDataFrame([(1, "http://bad.org/" + "x" * 50_000, "2020-01-05"), (2, "http://bad.org/", "2021-01-01")], "k long, url string, at string").withColumn("at", F.to_date("at"))
    assert [r["blocked"] for r in urls.filter_urls(rows, entries, "k", "url", "at").orderBy("k").collect()] == [True, False]


def test_letters_are_no_numerals():
    assert not any(langid.LETTER.search(x) for x in ("½ ² Ⅷ ①", "12_3", "!!", "")) and all(langid.LETTER.search(x) for x in ("a", "é", "日", "ª"))


def test_mixing_keeps_clashing_columns(spark):
    names = ["_key", "key", "uses", "_uses", "size", "place", "text_", "copy", "hash"]
    docs = spark.createDataFrame([(k, " ".join(["w"] * (k % 5 + 1)), "ab"[k % 2], *[f"{n}{k}" for n in names]) for k in range(40)], ["doc_id", "text", "source", *names])
    found = mixing.mixed_documents(spark, docs)
    assert found.columns == docs.columns and found.distinct().exceptAll(docs).count() == 0 and found.count() > 0


def test_licence_notices_anywhere():
    scorer = licences.Scorer(licences.TEMPLATES, 10_000, {w: 9_000 for w in ("the", "of", "to", "and", "in", "is", "this", "a", "or")})
    by = dict(zip([n for n, _ in licences.TEMPLATES], [t for _, t in licences.TEMPLATES]))
    assert scorer.best("code before it\n" + max((t for n, t in licences.TEMPLATES if n == "MIT"), key=len).replace(" the ", "\n * the\n * ") + " x = 1")[1] == "MIT"
    assert scorer.best("nine words without a stop stand here before it released under the mit license and nine words more")[1] == "MIT"
    assert scorer.best("source and binary forms, with or without modification, are permitted provided that the following conditions are met")[1] == "BSD-3-Clause"
    assert scorer.best("SPDX Identifier: MIT")[1] == "MIT"
    assert [scorer.best(by[n])[1] for n in ("LGPL-2.1", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "AGPL-3.0", "GPL-2.0")] == ["LGPL-2.1", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "AGPL-3.0", "GPL-2.0"]
    assert scorer.best("the licence of poets is a permission of its own")[1] is None


def test_licences_equal_brute_force():
    import random

    rng = random.Random(4)
    scorer = licences.Scorer(licences.TEMPLATES, 1000, {"the": 900, "of": 800, "under": 100})
    pool = [w for _, t in licences.TEMPLATES for w in t.split()]
    for _ in range(60):
        own = rng.choice(licences.TEMPLATES)[1].split()
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(pool)
        text = " ".join([*rng.choices(pool, k=rng.randrange(0, 30)), *own, *rng.choices(pool, k=rng.randrange(0, 30))]).lower()
        words, parts = licences.TERM.findall(text), [licences.TERM.findall(p) for p in {text, *licences.PARAGRAPH.split(text), *licences.PASSAGE.split(text)}]
        best = (0.0, -99)
        runs = [(p, range(len(scorer.templates))) for p in parts] + [(words[i : i + n], [k]) for k, (_, _, n) in enumerate(scorer.templates) for i in range(len(words) - n + 1)]
        for run, which in runs:
            vector = scorer.vector(run) if run else {}
            best = max([best, *((sum(x * vector.get(w, 0.0) for w, x in scorer.templates[k][1].items()), -k) for k in which)])
        score, name = scorer.best(text)
        assert (abs(score - best[0]) < 1e-9 and name is not None) if best[0] >= licences.NEAR + 1e-9 else (best[0] > licences.NEAR - 1e-9 or (score, name) == (0.0, None))


def test_licences(spark):
    mit, gpl = "# Released under the MIT License.\ncode here", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "r/LICENSE", mit), (2, "r/a/b/x.py", "no words"), (3, "r/a/COPYING.txt", gpl), (4, "r/y.py", None), (5, "q/z.py", ""), (6, None, mit), (7, None, "text"), (8, "r/a/b/m.py", mit), (2, "r/a/b/x.py", "no words"), (9, "top.py", "x"), (10, "r/a/b/w.py", "y " * 50_000)]
    files = spark.createDataFrame([(*r, "c") for r in rows], "k long, path string, text string, licence string")
    found = {r["k"]: (r["own"], r["licence"], r["declared_in"]) for r in licences.scan(files, "k", "path", "text").collect()}
    assert found == {1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "r/a"), 3: ("GPL-3.0", "GPL-3.0", None), 4: (None, "MIT", "r"), 5: (None, None, None), 6: ("MIT", "MIT", None), 7: (None, None, None), 8: ("MIT", "MIT", None), 9: (None, None, None), 10: (None, "GPL-3.0", "r/a")}
    assert licences.scan(files.where("false"), "k", "path", "text").count() == 0
