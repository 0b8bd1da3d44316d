"""Infilling, the divergence audit and main texts against plain Python, and over odd input."""

import collections
import hashlib
import itertools
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.llm import common, divergence, extract, infill, mixing

LONG = " ".join(f"w{i}é" for i in range(30_000))


def told(doc_id, text, keep=90, spm=20):
    text = text or ""
    units = re.findall(infill_units, text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= keep:
        return doc_id, n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return doc_id, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


infill_units = "[A-Za-z]+|[^A-Za-z]"
TEXTS = ["", None, "a", "  two  words\n", "𝒳a𝒳𝒳 b", "é𐍈é á𐍈", "<P> marks", "un<S", "<", "<S", "12\x00\x0034", LONG, "x" * 300_000, "ab-cd<M>"]


def test_infill(spark, monkeypatch):
    monkeypatch.setattr(infill, "HELD", 1000)
    rows = [(i, TEXTS[i % len(TEXTS)], "clash", i) for i in range(20 * len(TEXTS))] + [(3, TEXTS[3], "x", 0)] * 2 + [(None, "no id here", "x", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n long").repartition(3)
    found = infill.infill(docs)
    expected = [told(i, t) for i, t, *_ in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    back = found.select(infill.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t, *_ in rows)
    assert {r.form for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert infill.infill(docs.limit(0)).count() == 0
    assert infill.infill(docs, keep=0).where("form <> 'plain'").count() == 0


def audit(rows, least=30, prior=5, top=50):
    """The audit of (text, lang, source) rows in plain Python."""
    counts, df, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        every = collections.Counter()
        for g in groups:
            every.update(counts[g] if g[0] == lang else {})
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + prior) // (sum(c[x] for x in kept) + prior * len(kept)) for t in kept}
        p, q = share(counts[lang, source]), share(every)
        pairs = [(s, sum(abs(p[t] - x) for t, x in share(counts[l, s]).items())) for l, s in groups if l == lang and s != source]
        terms = [(t, p[t] - q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(3)
    words = ["The", "the", "naïve", "𝒳𝒳", "Éa", "éa", "b-c", "x1y", "don't", "zz", "{|}", "Q"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "z", None])) for _ in range(400)]
    rows += [(None, "en", "only null"), ("", "fr", "a"), ("rare words", "fr", "b"), ("one source", "it", "a")] + [("the same the", "en", "copies")] * 40 + [(LONG, "en", "long")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, g long").repartition(3)
    for least, top in ((30, 50), (1, 3)):
        assert sorted(map(tuple, divergence.divergence(docs, least, top=top).collect())) == audit(rows, least, top=top)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_divergence_beyond_longs(spark):
    n = 10**12
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(7 * n), F.lit(11), 5).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (7 * n + 55)


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut_equals_all_cuts(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    gain = [rng.choice([0, rng.randrange(-30, 30) / 10]) for _ in range(rng.randrange(1, n + 1))]
    edges = [(i, j, rng.randrange(0, 25) / 10) for i in range(n) for j in range(i) if rng.random() < 0.5]
    cost = lambda s: round(100 * (sum(abs(g) for i, g in enumerate(gain) if (g > 0) != s[i] and g) + sum(w for i, j, w in edges if s[i] != s[j])))
    found = extract.minimum_cut(gain, edges, n)
    least = min(map(cost, itertools.product([False, True], repeat=n)))
    assert cost(found) == least
    assert sum(found) == max(sum(s) for s in itertools.product([False, True], repeat=n) if cost(s) == least)


PAGE = """<!doctype html><html><head><title>T</title><style>p{x}</style></head><body class="has-sidebar">
<div id=header><h1>Site</h1><a href=/>Home</a></div><div id="cookie-notice">We use cookies to make this site better. By going on you agree to this.</div>
<div class='content'><h1>Title of it</h1><p>First &lt;long&gt; paragraph&nbsp;of the article with many words in it, and more.<p>Short.
<div class='share'>Share this on all networks</div><ul><li>one   point</li><li>another</ul><p>Last <b>para</b>graph <span class='ad'>buy now cheap</span> goes<br>on &amp;amp;.</div>
<div class=sidebar><h3>Recent posts</h3><ul><li><a href=1>A post about something</a><li><a href=2>Other</a></ul></div>
<section id=comments><h3>3 comments</h3><p>I really liked this article very much, thanks for writing it up for us.</p></section>
<form action=x><label>Your name</label><textarea>write here</textarea></form><script>var t = "<p>no</p>";</script><footer>&copy; 2020 Me</footer></body></html>"""
MAIN = "Title of it First <long> paragraph of the article with many words in it, and more. Short. one point another Last paragraph goes on &amp;."


@pytest.mark.parametrize(("page", "text"), [
    (PAGE, MAIN), (None, ""), ("", ""), ("plain text & more", "plain text & more"), ("<p>Hello", "Hello"), ("<p>kept <a href='x", "kept"),
    ("<nav>Menu of this</nav><script>never closed", ""), ("<p title=\"x>y\">two\n\t words</p><!-- none --", "two words"),
    ("<main><header><h1>Own title</h1></header><article><p>Para one</p><nav>1 2 3</nav><p>Two <a href=x>link</a> end</article></main><aside>no</aside>", "Own title Para one Two link end"),
    ("<article>" + "<p>word one two. <ul><li>point</ul>" * 5000, " ".join(["word one two. point"] * 5000)),
    ("<div>" * 20_000 + "<p>deep in there it lies." + "</div>" * 20_000, "deep in there it lies."),
])
def test_main_text(page, text):
    assert extract.main_text(page) == text


def test_main_texts_of_a_table(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, "x"), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    found = [tuple(r) for r in extract.main_texts(pages).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [(1, "u", MAIN), (1, "u", MAIN), (None, None, ""), (2, "v", "")]))
    assert extract.main_texts(pages.limit(0)).count() == 0


def test_pages_equal_their_articles(spark):
    import html

    for r in extract.extract_query(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        article = re.sub(r"<[^>]*(?:>|$)", " ", re.sub("</?b>", "", article))
        assert r.text == " ".join(html.unescape(article).split()) and r.n_chars == len(r.text)


def test_null_memberships_are_the_null_source(spark):
    rows = [(i, 10, None) for i in range(30)] + [(100 + i, 10, [None]) for i in range(10)] + [(200 + i, 10, ["a"]) for i in range(40)] + [(300, 10, [])]
    docs = spark.createDataFrame(rows, "doc_id long, size long, m array<string>")
    mix = mixing.solve(docs, membership=F.col("m"), weights=(1, 1))
    assert mix.sizes == {"a": 400, None: 400} and mix.wanted[None] == 400
    uses = {r.doc_id: r.uses for r in mix.apply(docs, "doc_id", F.col("m")).collect()}
    assert sum(10 * uses[i] for i in range(200) if i in uses) == 400 and min(uses[i] for i in range(30)) == 1 and uses[300] == 0
    half = mixing.solve(docs, membership=F.col("m"), weights=(3, 1))
    taken = half.apply(docs, "doc_id", F.col("m")).where("doc_id < 200").agg(F.sum(F.col("uses") * 10)).first()[0]
    assert taken == round(half.wanted[None])


def test_mixing_lets_go_of_what_a_worker_held(monkeypatch):
    """Workers are used again: what an earlier step held must not count beside the mix."""
    freed = []
    monkeypatch.setattr(common, "release", lambda: freed.append(len(common._HELD)))
    large = pd.DataFrame({"key": ["k"], "b": [1], "u": [1], "t": ["a"], "size": [3], "rest": [5], "before": [0]})
    few = pd.DataFrame({"key": ["k"], "u": [1], "t": ["a"], "size": [3], "gap": [4], "back": [False], "large": [False]})
    for run, rows, column, right in ((mixing._try_large, large, "taken", True), (mixing._fill, few, "now", True)):
        common._HELD.update(key="an earlier step", value=bytearray(10))
        assert run(rows)[column].tolist() == [right]
        assert not common._HELD and freed.pop() == 0
    assert common.trimmed(lambda a, b: a + b)(1, 2) == 3 and freed == [0]
