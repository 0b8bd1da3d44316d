"""Main text of HTML pages by minimum cuts.

A page becomes blocks of text that hang in the tree of their elements. A linear classifier gives each block a cost of
being content or boilerplate: the capacities of its two terminals. Neighbours in page order, and blocks and their
elements in the tree, are tied by smoothness edges; a maximum flow then cuts content from boilerplate where that is
cheapest. Pages are independent, so Spark deals them in Arrow batches; a page's graph is bounded by the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do to text.
RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Never content: navigation, footers, asides, forms, and what a reader doesn't see as text.
NEVER = frozenset("nav footer aside form dialog menu search button select option label fieldset legend noscript template svg canvas audio video object head".split())
#: What the start of an element ends: (open elements that end, elements beyond which they are not looked for).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody"}, {"table"}), "body": ({"head"}, set()),
}
#: Words of class, id and role that mark boilerplate, content, and headers that belong to an article.
POOR = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus complementary consent contentinfo cookie cookies "
    "copyright dialog footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget alert".split()
)
RICH = frozenset("article articlebody content entry main maincontent post story".split())
OWN_HEADER = frozenset("article post entry story".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def marks(name: str, attributes: str) -> tuple[bool, int]:
    """(poor, rich) of an element: whether it marks boilerplate, and how much it speaks for content (0, 4 or 8)."""
    rich = {"article": 8, "main": 4}.get(name, 0)
    if not attributes or attributes.isspace() or name in ("html", "body"):
        return False, rich
    found = {k.lower(): html.unescape(a or b or c).lower() for k, a, b, c in ATTR.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, rich
    told = re.sub(r"\b(?:has|with|without|no|is)[-_]\w+", " ", " ".join(found.get(k, "") for k in ("class", "id", "role")))
    words = set(re.split(r"[^a-z0-9]+", told))
    poor = words & POOR
    if poor == {"header"} and (words & OWN_HEADER):
        poor = set()
    return bool(poor), max(rich, 4 if words & RICH else 0)


class Page:
    """The blocks of a page and the tree they hang in."""

    def __init__(self, source: str):
        self.parent, self.texts, self.at, self.facts = [0], [], [], []  # node 0 is the page
        self._words: list[str] = []
        self._linked = self._all = 0
        # Open elements: (name, node, never, poor, rich, links).
        self._open = [("", 0, False, False, 0, 0)]
        self._count: Counter[str] = Counter()
        for m in TOKEN.finditer(source):
            closing, name, attributes = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
            if name and m[0].endswith(">"):
                name = name.lower()
                self._end(name) if closing else self._start(name, attributes)
            elif m[0][0] != "<" or len(m[0]) == 1:
                self._text(html.unescape(m[0]))
        self._flush()

    def _text(self, text: str) -> None:
        self._words.append(text)
        size = len(text) - text.count(" ")
        self._all += size
        self._linked += size if self._open[-1][5] else 0

    def _flush(self) -> None:
        text = " ".join("".join(self._words).split())
        if text:
            name = next(o[0] for o in reversed(self._open) if o[0] in BLOCK or not o[0])
            _, node, never, poor, rich, _ = self._open[-1]
            self.texts.append(text)
            self.at.append(node)
            self.facts.append((name, never, poor, rich, self._linked / max(self._all, 1)))
        self._words, self._linked, self._all = [], 0, 0

    def _pop(self, depth: int) -> None:
        for name, *_ in self._open[depth:]:
            self._count[name] -= 1
        del self._open[depth:]

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "hr":
                self._flush()
            elif name in ("br", "img"):
                self._words.append(" ")
            return
        poor, rich = marks(name, attributes)
        block = name in BLOCK or poor or name in NEVER
        if block:
            self._flush()
        if name in BLOCK and self._count["p"]:
            self._until({"p"}, {"td", "th", "table", "button", "body", "article", "div", "section", "li"})
        if name in ENDS and any(self._count[x] for x in ENDS[name][0]):
            self._until(*ENDS[name])
        _, node, never, was_poor, was_rich, links = self._open[-1]
        if block:
            self.parent.append(node)
            node = len(self.parent) - 1
        never = never or name in NEVER or (name == "header" and not was_rich)
        self._open.append((name, node, never, was_poor or poor, max(was_rich, rich), links + (name == "a")))
        self._count[name] += 1

    def _until(self, names: set[str], beyond: set[str]) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            own = self._open[depth][0]
            if own in names:
                self._pop(depth)
                return
            if own in beyond:
                return

    def _end(self, name: str) -> None:
        if not self._count[name]:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            own, node = self._open[depth][:2]
            if own == name:
                if any(o[1] != self._open[depth - 1][1] for o in self._open[depth:]):
                    self._flush()
                self._pop(depth)
                return
            if own in BLOCK and name not in BLOCK and name not in NEVER:
                return  # a stray end of an inline element


def costs(page: Page) -> list[float]:
    """The log-odds of every block being content, from its text, its links and its elements."""
    in_article = any(rich == 8 and not poor and not never for _, never, poor, rich, _ in page.facts)
    out = []
    for text, (name, never, poor, rich, links) in zip(page.texts, page.facts):
        score = min(1.5 * math.log2(1 + max(text.count(" ") + 1, len(text) / 8)) - 3, 6)
        score += {"p": 2, "": 2, "blockquote": 2, "pre": 2, "h1": 3, "h2": 1, "h3": 1, "li": -0.5}.get(name, 0)
        score += (text[-1] in ".!?:;…。") - 8 * links - 6 * text.startswith("©")
        score += -40 if never else -20 if poor else rich
        out.append(score - 6 * (in_article and rich < 8))
    return out


def smoothness(page: Page, near: float = 0.5, own: float = 2.0, up: float = 1.0) -> tuple[list[tuple[int, int, float]], int]:
    """Edges (i, j, weight) between blocks and tree nodes, and the number of nodes; blocks come first.

    ``near`` ties neighbours in page order; ``own`` a block and the element it shares with others; ``up`` an element and
    the one above. Elements with one part stand for it and are left out.
    """
    n, used = len(page.texts), [False] * len(page.parent)
    for node in page.at:
        used[node] = True
    for node in range(len(page.parent) - 1, 0, -1):  # children come after their parents
        used[page.parent[node]] |= used[node]
    parts = Counter(page.at)
    parts.update(page.parent[node] for node in range(1, len(page.parent)) if used[node])
    stands = [0] * len(page.parent)
    for node in range(1, len(page.parent)):
        stands[node] = node if parts[node] > 1 else stands[page.parent[node]]
    edges = [(i, i + 1, near) for i in range(n - 1)]
    edges += [(i, n + stands[node], own) for i, node in enumerate(page.at)]
    edges += [(n + node, n + stands[page.parent[node]], up) for node in range(1, len(page.parent)) if used[node] and stands[node] == node]
    return edges, n + len(page.parent)


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]], nodes: int) -> list[bool]:
    """Which of ``nodes`` lie on the source's side of a minimum cut, by shortest augmenting paths in layers.

    A node with a positive ``gain`` is tied to the source by it, one with a negative gain to the sink; nodes beyond
    ``gain`` to neither. Edges hold in both directions. Of equal cuts the one with the largest source side is taken.
    Capacities are in hundredths, so that sums are exact.
    """
    source, sink = nodes, nodes + 1
    head: list[list[int]] = [[] for _ in range(nodes + 2)]
    to: list[int] = []
    cap: list[int] = []

    def tie(u: int, v: int, there: float, back: float) -> None:
        for a, b, c in ((u, v, there), (v, u, back)):
            head[a].append(len(to))
            to.append(b)
            cap.append(round(100 * c))

    for i, g in enumerate(gain):
        if g > 0:
            tie(source, i, g, 0)
        elif g < 0:
            tie(i, sink, -g, 0)
    for u, v, w in edges:
        tie(u, v, w, w)

    while True:
        level = [-1] * (nodes + 2)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        at, path, u = [0] * (nodes + 2), [], source
        while True:
            if u == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                keep = next(i for i, e in enumerate(path) if not cap[e])
                u = to[path[keep] ^ 1]
                del path[keep:]
                continue
            own = head[u]
            while at[u] < len(own) and not (cap[own[at[u]]] and level[to[own[at[u]]]] == level[u] + 1):
                at[u] += 1
            if at[u] < len(own):
                path.append(own[at[u]])
                u = to[own[at[u]]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break

    reaches = [False] * (nodes + 2)
    reaches[sink] = True
    queue = deque([sink])
    while queue:
        v = queue.popleft()
        for e in head[v]:  # e ^ 1 leads from to[e] to v
            if cap[e ^ 1] and not reaches[to[e]]:
                reaches[to[e]] = True
                queue.append(to[e])
    return [not reaches[i] for i in range(nodes)]


def main_text(source: str | None) -> str:
    """The blocks of ``source`` that are content, joined by spaces."""
    page = Page(source or "")
    content = minimum_cut(costs(page), *smoothness(page))
    return " ".join(text for text, own in zip(page.texts, content) if own)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, pages = batch.columns
        texts = pa.array([main_text(page.as_py()) for page in pages], pa.string())
        yield pa.RecordBatch.from_arrays([*keys, texts], names=[*batch.schema.names[:-1], "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html), read whole.

    Text outside of elements counts as a paragraph, so a page without markup is its own main text. A null or empty page,
    and one that holds boilerplate alone, has the text ''. Unclosed and stray elements are tolerated, an unfinished tag at
    the end is markup; character references are decoded once, and every run of Unicode white space in a block, no-break
    spaces included, becomes one space. Where two cuts cost the same, more text is kept. Null ids and urls stay null;
    repeated rows are answered one by one; other columns, whatever their names, are not read. An empty table gives no rows.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string")


def extract_query(spark, sf_dir: str) -> DataFrame:
    """op13: all pages."""
    found = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
