"""Main text of web pages by a tree-structured graphical model.

Each node of a page's block tree (elements and leaves of text) is 1 if it is content or holds some, else 0.  A node's
own features give its log-odds; the edge from its parent has a potential for each pair of labels, by kind of child
(element or leaf).  On a tree, sum-product message passing is exact: one pass upward and one downward yield every
node's marginal, and leaves with a content marginal over one half are the main text, in page order.  Both passes run
level by level over all trees of a batch.

Weights and potentials are fitted together by maximum likelihood, with the expectations from the same two passes.
Labelled pages are (a) a bounded set composed of marked fragments (``labelled_pages``) and (b) a bounded random sample
(``SAMPLE_PAGES``) of the pages themselves, whose labels are the authors' own sectioning elements, where they use
them.  Features of tags and names are hidden at a share of the training nodes, so that no single one decides.

Defined results: null and empty html, and pages without content leaves, have the empty text; white space (also from
character references) within a block becomes one space; repeated rows get equal results; an empty table has an empty result; nothing is cut or capped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_tree import Node, parse
from .shared import map_text

SAMPLE_PAGES, MADE_PAGES = 200, 600
#: Weight decay, rounds of the fit, and the share of section and name features that it does not see.
_L2, _ROUNDS, _BLANKED = 1.0, 150, 0.15
_ENDS = ".!?:;…”\"'。"

#: Name parts (of class, id and role) by what they tell of a node.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc topbar",
    "head": "header masthead banner logo brand sitehead topnav hero",
    "foot": "footer foot bottom colophon copyright legal credits contentinfo",
    "side": "sidebar side aside widget rail complementary related recommended recommendations popular trending more",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion dfp adsense",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter paywall signup dialog toast message warning",
    "form": "form search login searchbox comment-form contact",
    "reader": "comment comments reply replies discussion disqus respond responses reviews feedback",
    "share": "share sharing social follow tools toolbar meta tags byline author",
    "main": "content article main post entry story text articlebody body maincontent page-content prose",
}
_BY_NAME = {part: kind for kind, parts in NAMES.items() for part in parts.split()}
_SECTIONS = {"nav": 0, "header": 0, "footer": 0, "aside": 0, "form": 0, "article": 1, "main": 1}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(4096)
def name_kinds(names: str) -> tuple[str, ...]:
    return tuple(sorted({_BY_NAME[p] for x in _PART.findall(names) if (p := x.lower()) in _BY_NAME}))


_SIZES, _LEAF_SIZES, _LINKS = (1, 25, 100, 400, 1500), (10, 25, 60, 150, 400), (0.01, 0.25, 0.5, 0.8)


def node_keys(nodes: list[Node]) -> list[tuple]:
    """What the features of each node follow from; few different keys occur."""
    out: list[tuple] = []
    for node in nodes:
        links = bisect_right(_LINKS, node.linked / node.length) if node.linked else 0
        if node.tag:
            out.append((node.tag, bisect_right(_SIZES, node.length), links, node.names))
        else:
            text = node.text
            out.append(("", bisect_right(_LEAF_SIZES, node.length), links, nodes[node.parent].tag, text[-1] in _ENDS, "©" in text or "ights reserved" in text))
    return out


def features(key: tuple) -> list[str]:
    """Names of a node's features."""
    if key[0]:
        return ["element", f"tag {key[0]}", f"size {key[1]}", f"links {key[2]}", *(f"name {k}" for k in name_kinds(key[3]))]
    return ["leaf", f"leaf size {key[1]}", f"leaf links {key[2]}", f"in {key[3]}", *["leaf ends"] * key[4], *["leaf rights"] * key[5]]


def _made_text(rng: np.random.Generator, words: int) -> str:
    syllables = "an be co da el fi go hi in ka lo me no or pa qui ra so ti un va we".split()
    drawn = rng.integers(0, len(syllables), (words, 3))
    made = ["".join(syllables[k] for k in row[: 1 + row[0] % 3]) for row in drawn]
    for k in range(0, words, 9):
        made[k] = made[k].capitalize()
        if k:
            made[k - 1] += "."
    return " ".join(made) + "."


#: Marked fragments of pages: W is a few words, S a sentence, P a paragraph, each made up anew; * repeats what follows in braces.
BOILERPLATE = (
    "<nav><ul>*{<li><a href='#'>W</a></li>}</ul></nav>", "<div class='menu'>*{<a href='#'>W</a> }</div>", "<ul id='main-nav'>*{<li><a href='#'>W</a>}</ul>",
    "<header><a href='/'>W</a><p>S</p></header>", "<div id='header'><h1><a href='/'>W</a></h1><p>S</p></div>", "<div class='banner'><p>S</p></div>", "<header><h2>W</h2><p>P</p></header>", "<header>P</header>", "<nav><p>P</p></nav>",
    "<footer>&copy; W &middot; S</footer>", "<footer><p>S</p><ul>*{<li><a href='#'>W</a></li>}</ul></footer>", "<div class='site-footer'><p>&copy; W. All rights reserved.</p><p>P</p></div>",
    "<aside><h3>W</h3>*{<p>S</p>}</aside>", "<aside><p>P</p></aside>", "<aside>P</aside>", "<footer>P</footer>", "<form><p>P</p></form>", "<form>P<input></form>", "<div class='footer'>P</div>", "<div class='notice'><p>P</p></div>", "<div class='sidebar'><h3>W</h3><ul>*{<li><a href='#'>W</a></li>}</ul><p>P</p></div>", "<div id='sidebar'>*{<div class='widget'><h4>W</h4><p>S</p></div>}</div>",
    "<div class='ad'>S</div>", "<div class='ad'><p>P</p></div>", "<div class='advert'><a href='#'>W</a><p>S</p></div>", "<section class='sponsored'><p>P</p></section>", "<div id='promo'>S S</div>",
    "<div class='cookie-notice'><p>P</p><button>W</button></div>", "<div class='notice'>S</div>", "<div role='dialog' class='consent'><p>S</p><p>P</p></div>", "<section class='newsletter'><h2>W</h2><p>S</p><form><input><button>W</button></form></section>",
    "<form><label>W</label><input><p>S</p></form>", "<form class='search'><p>W</p><input></form>", "<form id='contact'><fieldset><legend>W</legend><p>S</p><label>W</label><select><option>W</option></select></fieldset></form>",
    "<div class='comments'><h2>W</h2>*{<div class='comment'><p>W</p><p>P</p></div>}</div>", "<section id='comments'><h3>W</h3><ol>*{<li><p>P</p></li>}</ol></section>", "<ul class='comment-list'>*{<li>S S</li>}</ul>", "<section class='reader-comments'>*{<p>P</p>}</section>", "<div class='discussion'>*{<article class='comment'><p>P</p></article>}</div>",
    "<div class='related'><h3>W</h3>*{<p><a href='#'>S</a></p>}</div>", "<div class='share'>*{<a href='#'>W</a> }</div>", "<p class='breadcrumb'><a href='#'>W</a> / <a href='#'>W</a></p>",
)
CONTENT = (
    "<h1>W</h1>", "<h2>W</h2>", "<p>P</p>", "<p>P</p>", "<p>P P</p>", "<p>S</p>", "<p>W</p>", "<p>P <a href='#'>W</a> S</p>", "<p><b>P<br>", "<ul>*{<li>S</li>}</ul>", "<ol>*{<li>S S</li>}</ol>",
    "<blockquote><p>P</p></blockquote>", "<table>*{<tr><td>W</td><td>S</td></tr>}</table>", "<pre>S</pre>", "<figure><img><figcaption>S</figcaption></figure>", "<div><p>P</p></div>", "<section><h3>W</h3><p>P</p></section>", "<div>P</div>", "<dl>*{<dt>W</dt><dd>S</dd>}</dl>",
)
WRAPS = (
    "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div id='content'>{}</div>", "<div class='post'><div class='entry'>{}</div></div>",
    "<section class='story'>{}</section>", "<div>{}</div>", "<div><div>{}</div></div>", "<div><div>{}</div></div>", "<div><div><div>{}</div></div></div>", "{}", "<div class='article-body'>{}</div>", "<div id='page'><div class='col'>{}</div></div>", "<article class='post'>{}</article>",
)


def _filled(rng: np.random.Generator, fragment: str, label: str) -> str:
    fragment = re.sub(r"\*\{(.*?)\}(?=<|$)", lambda m: m[1] * int(rng.integers(2, 7)), fragment)
    sizes = {"W": (1, 5), "S": (5, 16), "P": (18, 90)}
    fragment = re.sub(r"\b[WSP]\b", lambda m: _made_text(rng, int(rng.integers(*sizes[m[0]]))).rstrip("." if m[0] == "W" else ""), fragment)
    return re.sub(r"^<(\w+)", rf"<\1 data-label='{label}'", fragment)


def labelled_pages(n: int = MADE_PAGES, seed: int = 5) -> list[str]:
    """Pages composed of the marked fragments; the attribute ``data-label`` says what a fragment is."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    pages = []
    for _ in range(n):
        inner = "".join(_filled(rng, pick(CONTENT), "1") + (_filled(rng, pick(BOILERPLATE), "0") if rng.random() < 0.12 else "") for _ in range(int(rng.integers(1, 3 if rng.random() < 0.3 else 9))))
        around = [_filled(rng, pick(BOILERPLATE), "0") for _ in range(int(rng.integers(0, 8)))]
        cut = int(rng.integers(len(around) + 1))
        pages.append(f"<html><body>{''.join(around[:cut])}{pick(WRAPS).format(inner)}{''.join(around[cut:])}</body></html>")
    return pages


def _labels(nodes: list[Node], sections: bool) -> np.ndarray | None:
    """1 for nodes that are content or hold some, else 0: from marks, or from sectioning elements; None if there is no content."""
    own = np.zeros(len(nodes), int)
    for k, node in enumerate(nodes):
        if k:
            own[k] = own[node.parent]
        if node.label:
            own[k] = int(node.label)
        elif sections and node.tag in _SECTIONS:
            own[k] = _SECTIONS[node.tag]
        elif sections and own[k] and set(name_kinds(node.names)) & {"ad", "menu", "notice", "reader", "side"}:
            own[k] = 0
    for k, node in enumerate(nodes):
        if node.tag:
            own[k] = 0
    for k in range(len(nodes) - 1, 0, -1):
        own[nodes[k].parent] |= own[k]
    return own if own.any() else None


class Forest:
    """Trees of a batch, one after another."""

    def __init__(self, trees: list[list[Node]]):
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in trees])]).astype(int)
        self.parent = np.concatenate([np.array([-1] + [n.parent + f for n in t[1:]], int) for t, f in zip(trees, self.first.tolist())])
        depth = np.array([n.depth for t in trees for n in t])
        self.leaf = np.array([not n.tag for t in trees for n in t]).astype(int)
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]


#: Log potential of content below a node without any: content makes all nodes above it hold content.
_NEVER = -8.0


class Model:
    """Weights by feature name, and by kind of child (element, leaf) the log potentials of (parent 1, child 0) and (1, 1)."""

    def __init__(self, weights: dict[str, float], edges: np.ndarray):
        self.weights, self.edges = weights, edges
        self.known: dict[tuple, float] = {}

    def odds(self, nodes: list[Node]) -> list[float]:
        out = []
        for key in node_keys(nodes):
            if (value := self.known.get(key)) is None:
                value = sum(self.weights.get(f, 0.0) for f in features(key))
                if len(self.known) < 100_000:
                    self.known[key] = value
            out.append(value)
        return out


def sum_product(forest: Forest, odds: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals on trees: P(node 1), and P(parent 1, child 0), P(parent 1, child 1) of the edge to each node's parent."""
    e0, e1 = edges[forest.leaf].T
    up, message = odds.copy(), np.zeros(len(odds))
    for rows in reversed(forest.levels[1:]):
        message[rows] = np.logaddexp(e0[rows], e1[rows] + up[rows]) - np.logaddexp(0, _NEVER + up[rows])
        np.add.at(up, forest.parent[rows], message[rows])
    belief, cavity = up.copy(), np.zeros(len(odds))
    for rows in forest.levels[1:]:
        c = cavity[rows] = belief[forest.parent[rows]] - message[rows]
        belief[rows] = up[rows] + np.logaddexp(_NEVER, e1[rows] + c) - np.logaddexp(0, e0[rows] + c)
    terms = np.stack([np.zeros(len(odds)), _NEVER + up, e0 + cavity, e1 + cavity + up])
    pairs = np.exp(terms - np.logaddexp.reduce(terms, axis=0))
    return 1 / (1 + np.exp(-np.clip(belief, -500, 500))), pairs[2:]


def fit(pages: list[tuple[str, bool]], seed: int = 3) -> Model:
    """Maximum likelihood by gradient: what the labels say less what sum-product expects.  Pages come with whether their sectioning elements are their labels."""
    rng = np.random.default_rng(seed)
    trees, labels = [], []
    for page, sections in pages:
        nodes = parse(page)
        if (own := _labels(nodes, sections)) is not None:
            trees.append(nodes), labels.append(own)
    forest, y = Forest(trees), np.concatenate(labels)
    index: dict[str, int] = {}
    rows, cols = [], []
    for k, key in enumerate(key for nodes in trees for key in node_keys(nodes)):
        for name in features(key):
            if name.startswith(("tag ", "name ")) and rng.random() < _BLANKED:
                continue
            rows.append(k), cols.append(index.setdefault(name, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    inner = forest.parent >= 0
    above = y[np.maximum(forest.parent, 0)] * inner
    wanted = np.array([[(above * (1 - y))[forest.leaf == k].sum(), (above * y)[forest.leaf == k].sum()] for k in (0, 1)])
    at = np.concatenate([np.zeros(len(index)), [0.0, 1.0, 0.0, 1.0]])
    m, v = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, _ROUNDS + 1):
        w, edges = at[:-4], at[-4:].reshape(2, 2)
        p, pairs = sum_product(forest, np.bincount(rows, w[cols], minlength=len(y)), edges)
        expected = np.array([[pairs[j][(forest.leaf == k) & inner].sum() for j in (0, 1)] for k in (0, 1)])
        g = np.concatenate([np.bincount(cols, (y - p)[rows], minlength=len(index)), (wanted - expected).ravel()]) - _L2 * at
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        at = at + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(index, at[:-4].tolist())), at[-4:].reshape(2, 2))


def train(pages: DataFrame, html: str = "html", sample_pages: int = SAMPLE_PAGES, made_pages: int = MADE_PAGES, seed: int = 17) -> Model:
    """Fit on the marked pages and a random sample of about ``sample_pages`` of the table's own that have a main section."""
    total = pages.count()
    sample = pages.where(F.lower(html).rlike(r"<(article|main)\b")).select(html).sample(min(1.0, sample_pages / max(total, 1)), seed).limit(2 * sample_pages)
    return fit([(p, False) for p in labelled_pages(made_pages)] + [(r[0], True) for r in sample.collect()])


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main texts of some pages; messages pass in all their trees together."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    p, _ = sum_product(forest, np.array([o for t in trees for o in model.odds(t)]), model.edges)
    return ["\n\n".join(n.text for n, q in zip(t, p[f:].tolist()) if not n.tag and q > 0.5) for t, f in zip(trees, forest.first.tolist())]


def extract_main_text(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch, column: pa.Array) -> dict[str, object]:
        texts: list[str] = []
        for k in range(0, len(column), 64):
            texts += main_texts(column.slice(k, 64).to_pylist(), sent.value)
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    schema = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_text(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), "html", schema, step)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Contract query: main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_main_text(pages, train(pages))
