"""Main text of web pages by a minimum cut.

A page is read into blocks of text. Costs of a classifier become the capacities to the two terminals
(content, boilerplate); blocks that follow each other and blocks under one parent get smoothness edges,
the stronger the nearer they are in the DOM. The maximum flow gives the cheapest cut, and the blocks on
the source's side are the text.

Costs are log odds of seven features of a block (region, class names, length, links, ending, element,
place). They and the edges are fitted to the table: marked blocks (an article's, furniture's) count as labelled
with ``TRUST``, the labels of the others are estimated by expectation-maximisation over counts of feature patterns,
of which there are at most 6,912. The fixed values below count as ``BELIEF`` blocks of prior. A mark is evidence
among others: text that looks like an article's and its neighbours speak against a class name.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.runtime import materialize

#: A comment, a tag (attributes may hold quoted ">"), or another declaration.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msubsup msup mtext q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, read up to their end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp template svg annotation annotation-xml object canvas audio video select".split())
#: An element of the first kind ends an open one of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("ul ol dl table article section div main aside nav form body html".split())
#: Elements, roles and words of class and id that mark what is not the article.
NOT_TEXT = frozenset("nav footer aside form menu dialog button fieldset noscript legend".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup privacy promo promoted promotion recommended related rail search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget".split())
COMMENTS = frozenset("comment comments commentlist disqus discussion reply replies respond responses".split())
TEXT_WORDS = frozenset("article content entry main post story text".split())
#: Words that add nothing to a class name: "ad-slot" is an "ad", but "notice-period" is not a "notice".
NEUTRAL = frozenset("area bar block bottom box button center col column container content group head holder inner item items left link links list main module outer panel placeholder post posts right row section slot top unit wrap wrapper zone".split())
OWN_LINE = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)|all rights reserved", re.I)
#: Units of capacity in a unit of cost.
UNIT = 100
#: What share of content and of boilerplate has each value of a feature, and the largest log odds a value may have.
SHARES: list[tuple[str, float, list[tuple[float, float]]]] = [
    ("region: none, article, furniture", 7.0, [(0.36, 0.35), (0.6395, 0.05), (0.0005, 0.6)]),
    ("class: none, partly furniture, furniture, comments", 7.0, [(0.949, 0.6), (0.05, 0.1), (0.0005, 0.2), (0.0005, 0.1)]),
    ("words: 1-2, 3-9, 10-39, 40 and more", 1.0, [(0.07, 0.3), (0.2, 0.35), (0.38, 0.2), (0.35, 0.15)]),
    ("linked part: none, under 0.3, under 0.8, more", 2.0, [(0.8, 0.4), (0.15, 0.05), (0.03, 0.1), (0.02, 0.45)]),
    ("end: a stop, none, a line of ownership outside the article", 7.0, [(0.7, 0.35), (0.299, 0.5), (0.001, 0.15)]),
    ("element: heading, paragraph, list, other", 1.0, [(0.12, 0.07), (0.6, 0.3), (0.13, 0.33), (0.15, 0.3)]),
    ("place: first tenth, middle, last tenth", 1.0, [(0.1, 0.25), (0.8, 0.5), (0.1, 0.25)]),
]
SIZES = [len(v) for _, _, v in SHARES]
#: Log odds of content before any feature; most that no mark of a region may add or take (pages without marks have an article too), that an article's mark, and that a stop or none, may add; blocks that the prior counts for; how sure a mark is when costs are fitted.
BIAS, NONE_MOST, ARTICLE_MOST, STOP_MOST, BELIEF, TRUST = 0.3, 0.3, 2.5, 1.0, 200.0, 0.995
#: Smoothness by steps in the DOM from a block to the next one (the last: 12 and more), then of neighbours under one parent; the range a fitted one may have.
SMOOTH = [1.5 / (1 + steps / 2) for steps in range(13)] + [1.0]
SMOOTH_RANGE = (0.1, 2.5)
#: Steps that it takes to leave an element that is marked as article or furniture.
BORDER = 3


@dataclass(slots=True)
class Element:
    """An open element: its name, a number, depth, what it marks, and whether it is in the article."""

    tag: str
    number: int
    depth: int
    bad: str  # "" / "partly" or "hint" (class or id, some or all words of a name) / "sure" / "comment"
    article: bool
    link: bool
    parent: "Element | None"


@dataclass(slots=True)
class Block:
    parts: list[str]
    holder: Element
    linked: int = 0
    text: str = field(default="")


def _open(tag: str, raw: str, parent: Element, number: int) -> Element:
    """The element that a start tag opens."""
    bad, article, link = parent.bad, parent.article, parent.link or tag == "a"
    if tag in INLINE and "hidden" not in raw:
        return Element(tag, number, parent.depth, bad, article, link, parent)
    given = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" />") else {}
    role, style = given.get("role", "").lower(), given.get("style", "").replace(" ", "").lower()
    labels = [{w.lower() for w in WORD_PARTS.findall(x)} for x in f"{given.get('class', '')} {given.get('id', '')}".split()] if tag not in ("html", "body") else []
    names = set().union(*labels)
    whole = lambda known: any(x & known and x <= known | NEUTRAL for x in labels)
    if tag in ("article", "main") or role in ("main", "article"):
        if bad in ("", "partly", "hint") and not (tag == "article" and article and parent.parent and _within(parent, "article")) and not whole(COMMENTS):
            return Element(tag, number, parent.depth + 1, "sure" if whole(NOT_WORDS) else "", True, link, parent)
        return Element(tag, number, parent.depth + 1, "comment", False, link, parent)  # an article in an article is a reader's comment
    if bad in ("", "partly", "hint"):
        if tag in NOT_TEXT or role in NOT_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or (tag == "header" and not article):
            bad = "sure"
        elif whole(COMMENTS):
            bad = "comment"
        elif whole(NOT_WORDS) or ("header" in names and not article and not names & TEXT_WORDS):
            bad = "hint"
        elif names & (NOT_WORDS | COMMENTS) and not bad:
            bad = "partly"
    return Element(tag, number, parent.depth + 1, bad, article or (bad in ("", "partly") and bool(names & TEXT_WORDS)), link, parent)


def _within(e: Element | None, tag: str) -> bool:
    while e is not None:
        if e.tag == tag:
            return True
        e = e.parent
    return False


def read_blocks(page: str) -> list[Block]:
    """The blocks of text in page order, with white space collapsed and character references decoded.

    Tolerant of missing and stray end tags: an end tag closes the nearest open element of its name, and a
    new block element ends an open paragraph.
    """
    root = Element("html", 0, 0, "", False, False, None)
    here, number, at, blocks = root, 0, 0, []
    block: Block | None = None

    def put(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            holder = here
            while holder.tag in INLINE and holder.parent is not None:
                holder = holder.parent
            block = Block([], holder)
        block.parts.append(text)
        if here.link:
            block.linked += len(text.strip())

    def end() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                blocks.append(block)
            block = None

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                end()
            e = here
            while e is not None and e.tag != tag and not (e.tag in SCOPES and tag not in SCOPES):
                e = e.parent
            if e is not None and e.tag == tag and e.parent is not None:
                here = e.parent
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at) if not m[0].endswith("/>") else None
            if not m[0].endswith("/>"):
                at = close.end() if close else len(page)
            continue
        if tag in INLINE and tag not in VOID:
            number += 1
            here = _open(tag, m[3], here, number)
            continue
        if tag not in ("img", "wbr"):
            end()
        if tag in VOID:
            continue
        for old in ENDS.get(tag, ()) or ("p",):
            e = here
            while e is not None and e.tag != old and e.tag not in SCOPES:
                e = e.parent
            if e is not None and e.tag == old and e.parent is not None:
                here = e.parent
        while here.tag in INLINE and here.parent is not None:
            here = here.parent
        number += 1
        here = _open(tag, m[3], here, number)
    put(page[at:])
    end()
    return blocks


def pattern(b: Block, i: int, n: int) -> int:
    """The values of a block's features, the i-th of n on its page, as one number."""
    bad, tag = b.holder.bad, b.holder.tag
    region = 2 if bad == "sure" else 1 if b.holder.article and bad in ("", "partly") else 0
    words = b.text.count(" ") + 1
    linked = min(1.0, b.linked / max(1, len(b.text)))
    own = region != 1 and words < 40 and OWN_LINE.search(b.text)
    values = (
        region,
        {"partly": 1, "hint": 2, "comment": 3}.get(bad, 0),
        0 if words < 3 else 1 if words < 10 else 2 if words < 40 else 3,
        0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.8 else 3,
        2 if own else 0 if b.text[-1] in ".!?…:;\"'”»)" else 1,
        0 if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 1 if tag in ("p", "pre", "blockquote", "dd", "td", "figcaption") else 2 if tag in ("li", "dt", "ul", "ol", "dl") else 3,
        1 if n < 3 else 0 if i < n / 10 else 2 if i >= n - n / 10 else 1,
    )
    code = 0
    for v, size in zip(values, SIZES):
        code = code * size + v
    return code


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (block, block, kind) between blocks that follow each other, and between neighbours under one parent; kinds as in ``SMOOTH``."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            x, y, steps = blocks[i - 1].holder, b.holder, 0
            while x is not y and steps < 12:  # the way over the nearest common ancestor; further is as good as apart
                if x.depth >= y.depth and x.parent is not None:
                    up, x = x, x.parent
                elif y.parent is not None:
                    up, y = y, y.parent
                else:
                    break
                steps += 1 if (up.bad, up.article) == (up.parent.bad, up.parent.article) else BORDER
            edges.append((i - 1, i, min(steps, 12)))
        up = b.holder.parent.number if b.holder.parent else 0
        if up in last and last[up] != i - 1:
            edges.append((last[up], i, 13))
        last[up] = i
    return edges


@dataclass(frozen=True)
class Costs:
    """Log odds of content by feature and value, before any feature, and the smoothness of each kind of edge."""

    odds: tuple[tuple[float, ...], ...]
    bias: float
    smooth: tuple[float, ...]

    def of(self, code: int) -> float:
        s = self.bias
        for values, size in zip(reversed(self.odds), reversed(SIZES)):
            code, v = divmod(code, size)
            s += values[v]
        return s

    def labels(self, blocks: list[Block]) -> list[bool]:
        """The blocks of a page that the cheapest cut takes for content."""
        codes = [pattern(b, i, len(blocks)) for i, b in enumerate(blocks)]
        return min_cut([self.of(c) for c in codes], [(a, b, self.smooth[k]) for a, b, k in edges_of(blocks)])


def _odds(content: list[np.ndarray], other: list[np.ndarray]) -> tuple[tuple[float, ...], ...]:
    out = []
    for f, ((_, most, _), x, y) in enumerate(zip(SHARES, content, other)):
        v = np.clip(np.log(x / x.sum()) - np.log(y / y.sum()), -most, most)
        v = np.r_[np.clip(v[:1], -NONE_MOST, NONE_MOST), min(v[1], ARTICLE_MOST), v[2:]] if f == 0 else np.r_[np.clip(v[:2], -STOP_MOST, STOP_MOST), v[2:]] if f == 4 else v
        out.append(tuple(float(z) for z in v))
    return tuple(out)


_FIRST = [[np.array([pair[side] for pair in v]) for _, _, v in SHARES] for side in (0, 1)]
#: The fixed values, not fitted to anything.
GIVEN = Costs(_odds(*_FIRST), BIAS, tuple(SMOOTH))


def fit_costs(pages: DataFrame, html_col: str = "html", rounds: int = 100) -> Costs:
    """Costs and edges fitted to all blocks of a table, without labels. A table without blocks gives the fixed values.

    Expectation-maximisation over the counts of feature patterns, then one pass over the edges for the expected number
    of equal and unequal ends of each kind. At most 6,912 patterns and 14 kinds of edges come to the driver.
    """

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for page in part["html"]:
                blocks = read_blocks(page or "")
                edges = edges_of(blocks)
                rows.append(([pattern(b, i, len(blocks)) for i, b in enumerate(blocks)], [e[0] for e in edges], [e[1] for e in edges], [e[2] for e in edges]))
            yield pd.DataFrame(rows, columns=["codes", "a", "b", "kind"])

    shape = materialize(pages.select(F.col(f"`{html_col}`").alias("html")).mapInPandas(shapes, "codes array<int>, a array<int>, b array<int>, kind array<int>"), "shapes")
    counted = shape.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    if not counted:
        return GIVEN
    n = np.array([r["n"] for r in counted], float)
    values = np.array(np.unravel_index([r["code"] for r in counted], SIZES))
    marked = np.where((values[0] == 2) | (values[1] >= 2), 1 - TRUST, np.where(values[0] == 1, TRUST, np.nan))
    costs = GIVEN
    for _ in range(rounds):
        s = costs.bias + sum(np.array(o)[v] for o, v in zip(costs.odds, values))
        p = np.where(np.isnan(marked), 1 / (1 + np.exp(-s)), marked)
        sides = [[BELIEF * prior + np.bincount(v, n * q, size) for prior, v, size in zip(first, values, SIZES)] for first, q in zip(_FIRST, (p, 1 - p))]
        share = (BELIEF / (1 + math.exp(-BIAS)) + (n * p).sum()) / (BELIEF + n.sum())
        new = Costs(_odds(*sides), float(np.clip(math.log(share / (1 - share)), -1, 1)), costs.smooth)
        moved = max(abs(x - y) for a, b in zip(new.odds, costs.odds) for x, y in zip(a, b))
        costs = new
        if moved < 1e-6:
            break
    known = {r["code"]: 1 / (1 + math.exp(-costs.of(r["code"]))) for r in counted}

    def equal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(SMOOTH), 2))
        for part in parts:
            for codes, a, b, kind in zip(part["codes"], part["a"], part["b"], part["kind"]):
                p = np.array([known[c] for c in codes])
                x, y, k = p[np.asarray(a, int)], p[np.asarray(b, int)], np.asarray(kind, int)
                total[:, 0] += np.bincount(k, x * y + (1 - x) * (1 - y), len(SMOOTH))
                total[:, 1] += np.bincount(k, minlength=len(SMOOTH))
        yield pd.DataFrame({"kind": range(len(SMOOTH)), "same": total[:, 0], "n": total[:, 1]})

    sums = {r["kind"]: (r["same"], r["n"]) for r in shape.mapInPandas(equal, "kind int, same double, n double").groupBy("kind").agg(F.sum("same").alias("same"), F.sum("n").alias("n")).collect()}
    smooth = []
    for k, first in enumerate(SMOOTH):
        same, count = sums.get(k, (0.0, 0.0))
        p = (BELIEF / (1 + math.exp(-first)) + same) / (BELIEF + count)
        smooth.append(round(min(max(math.log(p / (1 - p)), SMOOTH_RANGE[0]), SMOOTH_RANGE[1]), 6))
    return Costs(tuple(tuple(round(x, 6) for x in o) for o in costs.odds), round(costs.bias, 6), tuple(smooth))


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels (content or not) of least cost: what a block's own cost loses plus the edges cut. Ties are boilerplate."""
    c = [round(UNIT * x) for x in costs]
    near: dict[tuple[int, int], int] = {}
    for a, b, w in edges:
        if a != b and (w := round(UNIT * w)) > 0:
            key = (min(a, b), max(a, b))
            near[key] = near.get(key, 0) + w
    inside = _source_side(c, near)
    return [i in inside for i in range(len(c))]


def _source_side(c: list[int], near: dict[tuple[int, int], int]) -> set[int]:
    """Maximum flow by shortest augmenting levels; what the source still reaches afterwards."""
    n = len(c)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i, x in enumerate(c):
        if x > 0:
            arc(source, i, x, 0)
        elif x < 0:
            arc(i, sink, -x, 0)
    for (i, j), w in near.items():
        arc(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return {a for a in range(n) if level[a] >= 0}
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                path, a = [], source
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None, costs: Costs = GIVEN) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none."""
    blocks = read_blocks(page or "")
    return "\n".join(b.text for b, k in zip(blocks, costs.labels(blocks)) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", costs: Costs | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each row and its number of code points.

    ``costs`` are fitted to the table where none are given. Null and empty pages give an empty text; nothing is dropped
    or shortened, whatever the length of a page. Null ids and urls stay null, repeated rows give repeated results,
    other columns are not read. An empty table gives an empty result.
    """
    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    fitted = costs or fit_costs(src)

    @F.pandas_udf("string")
    def text(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in column:
            yield pd.Series([main_text(x, fitted) for x in c], dtype=object)

    return src.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def cut_changes(pages: DataFrame, costs: Costs, html_col: str = "html") -> DataFrame:
    """``blocks, changed, pages_changed``: blocks in all, blocks whose label in the cut is not the sign of their own cost, and pages with such blocks."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for page in part["html"]:
                blocks = read_blocks(page or "")
                own = [costs.of(pattern(b, i, len(blocks))) > 0 for i, b in enumerate(blocks)]
                rows.append((len(blocks), sum(x != y for x, y in zip(own, costs.labels(blocks)))))
            yield pd.DataFrame(rows, columns=["blocks", "changed"])

    each = pages.select(F.col(f"`{html_col}`").alias("html")).mapInPandas(count, "blocks long, changed long")
    return each.agg(F.sum("blocks").alias("blocks"), F.sum("changed").alias("changed"), F.count_if(F.col("changed") > 0).alias("pages_changed"))
