"""Main-text extraction: flat text blocks, judged by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  A block is described by its word count
and link density and those of both neighbours, by whether it is a heading, and by what its ancestors say:
the innermost tag with a meaning (article and main, or nav, header, footer and aside), class and id words
that name something other than content (whole names, and names in a compound such as "no-sidebar"), inside
and outside the innermost article, and the part of the page's words that the element so named holds: a
wrapper holds most of them, whatever it is called, a sidebar few.  No word list decides alone.

A decision tree, grown once from a small labelled table, says which blocks are main text.  The table comes
from the invented pages of PAGES, whose texts are marked as main or other by their part in the page.

Defined results.  Null html, and a page without main text, give an empty string.  Unclosed tags end where
an enclosing tag ends; a page cut off anywhere gives the blocks before the cut; unknown tags are
transparent.  Contents of scripts, styles, forms and other unseen tags never count.  Every row gives one
row, repeated ids too; an empty table gives an empty result; other columns are ignored.  Time grows in
proportion to a page's length, however deep its tags are nested.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema

#: Fixed values of HTML: tags without content, tags that separate blocks, tags whose content isn't text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul hr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video map head title select option button textarea form label input dialog".split())
RAW = frozenset("script style textarea title noscript iframe".split())
MAIN_TAGS, OTHER_TAGS = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "menu", "search"))
_OTHER = r"(?:ads?|adverts?|advertisement|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav\w*|menu|breadcrumbs?|header|masthead|footer|copyright|legal|sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|disqus|replies|respond|discussion|pagination|pager|tags?|meta|toolbar|skip)"
OTHER_NAME, OTHER_WORDS = re.compile(_OTHER), re.compile(rf"(?:^|[_-]){_OTHER}(?:$|[_-])")
MAIN_WORDS = re.compile(r"(?:^|[_-])(?:article|content|main|post|entry|story|body|text)(?:$|[_-])")
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: A tag with a quote that never ends: it ends at the next ">".
_BROKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
#: An attribute: its name, and its value with the quotes, if any; a quote that never ends takes in the rest of the tag.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s=/>]*)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?")
_SPACES = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: The tree's depth.
DEPTH = 10
#: Tags that end the open element of the same group without an end tag.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    state: State


class State(NamedTuple):
    """What a block's ancestors say; elements that say nothing share their parent's."""

    hidden: bool = False
    link: bool = False
    heading: bool = False
    role: int = 0  # the innermost tag with a meaning: 1 article or main, -1 navigation and such, 0 none
    inside: int = 0  # within an article or main
    strong: int = 0  # other than content by a whole name, since the innermost article or main
    weak: int = 0  # the same by a part of a name
    outer: int = 0  # either of them outside it: 2 by a whole name, 1 by a part
    main: int = 0  # a name says content, and none within it something else
    box: int = -1  # the innermost element so named


def _attributes(tag: str, rest: str) -> tuple[int, int, int, bool]:
    """What an element's attributes say: role, other (2: a whole name, 1: a part), content, and whether it is hidden."""
    role = other = main = 0
    hidden = False
    for name, value in _ATTRIBUTE.findall(rest):
        value, name = value.strip("\"'").lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "role":
            role = 1 if value in ("main", "article") else -1 if value in OTHER_ROLES else 0
        elif name in ("class", "id") and tag not in ("html", "body"):
            for own in value.split():
                if OTHER_NAME.fullmatch(own):
                    other = 2
                elif OTHER_WORDS.search(own):
                    other = max(other, 1)
                elif MAIN_WORDS.search(own):
                    main = 1
    return role, other, main, hidden


def blocks(page: str) -> tuple[list[Block], list[list[int]]]:
    """The flat text blocks of a page, in order, and the range of blocks of each named element."""
    out: list[Block] = []
    boxes: list[list[int]] = []
    stack: list[tuple[str, State, int]] = []  # tag, state, own box or -1
    places: dict[str, list[int]] = {}  # where a tag is open in the stack
    walls: list[int] = []  # where block-level tags other than p are open
    parts: list[tuple[str, bool]] = []
    state, at, n = State(), 0, len(page)

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _SPACES.sub(" ", "".join(x for x, _ in parts)).strip()
            if text:
                out.append(Block(text, len(text.split()), sum(len(x.split()) for x, linked in parts if linked), state))
            parts = []

    def close(depth: int) -> None:
        nonlocal state
        while len(stack) > depth:
            tag, _, box = stack.pop()
            places[tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            if box >= 0:
                boxes[box][1] = len(out)
        state = stack[-1][1] if stack else State()

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not state.hidden:
            parts.append((html.unescape(page[at:start]), state.link))
        if start == n:
            break
        found = _TOKEN.match(page, start) or _BROKEN.match(page, start)
        if not found:  # a bare "<"
            if not state.hidden:
                parts.append(("<", state.link))
            at = start + 1
            continue
        at = found.end()
        closing, tag, rest = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not state.hidden and tag == "br":
                parts.append((" ", state.link))
            continue
        if closing:
            depth = places[tag][-1] if places.get(tag) else -1
            if tag in BLOCK or depth >= 0 and (walls and walls[-1] > depth or places.get("p") and places["p"][-1] > depth):
                flush()
            if depth >= 0:
                close(depth)
            continue
        if tag in BLOCK:
            flush()
        if tag in _CLOSES or tag in BLOCK and stack and stack[-1][0] == "p":
            depth = max((places[x][-1] for x in _CLOSES.get(tag, ("p",)) if places.get(x)), default=-1)
            if depth >= 0 and depth >= (walls[-1] if walls else -1):
                close(depth)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if rest.endswith("/") and tag not in BLOCK:
            continue
        box, role = -1, 1 if tag in MAIN_TAGS else -1 if tag in OTHER_TAGS else 0
        told, other, main, hidden = _attributes(tag, rest) if rest else (0, 0, 0, False)
        role, hidden = told or role, hidden or tag in UNSEEN
        heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if role or other or main or hidden or heading or tag == "a":
            s = state
            if other:
                box = len(boxes)
                boxes.append([len(out), -1])
            if role == 1:
                s = s._replace(role=1, inside=1, strong=0, weak=0, outer=max(s.outer, 2 * (s.strong > 0), int(s.weak > 0)))
            elif role:
                s = s._replace(role=-1)
            s = s._replace(hidden=s.hidden or hidden, link=s.link or tag == "a", heading=s.heading or heading, main=int(main or s.main and not other))
            if other:
                s = s._replace(strong=int(s.strong or other == 2), weak=int(s.weak or other == 1), box=box)
            state = s
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK and tag != "p":
            walls.append(len(stack))
        stack.append((tag, state, box))
    flush()
    close(0)
    return out, boxes


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "role", "inside", "strong", "weak", "outer", "main", "share", "articles")


def describe(found: list[Block], boxes: list[list[int]]) -> np.ndarray:
    """The matrix of FEATURES of a page's blocks; a neighbour outside the page has no words and no links."""
    size = np.array([0, *(b.words for b in found), 0], float)
    linked = np.array([0, *(b.linked for b in found), 0], float)
    density = linked / np.maximum(1, size)
    before = np.concatenate(([0], np.cumsum((size - linked)[1:-1])))
    share = np.array([(before[b] - before[a]) / max(1, before[-1]) for a, b in boxes] + [0.0])
    own = np.array([b.state[2:-1] for b in found], float).reshape(len(found), -1)
    box = np.array([b.state.box for b in found], int)
    articles = np.full(len(found), float(any(b.state.inside and b.state.role == 1 for b in found)))
    return np.column_stack((size[1:-1], density[1:-1], size[:-2], density[:-2], size[2:], density[2:], own, share[box], articles))


#: Invented pages. "#60" stands for 60 words of main text and "~60" for 60 words of anything else.
PAGES = """
<nav><ul><li><a>~1</a><li><a>~1</a><li><a>~2</a><li><a>~1</a></ul></nav><div class="ad">~9</div><article><h1>#9</h1><p>#60<p>#35<p>#1<p>#3<p>#120<p>#15</article><footer>~8</footer>
<nav><a>~1</a> <a>~1</a></nav><article><h1>#4</h1><p>#2<p>#1</article><footer>~6</footer>
<header><a>~2</a><p>~6</p></header><nav><ul><li><a>~1</a><li><a>~1</a></ul></nav><main><h1>#6</h1><p>#40<p>#70<h2>#3</h2><p>#25<ul><li>#5<li>#9<li><a>#4</a><li><a>#6</a></ul><p>#50</main><aside><h2>~2</h2><ul><li><a>~6</a><li><a>~7</a></ul><p>~30</p></aside><footer><p>~12</p><a>~1</a> <a>~1</a></footer>
<div id="header"><h1>~3</h1></div><div id="nav"><a>~1</a> <a>~1</a> <a>~2</a></div><div id="content"><h1>#7</h1><p>#55<p>#80<p>#4<p>#90</div><div id="sidebar"><h3>~2</h3><p>~25</p><p><a>~5</a></p><p><a>~4</a></p></div><div id="footer">~11</div>
<div class="page no-sidebar"><div class="menu"><a>~1</a> <a>~1</a></div><h1>#6</h1><p>#45<p>#60<p>#8<p>#75</div><div class="footer">~9</div>
<div class="page no-sidebar"><h1>#5</h1><p>#30<p>#20<p>#2</div>
<div class="layout-sidebar-right"><article><h1>#5</h1><p>#50<p>#30<p>#2<p>#65</article><div class="sidebar"><p>~20</p><a>~4</a></div></div>
<div id="site-header-fixed"><main><h1>#8</h1><p>#33<p>#48<p>#3</main></div><div class="cookie-notice">~18</div>
<div class="meta-wrapper"><nav><a>~1</a> <a>~1</a></nav><article><h1>#5</h1><p>#28<p>#3<p>#41</article></div><footer>~7</footer>
<section class="legal-news"><h1>#7</h1><p>#40<p>#44<p>#5<p>#61</section><footer>~10</footer>
<div class="meta-wrapper"><h1>#6</h1><p>#38<p>#25<p>#7</div><div class="cookie-banner">~14 <a>~1</a></div>
<div class="header-wrapper"><div class="nav-wrapper"><a>~1</a> <a>~1</a></div><div class="entry"><h2>#6</h2><p>#52<p>#31</div></div>
<article><h1>#8</h1><p>#66<p>#40<p>#12</article><section id="comments"><h2>~2</h2><article><p>~30</p></article><article><p>~55</p></article><article><p>~80</p></article></section>
<article><h1>#8</h1><p>#36<p>#20<div class="comments"><h3>~2</h3><p>~40</p><p>~65</p><p>~90</p></div></article>
<main><h1>#5</h1><p>#50<p>#32</main><div class="comment-list"><div class="comment"><p>~45</p></div><div class="comment"><p>~70</p></div></div>
<article><div class="breadcrumbs"><a>~1</a> <a>~2</a></div><h1>#6</h1><div class="share-bar"><a>~1</a> <a>~1</a></div><p>#45<div class="ad-slot">~12</div><p>#50<p>#60<aside>~22</aside><div class="related-posts"><h3>~2</h3><a>~6</a><br><a>~7</a></div><div class="newsletter-signup"><p>~16</p></div></article>
<article><div class="post-header-meta"><p>~5</p></div><h1>#6</h1><p>#45<p>#30<div class="tags"><a>~1</a> <a>~1</a></div><div class="author-box-widget"><p>~24</p></div></article>
<div class="post"><h1>#6</h1><p>#48<p>#52<p>#3<div class="promo">~20</div><p>#39</div><div class="related"><p><a>~7</a></p><p><a>~5</a></p></div><div class="footer-links"><a>~1</a> <a>~2</a></div>
<div class="story-body"><p>#5<p>#62<p>#44</div><div class="site-footer"><p>~13</p></div>
<ul><li><a>~1</a><li><a>~2</a><li><a>~1</a></ul><h1>#6</h1><p>#40<p>#8<p>#55<p>#70<p><a>~2</a> ~1 <a>~2</a></p>
<p><a>~1</a> <a>~1</a> <a>~1</a></p><h1>#5</h1><p>#18<p>#30<p>#26<table><tr><td>#2<td>#3<tr><td>#1<td>#2</table><p>#22
<div><a>~1</a> <a>~2</a></div><div><h1>#7</h1><p>#80<p>#60<p>#90</div><div><p><a>~4</a></p><p><a>~5</a></p><p>~4</p></div>
<h1>#4</h1><p>#25<p>#31<blockquote>#14</blockquote><p>#40
<p>#1
#6
<p>#12<p>#3
<div><p>#20</p></div>
<div class="alert">~15</div><div><h1>#5</h1><p>#33<p>#47</div><div class="copyright">~7</div>
<div class="topnav"><a>~1</a> <a>~1</a></div><div class="main-content"><h1>#5</h1><p>#44<p>#28<p>#5</div><div class="sidebar-right"><p>~19</p><p>~33</p></div><div class="social">~5</div>
<div role="banner">~6</div><div role="main"><h1>#6</h1><p>#38<p>#5<p>#59</div><div role="complementary"><p>~28</p></div><div role="contentinfo">~9</div>
<div class="cookie-consent"><p>~25</p><p>~10</p></div><header>~4</header><article><header><h1>~6</h1><p>~5</p></header><p>#50<p>#45<footer>~9</footer></article>
<article><h1>#5</h1><p>#55<p>#10</article><div class="replies"><p>~12</p><p>~34</p></div><div><p><a>~6</a></p><p><a>~6</a></p></div><p>~7</p>
<div class="container"><div class="row"><div class="col"><h1>#6</h1><p>#42<p>#51<p>#2</div><div class="col widget"><h4>~2</h4><p>~17</p></div></div></div><footer><p>~20</p><p>~9</p></footer>
<div><a>~1</a> <a>~1</a></div><h1>#6</h1><p>#20 <a>#2</a> #30<p>#12 <a>#1</a> #9<p><a>#3</a> #15<p>#50 <a>#2</a> #8 <a>#1</a> #20<p>#10 <a>#4</a> #6
<div class="top-menu"><a>~1</a></div><div id="content"><h1>#4</h1><p>#40 <a>#2</a> #12<ul><li><a>#2</a> #9<li><a>#3</a> #7<li><a>#2</a> #11</ul><p>#33 <a>#1</a></div><div id="footer">~5 <a>~1</a> ~2</div>
<article><h1>#5</h1><p>#14 <a>#6</a> #10<p><a>#4</a><p>#30 <a>#2</a> #8<p>#2 <a>#3</a><div class="share">~1 <a>~2</a></div></article>
<div class="legal content"><h1>#6</h1><p>#40<p>#52<p>#5</div><footer>~8</footer>
<div class="header"><a>~1</a><div class="body"><article><h1>#6</h1><p>#33<p>#52</article></div></div><div class="sidebar"><p>~15</p></div>
<div id="page"><div class="header">~5</div><div class="columns"><p>#70<p>#6<p>#81 <a>#2</a> #5</div><p>~6 <a>~2</a></p></div>
<nav><a>~1</a></nav><div class="notice">~30</div><div class="newsletter">~20</div><footer>~8</footer>
""".strip().split("\n")
_MARK = re.compile(r"([#~])(\d+)")


def labelled(pages: list[str] | tuple = tuple(PAGES)) -> np.ndarray:
    """The labelled table: FEATURES and whether a block is main text, for each page with its texts as they are, shorter
    and longer, and for the page cut off after its middle and last main text."""
    rows = []
    for page in pages:
        ends = [m.end() for m in _MARK.finditer(page) if m[1] == "#"]
        cuts = {ends[len(ends) // 2], ends[-1]} if ends else set()
        for page, factor in [(page, 1), (page, 0.4), (page, 2.5), *((page[:end], 1) for end in sorted(cuts))]:
            found, boxes = blocks(_MARK.sub(lambda m: " ".join([m[1]] * max(1, round(int(m[2]) * factor))), page))  # noqa: B023
            rows.append(np.column_stack((describe(found, boxes), [b.text[0] == "#" for b in found])))
    return np.vstack(rows)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, left, right), or a class at a leaf."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    impurity = lambda part: len(part) * part.mean() * (1 - part.mean()) if len(part) else 0.0
    best = (impurity(y) - 1e-9, 0, 0.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            best = min(best, (impurity(y[x[:, j] < cut]) + impurity(y[x[:, j] >= cut]), j, float(cut)), key=lambda b: b[0])
    _, j, cut = best
    left = x[:, j] < cut
    if left.all() or not left.any():
        return int(y.mean() >= 0.5)
    return j, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    j, cut, low, high = tree
    left, out = x[:, j] < cut, np.empty(len(x), bool)
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


def train(table: np.ndarray | None = None):
    """The tree of a labelled table."""
    table = labelled() if table is None else table
    return grow(table[:, :-1], table[:, -1], DEPTH)


def main_text(page: str | None, tree) -> str:
    found, boxes = blocks(page or "")
    return "\n".join(b.text for b, ok in zip(found, decide(tree, describe(found, boxes)), strict=True) if ok) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    tree = train()
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
