"""Main text of web pages from flat text blocks, classified by a decision tree (operator 10).

A page is cut into blocks at its block-level tags.  A block has its number of words, its link density (share of words
inside links), both of its neighbours, and its place: inside an article-like container (1), inside one for menus,
adverts, notices, forms, comments and the like (-1), or neither (0).  The innermost such container counts, but nothing
inside reader comments or a hidden element is an article, and no class name makes one inside a menu, footer, form or
aside.  A class name counts by its parts; one that tells a state (``no-sidebar``, ``comments-open``) says nothing, and
words of wide meaning (``social``, ``search``) count only alone or before a word for furniture.  A decision tree, grown
here on the small labelled table below, keeps or drops each block.

Scripts, styles, form controls, comments, and markup have no text.  Character references are decoded, white space in
a block becomes one space, and the kept blocks are joined by one space in page order.

Attribute values are read whole, whatever their length, in time linear in the page.  A quote opens a value only behind
an equals sign; one without a partner on the page is an ordinary character, and a tag whose quotes leave it no end ends
at the next >.

Defined results: a null, empty or text-free page has an empty text; unclosed and misplaced tags never fail, in linear
time too; a head without an end tag ends at the first tag of the body; a page without any tag is one block.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import map_arrow

# Labelled blocks: place, words, link density, words and link density of the previous and of the next block, label.
LABELLED = """
 1   8 0.00   4 0.00  60 0.00 1
 1  60 0.00   8 0.00  45 0.00 1
 1   1 0.00  60 0.00  40 0.00 1
 1   2 0.00   1 0.00   1 0.00 1
 1 150 0.05   2 0.00   9 1.00 1
 1   6 1.00  80 0.00  30 0.00 1
 1  12 0.50  20 0.10   0 0.00 1
 1   3 0.00   5 1.00   4 1.00 1
 1  25 0.20   6 1.00   5 0.60 1
 1 400 0.01  10 0.00   3 1.00 1
 1   0 0.00  10 0.00   3 0.00 1
-1   1 1.00   1 1.00   1 1.00 0
-1  12 0.00   1 1.00   9 0.00 0
-1  80 0.00  70 0.00  60 0.00 0
-1   9 0.30  90 0.00   0 0.00 0
-1  30 0.10  40 0.00  45 0.00 0
-1   4 0.00   0 0.00  12 0.00 0
-1   6 0.00  50 0.00   4 1.00 0
-1 200 0.00 150 0.00   3 0.00 0
-1   2 0.50  12 0.00   8 0.00 0
-1   4 0.00   0 0.00  60 0.00 0
-1   7 0.00   1 1.00  45 0.00 0
-1   5 0.00  70 0.00  80 0.00 0
-1  14 0.00  40 0.00  90 0.00 0
-1  10 0.10   3 0.00  50 0.00 0
-1   3 0.00  12 0.00  38 0.00 0
 0   1 1.00   0 0.00   1 1.00 0
 0   1 1.00   1 1.00   1 1.00 0
 0   3 1.00   2 1.00  70 0.00 0
 0   4 0.75   3 1.00   5 1.00 0
 0  14 0.80  60 0.00   3 1.00 0
 0  25 0.60   5 1.00   4 1.00 0
 0   5 0.00   1 1.00   4 1.00 0
 0   6 0.20   1 1.00   2 1.00 0
 0   8 0.00   3 1.00   5 0.80 0
 0   7 0.10  60 0.00   0 0.00 0
 0   4 0.00  30 0.60   0 0.00 0
 0   6 0.00   2 0.00   5 0.00 0
 0   9 0.10   4 0.00   6 0.00 0
 0  50 0.00   8 0.00  40 0.00 1
 0  35 0.05  50 0.00  60 0.00 1
 0  18 0.00  40 0.00  30 0.00 1
 0  20 0.10  25 0.00   6 0.00 1
 0  90 0.10   1 1.00   4 1.00 1
 0  28 0.20  30 0.00  20 0.10 1
 0   6 0.00  50 0.00  60 0.00 1
 0   2 0.00  45 0.00  80 0.00 1
 0   9 0.00   1 1.00  70 0.00 1
 0  16 0.00   0 0.00   0 0.00 1
 0  22 0.00   3 1.00   5 1.00 1
"""
FEATURES = 7

# How tags are treated.
NO_TEXT = "script style noscript template textarea title select option button iframe object canvas svg math head".split()
RAW = "script style textarea title noscript template iframe svg".split()
BREAKS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section
summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BODY_TAGS = BREAKS - {"html"} | frozenset("a b em i img span strong".split())  # the first of them ends an open head
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav footer aside form header menu dialog".split())
MAIN_WORDS = frozenset("article content post entry story main".split())
OTHER_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies
consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead
topbar comment comments commentlist reply replies respond disqus discussion share sharing social related recommended
newsletter subscribe subscription signup login search popup modal overlay widget widgets pagination pager toolbar
contentinfo complementary""".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
WIDE_WORDS = frozenset("social search discussion share related signup login alert banner".split())
FURNITURE = frozenset("""links link icons icon buttons button bar box media list items item posts articles stories form widget
nav menu section area block panel wrap wrapper container body inner text message""".split()) | OTHER_WORDS
STATES = frozenset("no not has have with without hide is open closed enabled disabled off on".split())
TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*)(?:([^>\"']*)>)?)")  # its attributes too where they have no quote
STOP = re.compile(r">|=\s*[\"']")  # in a tag: its end, or the start of a quoted value
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
COMMENTS, OTHER, ASIDE = -3, -2, -1  # what a container says inside the parser; all are place -1
PART = re.compile(r"[a-z0-9]+")
END_OF = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def _words(name: str) -> set[str]:
    """The parts of a class name or id that tell a place."""
    parts = PART.findall(name.lower())
    if STATES.intersection(parts):
        return set()
    wide = len(parts) == 1 or parts[-1] in FURNITURE
    return {w for w in parts if wide or w not in WIDE_WORDS}


def _place(tag: str, attrs: str, outer: int) -> int:
    """What a container says about its content; ``outer`` is what the containers around it say."""
    if outer == COMMENTS:
        return outer
    words = set()
    for name, *values in ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            for token in value.split():
                words |= _words(token)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                or name == "style" and NO_DISPLAY.search(value):
            return COMMENTS
    if tag not in ("body", "html", "main"):
        if words & COMMENT_WORDS:
            return COMMENTS
        if words & OTHER_WORDS and tag != "article":
            return min(outer, ASIDE)
    if tag in OTHER_TAGS and not (tag == "header" and outer == 1):
        return OTHER
    if tag in MAIN_TAGS or words & MAIN_WORDS and tag not in ("body", "html") and outer != OTHER:
        return 1
    return outer


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """The place of the > that ends the tag whose attributes start at ``at``; -1 if no > is left.

    ``dead`` are the starts of values from which no > is reached outside quotes, so no part of a page is read again and
    again.
    """
    tried, here = [], at
    while (stop := STOP.search(page, here)) and stop.start() not in dead:
        if stop[0] == ">":
            return stop.start()
        tried.append(stop.start())
        here = max(stop.end(), page.find(stop[0][-1], stop.end()) + 1)
    dead.update(tried)
    return page.find(">", at)


def blocks_of(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, linked words, place) of the blocks of a page, in page order."""
    out, stack, opened = [], [], Counter()  # stack: open containers and the place before each; how many of each tag
    pieces, linked, place, link, at = [], [], 0, False, 0

    def close():
        if pieces:
            words = "".join(pieces).split()
            if words:
                out.append((" ".join(words), len(words), min(len(words), len("".join(linked).split())), max(place, -1)))
            pieces.clear()
            linked.clear()

    def add(text: str):
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            linked.append(text if link else " ")

    def leave(tag: str) -> int:
        """Closes the innermost open ``tag`` and what is open in it; the place outside."""
        while True:
            inner, outside = stack.pop()
            opened[inner] -= 1
            if inner == tag:
                return outside

    def enter(tag: str, inside: int) -> int:
        stack.append((tag, place))
        opened[tag] += 1
        return inside

    end, dead = len(page), set()
    while at < end:
        m = TAG.search(page, at)
        add(page[at:m.start() if m else end])
        if not m:
            break
        if m[0] == "<!--":
            at = page.find("-->", m.end()) + 3
            if at < 3:
                break
            continue
        tag, attrs = (m[2] or "").lower(), m[3]
        if attrs is not None:
            at = m.end()
        else:
            stop = _tag_end(page, m.end(), dead) if tag else page.find(">", m.end())
            if stop < 0:  # no tag ends any more; a comment may still start
                note = page.find("<!--", m.start())
                add(page[m.start():note if note >= 0 else end])
                break
            at, attrs = stop + 1, page[m.end():stop]
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = False
            if opened[tag]:
                close()
                place = leave(tag)
            if tag in BREAKS:
                close()
            continue
        if opened["head"] and tag in BODY_TAGS:
            close()
            place = leave("head")
        if tag in END_OF and not attrs.endswith("/"):
            gone = END_OF[tag].search(page, at)
            at = gone.end() if gone else end
        elif tag == "a":
            link = True
        elif tag in BREAKS or tag in ("head", "select", "button", "object", "canvas", "math"):
            if tag != "br":
                link = False
            close()
            if tag == "body":
                stack.clear()
                opened.clear()
                place = 0
            if tag not in VOID and tag not in ("p", "li", "td", "tr", "th", "dd", "dt") and not attrs.endswith("/"):
                place = enter(tag, COMMENTS if tag in NO_TEXT else _place(tag, attrs, place))
            elif tag in ("li", "p", "td") and attrs:
                inner = _place(tag, attrs, place)
                if inner != place:
                    place = enter(tag, inner)
    close()
    return out


def features_of(blocks: list[tuple[str, int, int, int]]) -> list[tuple[float, ...]]:
    own = [(n, linked / n) for _, n, linked, _ in blocks]
    around = [(0, 0.0), *own, (0, 0.0)]
    return [(b[3], *around[i + 1], *around[i], *around[i + 2]) for i, b in enumerate(blocks)]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int):
    """A binary tree (feature, threshold, low side, high side) by least Gini impurity; leaves are labels."""
    if depth == 0 or len(set(labels)) == 1:
        return int(labels.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            impurity = sum(m.sum() * labels[m].mean() * (1 - labels[m].mean()) for m in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return int(labels.mean() >= 0.5)
    _, f, cut, low = best
    return f, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def trained_tree(labelled: str = LABELLED, depth: int = 7):
    table = np.array([[float(x) for x in line.split()] for line in labelled.strip().splitlines()])
    return grow(table[:, :FEATURES], table[:, FEATURES], depth)


def keep(tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page or "")
    return " ".join(b[0] for b, row in zip(blocks, features_of(blocks)) if keep(tree, row))


def extract(pages: DataFrame, columns: list[str], html_col: str = "html") -> DataFrame:
    """``columns`` of ``pages`` and text, n_chars."""
    tree = trained_tree()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*columns).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, tree) for p in batch.column(0).to_pylist()]
        found = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *found], schema=pa.schema(
            [*list(batch.schema)[1:], pa.field("text", pa.string()), pa.field("n_chars", pa.int64())]))

    return map_arrow(pages.select(F.col(html_col).alias("__html"), *columns), run, schema + ", text string, n_chars bigint")
