"""Main text of web pages: flat blocks classified by a decision tree.

A page is read once into flat text blocks, which end at every tag that is not
inline. Of each block the features are its words and link density, the same of
the block before and after, whether it is a heading, whether it stands inside the
page's article, and whether it stands inside a region named as something else. A
decision tree, grown by Gini impurity on the small labelled table below, says
which blocks are main text. They are joined in page order.

Character references are decoded, white space in a block becomes one space, and
nothing is dropped or cut otherwise. Null and empty pages give the empty text.
Broken markup is read leniently: an end tag closes up to its start tag, if any, an
article's start closes regions that are no comments, and unclosed scripts, styles and
comments reach the end of the page. Pages are read whole, one at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import small_batches

# Names of elements, and words in class, id or role that name a region.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
REGIONS = frozenset("article aside button details dialog div dl fieldset figure footer form header main menu nav ol section select table ul".split())
OTHER = frozenset("aside button dialog footer form menu nav select".split())
HINTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|buttons?|captcha|comments?|consent|cookies?|copyright|disclaimer|disqus|foot|footer|form|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|outbrain|overlay|pager|pagination|popup|promo\w*|recommended|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|taboola|tags|toolbar|topbar|widget|complementary|contentinfo|alert)(?:$|[\s_-])", re.I)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?:$|[\s_-])", re.I)

# Quantifiers give nothing back and are bounded, so that an unclosed quote or tag costs no more than a fixed number of steps.
ATTRIBUTES = r"(?:[^>\"']{1,65536}+|\"[^\"]{0,65536}+\"|'[^']{0,65536}+'){0,200}+"
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|title|noscript|template|textarea|svg|math|iframe|object|noframes)\b{ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]{{0,100}}+)(?P<rest>{ATTRIBUTES})>"
    r"|<[!?/a-zA-Z][^>]{0,8192}+>",
    re.S | re.I,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Where a block stands: outside the article, on a page without one, inside it.
OUTSIDE, NONE, INSIDE = 0, 1, 2
#: Columns: place, region named otherwise, heading, words, link density, words and link density before, and after; 1: main text.
FEATURES = ("place", "other", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")
LABELLED = [
    (2, 0, 1, 8, 0.0, 9, 0.0, 60, 0.0, 1), (2, 0, 1, 3, 0.0, 1, 1.0, 120, 0.0, 1), (2, 0, 1, 5, 0.2, 40, 0.0, 2, 0.0, 1),
    (2, 0, 0, 90, 0.0, 8, 0.0, 70, 0.0, 1), (2, 0, 0, 2, 0.0, 60, 0.0, 80, 0.0, 1), (2, 0, 0, 1, 0.0, 3, 0.0, 4, 0.0, 1),
    (2, 0, 0, 45, 0.1, 30, 0.0, 25, 0.2, 1), (2, 0, 0, 12, 0.4, 50, 0.0, 50, 0.0, 1), (2, 0, 0, 300, 0.0, 0, 0.0, 0, 0.0, 1),
    (2, 0, 0, 6, 0.0, 200, 0.0, 12, 0.1, 1), (2, 0, 0, 30, 0.5, 60, 0.0, 10, 0.9, 1), (2, 0, 0, 4, 0.0, 4, 1.0, 9, 0.0, 1),
    (2, 0, 0, 3, 1.0, 40, 0.0, 3, 1.0, 0), (2, 0, 0, 5, 1.0, 3, 1.0, 4, 1.0, 0), (2, 0, 0, 8, 0.9, 90, 0.0, 6, 1.0, 0),
    (2, 1, 0, 9, 0.0, 80, 0.0, 70, 0.0, 0), (2, 1, 0, 40, 0.0, 30, 0.0, 35, 0.0, 0), (2, 1, 1, 2, 0.0, 60, 0.0, 20, 0.0, 0),
    (2, 1, 0, 3, 1.0, 2, 1.0, 3, 1.0, 0), (2, 1, 0, 120, 0.1, 8, 0.0, 6, 0.0, 0),
    (0, 1, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (0, 1, 0, 2, 1.0, 1, 1.0, 8, 0.0, 0), (0, 1, 0, 12, 0.0, 1, 1.0, 9, 0.0, 0),
    (0, 1, 0, 25, 0.0, 50, 0.0, 0, 0.0, 0), (0, 1, 0, 90, 0.0, 80, 0.0, 40, 0.0, 0), (0, 1, 1, 4, 0.0, 90, 0.0, 30, 0.0, 0),
    (0, 0, 0, 6, 0.0, 70, 0.0, 8, 0.0, 0), (0, 0, 0, 30, 0.0, 100, 0.0, 5, 0.0, 0), (0, 0, 1, 3, 0.0, 6, 1.0, 9, 0.0, 0),
    (0, 0, 0, 80, 0.0, 3, 0.0, 90, 0.0, 0), (0, 0, 0, 2, 1.0, 2, 1.0, 2, 1.0, 0), (0, 0, 1, 6, 0.0, 2, 0.0, 50, 0.0, 0),
    (1, 1, 0, 60, 0.0, 40, 0.0, 40, 0.0, 0), (1, 1, 0, 2, 1.0, 2, 1.0, 3, 1.0, 0), (1, 1, 0, 10, 0.0, 5, 0.0, 70, 0.0, 0),
    (1, 1, 1, 3, 0.0, 8, 0.5, 20, 0.0, 0), (1, 1, 0, 120, 0.0, 30, 0.0, 4, 0.0, 0),
    (1, 0, 0, 80, 0.0, 60, 0.0, 70, 0.0, 1), (1, 0, 0, 40, 0.1, 7, 0.0, 50, 0.0, 1), (1, 0, 0, 25, 0.2, 80, 0.0, 3, 1.0, 1),
    (1, 0, 0, 16, 0.0, 2, 1.0, 60, 0.0, 1), (1, 0, 0, 7, 0.0, 60, 0.0, 75, 0.0, 1), (1, 0, 0, 5, 0.0, 45, 0.0, 40, 0.0, 1),
    (1, 0, 0, 6, 0.0, 35, 0.0, 2, 0.0, 1), (1, 0, 1, 7, 0.0, 2, 1.0, 60, 0.0, 1), (1, 0, 1, 4, 0.0, 40, 0.0, 30, 0.0, 1),
    (1, 0, 0, 3, 1.0, 2, 1.0, 3, 1.0, 0), (1, 0, 0, 20, 0.9, 3, 1.0, 5, 1.0, 0), (1, 0, 0, 60, 0.8, 3, 1.0, 4, 0.9, 0),
    (1, 0, 0, 4, 0.0, 2, 1.0, 3, 1.0, 0), (1, 0, 0, 6, 0.3, 5, 0.8, 4, 0.5, 0), (1, 0, 0, 8, 0.5, 40, 0.0, 3, 1.0, 0),
    (2, 0, 0, 70, 0.0, 60, 0.0, 3, 1.0, 1), (2, 0, 0, 5, 0.0, 50, 0.0, 4, 1.0, 1), (2, 0, 0, 18, 0.1, 2, 1.0, 2, 1.0, 1),
    (2, 0, 0, 150, 0.05, 9, 0.0, 1, 1.0, 1), (2, 0, 1, 6, 0.0, 3, 1.0, 4, 1.0, 1), (2, 0, 0, 9, 0.3, 4, 0.9, 5, 0.9, 1),
    (1, 0, 0, 65, 0.0, 70, 0.0, 3, 1.0, 1), (1, 0, 0, 130, 0.05, 30, 0.0, 2, 1.0, 1), (1, 0, 0, 90, 0.1, 2, 1.0, 2, 1.0, 1),
    (2, 0, 0, 12, 0.8, 60, 0.0, 60, 0.0, 0), (1, 0, 0, 12, 0.8, 60, 0.0, 60, 0.0, 0), (2, 0, 0, 30, 0.7, 5, 0.0, 9, 0.0, 0),
    (1, 0, 0, 5, 0.0, 3, 1.0, 2, 1.0, 0), (1, 0, 0, 3, 0.0, 0, 0.0, 3, 1.0, 0), (1, 0, 0, 8, 0.0, 50, 0.0, 3, 1.0, 1),
]


class Block(NamedTuple):
    text: str
    place: int
    other: int
    heading: int
    words: int
    links: float


class Node(NamedTuple):
    """Rows whose feature is at most the bound go to low, others to high; a leaf has a label only."""

    feature: int
    bound: float
    low: object
    high: object
    label: int


def grow(rows: list[tuple], depth: int = 8) -> Node:
    """A decision tree: at each node the split that leaves the least Gini impurity, the first of equals."""
    ones = sum(r[-1] for r in rows)
    label = int(2 * ones >= len(rows))
    best = None
    if depth and 0 < ones < len(rows):
        for f in range(len(FEATURES)):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:], strict=False):
                bound = (a + b) / 2
                low = [r for r in rows if r[f] <= bound]
                high = [r for r in rows if r[f] > bound]
                left = sum(2 * (k := sum(r[-1] for r in part)) * (len(part) - k) / len(part) for part in (low, high))
                if best is None or left < best[0] - 1e-12:
                    best = left, f, bound, low, high
    if best is None:
        return Node(-1, 0, None, None, label)
    return Node(best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1), label)


def decide(tree: Node, row: tuple) -> int:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.bound else tree.high
    return tree.label


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page in order."""
    found: list[list] = []
    # Element, named otherwise, reader comments; a region that an article's start has closed is None. Numbers of open ones
    # and of elements by name spare a look through the stack for each block or end tag.
    open_regions: list[tuple[str, bool, bool] | None] = []
    others: list[int] = []
    count: dict[str, int] = {}
    n_inside = n_remarks = 0
    parts: list[str] = []
    linked: list[str] = []
    link, heading, article = False, 0, False
    page = page or ""

    def shut(region: tuple[str, bool, bool]) -> None:
        nonlocal n_inside, n_remarks
        count[region[0]] -= 1
        n_inside -= region[0] in ("article", "main")
        n_remarks -= region[2]

    def close() -> None:
        nonlocal link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                in_links = len(html.unescape(" ".join(linked)).split())
                found.append([text, n_inside > 0, int(len(others) > 0), heading, n, min(1.0, in_links / n)])
            parts.clear()
            linked.clear()
        link = False

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if link:
                linked.append(text)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, end = name.lower(), bool(m["end"])
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                link = not end
            continue
        close()
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = 0 if end else 1
        elif name in REGIONS:
            if end:
                while count.get(name):
                    region = open_regions.pop()
                    if region:
                        shut(region)
                        if region[1]:
                            others.pop()
                        if region[0] == name:
                            break
            elif not m["rest"].rstrip().endswith("/"):
                named = " ".join(next(filter(None, x), "") for x in NAMED.findall(m["rest"])) if "=" in m["rest"] else ""
                remarks = bool(named and REMARKS.search(named))
                if name in ("article", "main"):
                    if not n_remarks:
                        for k in others:
                            shut(open_regions[k])
                            open_regions[k] = None
                        others.clear()
                    article = article or not remarks and not n_remarks
                other = remarks or name in OTHER or name == "header" and not n_inside or name not in ("article", "main") and bool(named and HINTS.search(named)) and not (n_inside and name == "header")
                if other:
                    others.append(len(open_regions))
                open_regions.append((name, other, remarks))
                count[name] = count.get(name, 0) + 1
                n_inside += name in ("article", "main")
                n_remarks += remarks
            heading = 0
    if at < len(page):
        parts.append(page[at:])
    close()
    return [Block(t, (INSIDE if inside else OUTSIDE) if article else NONE, other, h, n, links) for t, inside, other, h, n, links in found]


def main_text(page: str | None, tree: Node) -> str:
    """The blocks of a page that the tree takes for main text, joined by two line ends."""
    found, kept = blocks(page), []
    for k, b in enumerate(found):
        before = found[k - 1] if k else None
        after = found[k + 1] if k + 1 < len(found) else None
        row = (b.place, b.other, b.heading, b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0)
        if decide(tree, row):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", tree: Node | None = None) -> DataFrame:
    """The key, url, text and n_chars of each page; other columns are not read. One row for each row."""
    small_batches(pages.sparkSession)
    tree = tree or grow(LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, tree) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, url, "text", "n_chars"])

    kind = {x: pages.schema[x].dataType.simpleString() for x in (key, url)}
    return pages.select(key, url, page).mapInArrow(run, f"{key} {kind[key]}, {url} {kind[url]}, text string, n_chars long")
