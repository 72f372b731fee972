"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser feeds blocks: runs of text between block-level tags, each with its characters,
those within links, and its number of tags. Each block's ratio of unlinked characters to tags is smoothed with
a Gaussian along the page; blocks at or above one standard deviation form the content clusters.

Names of elements and classes only hint. A class is read as a compound: it names the part by its last word ("cookie-notice"),
or by its first if only words for containers follow ("comments-section"); "share-prices" or "ad-free-reading" name no
part. A part that is called a menu, an advert, comments and so on goes as long as there is content outside such
parts: an article or main element, a first heading, or a fair share of all unlinked text. While there is none of
these, the part with such a heading or else with the most text is taken for a wrapper and opened, so what wraps the whole
page loses nothing, whatever it is called. A part that a compound's last word alone names is opened, too, if it holds
a large share of the text. What goes takes no part in the ratios.

Of what is left, the clusters choose: their own blocks; those of an article or main element that holds
clusters, and of a container with a cluster right in it; what stands between clusters or between the first heading and them;
headings before any of these; and sentences that follow the last cluster in or beside the part around it.
Blocks that are links for the most part are kept only in articles.

Defined cases: null and empty pages have empty text; pages without clusters give what blocks are left;
markup that never closes is closed by its parents; nesting of any depth takes linear time and space;
repeated rows repeat; pages of any length are read whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Width of the smoothing in blocks; the share of unlinked text that counts as content outside hinted parts; the share of it from which a faintly hinted part is content.
SIGMA, REST, LARGE = 1.0, 0.25, 0.34
#: Elements by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead title tr ul option select".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template button select textarea iframe object svg canvas".split())
HINTED = frozenset("nav aside form dialog menu footer".split())
CONTAINERS = frozenset("body div section article main td center".split())
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS_P = frozenset("div section article main body td th li table blockquote form nav aside header footer".split())
HOLDS_ITEMS = frozenset("ul ol dl table select menu".split())
NO_END_OF_P = frozenset("option select title head html body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus disclaimer gdpr login menu modal nav navbar navigation "
    "newsletter notice notices pager pagination paywall popup promo promoted promotion related replies respond search share sharing shares sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
#: Of these, names that leave no doubt at the end of a compound either.
PLAINLY = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer nav navbar navigation pager pagination replies sidebar sidebars".split())
PARTS_OUTSIDE = frozenset("header footer masthead topbar bottom".split())
#: Words that say no more than that something is held together.
HOLDERS = frozenset("area bar block body bottom box btn button buttons cell col column container content desktop feed fixed foot form group head header icon icons inner item items left link links list main mobile module outer page panel "
                    "popup right row section sections site slot sticky strip tab title top unit wrap wrapper zone".split())  # fmt: skip
QUALIFIERS = frozenset("has no with without is not".split())
_PIECES, _HIDDEN = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])"), re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SENTENCE = re.compile(r"\w.*[.!?…。][\"'”’»)]*$")
_REACH = int(3 * SIGMA + 0.5)
KERNEL = np.exp(-0.5 * (np.arange(-_REACH, _REACH + 1) / SIGMA) ** 2)
KERNEL /= KERNEL.sum()


def hinted(tag: str, attrs: list, inside: bool) -> int:
    """Whether an element calls itself something other than content: 2 plainly, 1 by the last word of a compound only. inside: within an article or main element, which have headers and footers of their own."""
    if tag in HINTED or (tag == "header" and not inside):
        return 2
    names = PARTS if inside else PARTS | PARTS_OUTSIDE
    faint = 0
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        if not value:
            continue
        if (name == "role" and value.lower() in ROLES) or (name == "style" and _HIDDEN.search(value)):
            return 2
        if name in ("class", "id"):
            for token in value.split():
                pieces = [x for x in (x.lower() for x in _PIECES.split(token)) if x and not x.isdigit()]
                if not pieces or pieces[0] in QUALIFIERS:
                    continue
                rest = [x for x in pieces if x not in names]
                if pieces[-1] in PLAINLY & names or (pieces[0] in names or pieces[-1] in names) and all(x in HOLDERS for x in rest):
                    return 2
                if pieces[-1] in names:
                    faint = 1
    return faint


class Blocks(HTMLParser):
    """Blocks of a page, and the nodes they lie in: containers and hinted elements, each with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[int, str, int]] = [(-1, "", 0)]  # parent, tag, hint
        self.stack: list[tuple] = []  # (tag, silent, node, within an article or main, within a link)
        self.open: Counter = Counter()
        self.blocks: list[tuple[str, int, int, int, str]] = []  # text, linked characters, tags, node, heading or ""
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _state(self) -> tuple:
        return self.stack[-1] if self.stack else ("", False, 0, False, False)

    def finish_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.linked, self.tags, self._state()[2], next((h for h in HEADINGS if self.open[h]), "")))
            self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self.finish_block()
            elif tag == "br":
                self.parts.append(" ")
            self.tags += 1
            return
        if tag in BLOCKS:
            self.finish_block()
            if tag not in NO_END_OF_P:
                self._implied(("p",), HOLDS_P)
            if tag in SIBLINGS:
                self._implied(SIBLINGS[tag], HOLDS_ITEMS)
        _, silent, node, inside, link = self._state()
        hint = 0 if silent or tag in ("html", "body", "article", "main") else hinted(tag, attrs, inside)
        if hint or tag in CONTAINERS:
            self.nodes.append((node, tag, hint))
            node = len(self.nodes) - 1
        self.stack.append((tag, silent or tag in SILENT, node, inside or tag in ("article", "main"), link or tag == "a"))
        self.open[tag] += 1
        self.tags += 1

    def _cut(self, at: int) -> None:
        """Closes the element at that place of the stack and all in it."""
        self.open.subtract(x[0] for x in self.stack[at:])
        del self.stack[at:]

    def _implied(self, tags: tuple, until: frozenset) -> None:
        """The end tags that a new block stands for."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self._cut(i)
                return
            if self.stack[i][0] in until:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.finish_block()
        if self.open[tag]:
            self._cut(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))

    def handle_data(self, data: str) -> None:
        _, silent, _, _, link = self._state()
        if not silent:
            self.parts.append(data)
            if link:
                self.linked += len(data.strip())


def content(ratios: np.ndarray) -> np.ndarray:
    """Which blocks lie in content clusters."""
    if not len(ratios):
        return np.zeros(0, bool)
    padded = np.pad(ratios, _REACH, mode="edge")
    smooth = np.convolve(padded, KERNEL, mode="valid")
    return (smooth >= ratios.std()) & (smooth > 0)


def left_out(nodes: list[tuple[int, str, int]], of: list[int], mass: list[float], first: list[bool]) -> list[bool]:
    """For each node whether it lies in a hinted part that goes. Of the blocks: their nodes; their unlinked characters; whether they are a first heading."""
    part, in_article = [-1] * len(nodes), [False] * len(nodes)  # the innermost hinted node of each
    own, mains, parts = [0.0] * len(nodes), [False] * len(nodes), [[] for _ in nodes]
    for i, (parent, tag, hint) in enumerate(nodes):
        part[i] = i if hint else part[parent] if parent >= 0 else -1
        in_article[i] = tag in ("article", "main") or (parent >= 0 and in_article[parent])
        if hint and part[parent] >= 0:
            parts[part[parent]].append(i)
    free, main = 0.0, False  # what is in no hinted part
    for n, m, h in zip(of, mass, first, strict=True):
        is_main = h or in_article[n]
        if part[n] < 0:
            free, main = free + m, main or is_main
        else:
            own[part[n]], mains[part[n]] = own[part[n]] + m, mains[part[n]] or is_main
    held, holds = list(own), list(mains)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        if nodes[i][2] and (up := part[nodes[i][0]]) >= 0:
            held[up], holds[up] = held[up] + held[i], holds[up] or holds[i]
    top = [(not holds[i], -held[i], i) for i, n in enumerate(nodes) if n[2] and part[n[0]] < 0]
    heapq.heapify(top)
    # A faint hint on much of the text that no plain part holds is a wrapper's name.
    sure = [False] * len(nodes)
    for i, (parent, _, hint) in enumerate(nodes):
        sure[i] = hint == 2 or (parent >= 0 and sure[parent])
    loose = [0.0] * len(nodes)
    for n, m in zip(of, mass, strict=True):
        loose[n] += 0.0 if sure[n] else m
    for i in range(len(nodes) - 1, 0, -1):
        loose[nodes[i][0]] += loose[i]
    opened, total = {i for i, n in enumerate(nodes) if n[2] == 1 and loose[i] > 0 and loose[i] >= LARGE * loose[0]}, sum(mass)
    while top and not main and free <= REST * total:
        _, _, i = heapq.heappop(top)
        opened.add(i)
        free, main = free + own[i], mains[i]
        for j in parts[i]:
            heapq.heappush(top, (not holds[j], -held[j], j))
    out = [False] * len(nodes)
    for i, (parent, _, hint) in enumerate(nodes):
        out[i] = (hint and i not in opened) or (parent >= 0 and out[parent])
    return out


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by newlines."""
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.close()
    page.finish_block()
    nodes, blocks = page.nodes, page.blocks
    gone = left_out(nodes, [b[3] for b in blocks], [max(0, len(b[0]) - b[1]) for b in blocks], [b[4] == "h1" for b in blocks])
    blocks = [b for b in blocks if not gone[b[3]]]
    if not blocks:
        return ""
    sizes, linked, tags = (np.array(x, float) for x in zip(*((len(b[0]), b[1], max(1, b[2])) for b in blocks), strict=True))
    plain = 2 * linked <= sizes
    in_cluster = content(np.maximum(sizes - linked, 0) / tags) & plain
    clustered = np.flatnonzero(in_cluster).tolist()
    if not clustered:
        return "\n".join(b[0] for b in blocks)
    container, article = [-1] * len(nodes), [-1] * len(nodes)  # the innermost of each node; of articles the outermost
    for i, (parent, tag, _) in enumerate(nodes):
        container[i] = i if tag in CONTAINERS or parent < 0 else container[parent]
        article[i] = article[parent] if parent >= 0 and article[parent] >= 0 else i if tag in ("article", "main") else -1
    with_cluster = {container[blocks[i][3]] for i in clustered}
    articles = {article[blocks[i][3]] for i in clustered} - {-1}
    first, last = clustered[0], clustered[-1]
    heading = next((i for i, b in enumerate(blocks[:first]) if b[4] == "h1"), first)
    kept = [
        in_cluster[i] or article[b[3]] in articles or (plain[i] and (container[b[3]] in with_cluster or heading <= i < last)) for i, b in enumerate(blocks)
    ]
    for i in range(len(blocks) - 2, -1, -1):  # headings, from the last one up
        kept[i] = kept[i] or (kept[i + 1] and bool(blocks[i][4]))
    if not articles:  # closing sentences in containers beside that of the last cluster
        around = container[nodes[container[blocks[last][3]]][0]]
        for i in range(last + 1, len(blocks)):
            if not kept[i] and not (plain[i] and linked[i] == 0 and _SENTENCE.search(blocks[i][0]) and around in (at := container[blocks[i][3]], container[nodes[at][0]])):
                break
            kept[i] = True
    return "\n".join(b[0] for b, k in zip(blocks, kept, strict=True) if k)


def _of_pages(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(h) for h in pages], dtype=object)


def extract(html: Column) -> Column:
    return F.pandas_udf(_of_pages, StringType())(html.cast("string"))


def pages_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    out = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias(url_col), extract(F.col(f"`{html_col}`")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
