"""Main text of web pages by composite text density.

Each node of a page's tree has C characters, T tags, LC characters and LT tags inside links. Its density is its
characters per tag, adjusted by its links: (C/T) * log_base((C/LC) * (T/LT)) with base ln(C/(C-LC)*LC + LCb/Cb*C + e),
where b is the body and a zero divisor counts as one. The subtree whose children's densities have the largest sum is
the article; the threshold is the smallest density on the path from the body to it, and other subtrees that reach the
threshold add their own best subtree. Parts that are no prose by their tag, role or class are taken out first, and
link lists by their share of link characters. A class counts only if one of its names says so as a whole ("sidebar-right",
not "share-price" or "has-sidebar"), and no class takes out what holds an article or, where there is none, most of the page; comments go always.

Defined cases: null and empty pages have an empty text; markup that is cut off or not closed is read as far as it goes;
a page without tags is its own text; of subtrees with equal sums the first in page order is the article; repeated rows are
extracted alike; a very long or deeply nested page is read in time that is linear in its length; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([a-zA-Z-]+)""")
#: Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt mstyle msub msubsup msup mtext munder munderover q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_PROSE = frozenset("head nav footer aside form button select dialog menu canvas audio video".split())
NO_PROSE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status".split())
NO_PROSE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs cookie cookies consent footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
#: Words that may stand beside one of those in a name: what a part is, or where.
PART_NAMES = frozenset("a area bar block body bottom box buttons center column container content entry first floating form group header inner item items js last layout left link links list main message middle mobile nested nofollow outer page panel post primary right row second secondary section site slot sticky text thread title top unit wrap wrapper".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_P = frozenset(["p"])
_HOLDS_P = frozenset("article aside body div blockquote section main td th li table button form".split())
#: A list or block in which links hold more of the characters than this is a menu.
LINK_SHARE = 0.7


class Page:
    """A page's nodes in page order: tag, parent, whether it is prose, and the texts with their nodes."""

    def __init__(self, html: str):
        self.tags, self.parents, self.prose, self.named, self.inside = ["#root"], [-1], [True], [False], [False]
        self.texts: list[tuple[int, str]] = []  # of a node, or a break between blocks: (-1, "")
        self.body = 0
        self.open_tags: Counter[str] = Counter()
        open_nodes, at, end = [0], 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            self._text(open_nodes[-1], html[at : m.start() if m else end])
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(open_nodes, tag)
                continue
            node = self._open(open_nodes, tag, m[3])
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = stop.end() if stop else end
                self.prose[node] = False
            elif tag not in VOID and not (m[3].endswith("/") and tag not in INLINE and tag not in _ENDS_P):
                open_nodes.append(node)
                self.open_tags[tag] += 1

    def _text(self, node: int, raw: str) -> None:
        if raw:
            self.texts.append((node, unescape(raw)))

    def _break(self, tag: str) -> None:
        if tag not in INLINE:
            self.texts.append((-1, ""))

    def _end(self, open_nodes: list[int], k: int) -> None:
        """The nodes from place k on are open no more."""
        self.open_tags.subtract(self.tags[n] for n in open_nodes[k:])
        del open_nodes[k:]

    def _pop(self, open_nodes: list[int], ends: frozenset | set, stops: frozenset | set) -> None:
        if not any(self.open_tags[t] for t in ends):
            return
        for k in range(len(open_nodes) - 1, 0, -1):
            tag = self.tags[open_nodes[k]]
            if tag in ends:
                self._end(open_nodes, k)
                self.texts.append((-1, ""))
                return
            if tag in stops:
                return

    def _close(self, open_nodes: list[int], tag: str) -> None:
        if self.open_tags[tag]:
            k = len(open_nodes) - 1
            while self.tags[open_nodes[k]] != tag:
                k -= 1
            self._end(open_nodes, k)
        self._break(tag)

    def _open(self, open_nodes: list[int], tag: str, attributes: str) -> int:
        if tag in _ENDS_P:
            self._pop(open_nodes, _P, _HOLDS_P)
        if tag in _CLOSES:
            self._pop(open_nodes, *_CLOSES[tag])
        self._break(tag)
        parent = open_nodes[-1]
        inside = self.inside[parent]
        self.tags.append(tag)
        self.parents.append(parent)
        self.inside.append(inside or tag in ("article", "main"))
        node = len(self.tags) - 1
        if tag == "body":
            self.body = node
        hidden, named = self._marked(tag, attributes, inside)
        self.prose.append(tag not in NO_PROSE and not (tag == "header" and not inside) and not hidden)
        self.named.append(named)
        return node

    @staticmethod
    def _marked(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
        """Whether a node is hidden, a part by its role or a comment; and whether its class or id names another part."""
        named = False
        if tag in ("html", "body", "h1") or "=" not in attributes and "hidden" not in attributes:
            return False, False
        for name, *values, alone in _ATTR.findall(attributes):
            name, value = (name or alone).lower(), unescape("".join(values)).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True, named
            if name == "role" and value in NO_PROSE_ROLES:
                return True, named
            if name in ("class", "id"):
                for one in value.split():
                    words = {w for w in re.split(r"[^a-z]+", one) if w}
                    if words & COMMENT_NAMES and words <= COMMENT_NAMES | PART_NAMES:
                        return True, named
                    known = NO_PROSE_NAMES - {"header"} if inside else NO_PROSE_NAMES
                    named |= bool(words & known) and words <= known | PART_NAMES
        return False, named

    def _kept(self) -> list[bool]:
        """Which nodes are prose, and all those above them. A name takes out no node that holds an article or, where the page has none, most of the body's characters."""
        n = len(self.tags)
        size, holds = [0] * n, [t in ("article", "main") for t in self.tags]
        for k, text in self.texts:
            if k >= 0:
                size[k] += len(text)
        for k in range(n - 1, 0, -1):
            if self.prose[k]:
                size[self.parents[k]] += size[k]
                holds[self.parents[k]] |= holds[k]
        kept, most = [True] * n, size[0] if holds[self.body] else size[self.body] / 2
        for k in range(1, n):
            part = self.named[k] and not holds[k] and size[k] <= most
            kept[k] = kept[self.parents[k]] and self.prose[k] and not part
        return kept

    def main_text(self) -> str:
        n = len(self.tags)
        kept = self._kept()
        link = [False] * n
        for k in range(1, n):
            link[k] = self.tags[k] == "a" or link[self.parents[k]]
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for k, text in self.texts:
            if k >= 0 and kept[k]:
                size = len("".join(text.split()))
                chars[k] += size
                link_chars[k] += size * link[k]
        for k in range(n - 1, 0, -1):
            if kept[k]:
                p = self.parents[k]
                chars[p] += chars[k]
                link_chars[p] += link_chars[k]
                tags[p] += tags[k] + 1
                link_tags[p] += link_tags[k] + (self.tags[k] == "a")
        b = self.body
        share = link_chars[b] / (chars[b] or 1)

        def density(k: int) -> float:
            c, lc, t, lt = chars[k], link_chars[k], tags[k] or 1, link_tags[k] or 1
            if not c:
                return 0.0
            base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
            return c / t * math.log(c / (lc or 1) * t / lt) / math.log(base) if base > 1 and math.log(base) > 1e-9 else c / t * math.log(c / (lc or 1) * t / lt + 1)

        dense = [density(k) if kept[k] else 0.0 for k in range(n)]
        sums = list(dense) if n == 1 else [0.0] * n
        leaf = [True] * n
        for k in range(1, n):
            if kept[k] and self.tags[k] not in INLINE and self.tags[k] not in VOID:
                sums[self.parents[k]] += dense[k]
                leaf[self.parents[k]] = False
        for k in range(n):
            if leaf[k]:
                sums[k] = dense[k]
        within = [k == b for k in range(n)]
        for k in range(b + 1, n):
            within[k] = kept[k] and within[self.parents[k]] and self.tags[k] not in INLINE and self.tags[k] not in VOID
        best = max((k for k in range(n) if within[k]), key=lambda k: (sums[k], -k), default=b)
        limit, k = dense[best], best
        while k != b and k > 0:
            k = self.parents[k]
            limit = min(limit, dense[k])
        marked = [False] * n
        # The best node below each node, children before parents.
        top = list(range(n))
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            if within[k] and sums[top[k]] > sums[top[p]]:
                top[p] = top[k]
        for k in range(n):
            if within[k] and dense[k] >= limit and (k == b or not marked[self.parents[k]]):
                marked[top[k]] = marked[top[k]] or link_chars[top[k]] <= LINK_SHARE * chars[top[k]]
        marked[best] = True
        for k in range(1, n):
            marked[k] = kept[k] and (marked[k] or marked[self.parents[k]])
        blocks, block = [], []
        for k, text in [*self.texts, (-1, "")]:
            if k < 0:
                if line := " ".join("".join(block).split()):
                    blocks.append(line)
                block = []
            elif marked[k]:
                block.append(text)
        return " ".join(blocks)


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [main_text(h) for h in b["html"]]
        yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    cols = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*cols).mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
