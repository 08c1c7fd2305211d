"""Operator 8: the main text of web pages from flat blocks and a decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its number
of words and its link density, those of its two neighbours, and counts of what its open
containers say: elements of page furniture, class words that name furniture, class words
that only mention it, and marks of an article. A decision tree, trained on the blocks of
the small labelled pages below, tells main text from the rest. What a container's class
words name is one feature of it; what they only mention ("has-sidebar") is another.

Defined results: null or empty html gives an empty text; unclosed tags end where
their container does; a skipped element that neither ends nor has a container that
does loses its tag only, not the rest of the page; of a head only the elements that
are skipped anyway are, so that it needs no end; scripts and the like are read raw,
inside skipped elements too; a "<" that begins no tag is text; attributes are read by the
rules of HTML, but for a quotation mark without an end, which is a part of its value; a
tag that the page's end cuts off is dropped; character references are decoded once; white
space inside a block becomes one blank; blocks without words vanish; repeated rows give
repeated results; other columns are not read. The time a page takes grows with its length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import bounded_batches, whole_text

#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of a page.
SKIPPED = frozenset("script style noscript template iframe object select textarea button svg annotation annotation-xml title".split())
#: Elements whose content holds no tags.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Skipped elements that a block ends unless it stands in one of their inner HTML parts, and those that do not nest.
FOREIGN, HTML_PARTS = frozenset(("svg", "annotation", "annotation-xml")), frozenset(("foreignobject", "desc"))
FLAT = frozenset(("button", "select"))
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name page furniture (fixed values).
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner billboard breadcrumb breadcrumbs byline-share comment comments"
    " consent contentinfo cookie cookies disqus dialog footer gdpr header masthead menu modal nav navbar navigation"
    " newsletter notice notices pager pagination popup promo promotion promoted related remark reply replies respond"
    " search share sharing sidebar signup skyscraper social sponsor sponsored subscribe tags toolbar widget widgets"
    " complementary alert".split()
)
COMMENT_WORDS = frozenset("comment comments disqus remark reply replies respond".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story maincontent".split())
#: Words that make a class word a remark on a container, not its name: "has-sidebar", "comments-open".
STATE_WORDS = frozenset("closed disabled enabled fixed has hide is no off on open show sticky with without".split())
MARKING = frozenset(("class", "id", "role", "itemprop"))

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_PLAIN_END = re.compile(r"[^>\"'=]*>")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PART = re.compile(r"[A-Za-z]+")


class Scanner:
    """Reads the tags of a page from left to right; what is known not to come again is not looked for again."""

    def __init__(self, html: str):
        self.html = html
        self._last: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """Place of ``what`` at or after ``at``, or -1; a failure is remembered."""
        if self._last.get(what, at) < at:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self._last[what] = at - 1
        return found

    def end_of(self, name: str, at: int) -> int:
        """Place of the end tag of a raw element, or -1."""
        key = f"</{name}"
        if self._last.get(key, at) < at:
            return -1
        found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.html, at)
        if found is None:
            self._last[key] = at - 1
            return -1
        return found.start()

    def tag_end(self, at: int, attributes: list[tuple[str, str]] | None) -> int:
        """The place after the ">" of the tag whose name ends at ``at``, or -1; fills ``attributes``."""
        html, n = self.html, len(self.html)
        plain = _PLAIN_END.match(html, at)
        if plain and (attributes is None or plain.end() == at + 1):
            return plain.end()
        while True:
            at = _GAP.match(html, at).end()
            if at >= n:
                return -1
            if html[at] == ">":
                return at + 1
            named = _ATTRIBUTE.match(html, at)
            at, value = named.end(), ""
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                end = self.find(quote, at + 1) if quote in ("\"", "'") else -1
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            if attributes is not None:
                attributes.append((named[0].lower(), value))


@dataclass(frozen=True)
class Inside:
    """What the open containers of a block say, as counts: elements of furniture, class words that name or mention it, and marks of an article."""

    name: str = ""
    elements: int = 0
    forms: int = 0
    named: int = 0
    mentioned: int = 0
    main: int = 0


OUTSIDE = Inside()


@dataclass
class Block:
    words: int = 0
    linked: int = 0
    inside: Inside = field(default_factory=lambda: OUTSIDE)
    heading: bool = False
    text: str = ""

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _State:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    open: list[Inside] = field(default_factory=list)
    names: Counter = field(default_factory=Counter)  # of the open containers
    in_link: bool = False
    heading: bool = False

    def end_block(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                linked = len(" ".join(self.link_parts).split())
                inside = self.open[-1] if self.open else OUTSIDE
                self.blocks.append(Block(len(words), min(linked, len(words)), inside, self.heading, " ".join(words)))
            self.parts, self.link_parts = [], []

    def text(self, part: str) -> None:
        part = unescape(part)  # a reference ends where its piece of text does
        self.parts.append(part)
        if self.in_link:
            self.link_parts.append(part)


def _marks(attributes: list[tuple[str, str]]) -> tuple[int, int, int, int]:
    """Of the class words of a container: how many name furniture, comments, mention furniture, and name an article."""
    named = comments = mentioned = main = 0
    for key, value in attributes:
        if key not in MARKING:
            continue
        for word in value.split():
            parts = {w.lower() for w in _PART.findall(word)}
            if not parts & FURNITURE_WORDS:
                main += bool(parts & MAIN_WORDS)
            elif parts & STATE_WORDS or parts & MAIN_WORDS and not parts & COMMENT_WORDS:
                mentioned += 1
            else:
                named += 1
                comments += bool(parts & COMMENT_WORDS)
    return named, comments, mentioned, main


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    style = lambda v: "".join(v.lower().split())
    return any(k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and "display:none" in style(v) for k, v in attributes)


def _within(name: str, attributes: list[tuple[str, str]], outer: Inside) -> Inside:
    """What holds for the blocks of a container that opens inside of others."""
    named, comments, mentioned, main = _marks(attributes) if attributes else (0, 0, 0, 0)
    if name == "body":
        named = mentioned = 0
    elif name in MAIN:
        named, mentioned = comments, mentioned + named - comments
    elif named and main:
        named, mentioned, main = 0, mentioned + named, main
    elements = (name in FURNITURE and name != "form") + (name == "header" and not outer.main) + bool(attributes and _hidden(attributes))
    main += name in MAIN
    if main and not named:
        return Inside(name, outer.elements + elements, 0, outer.named, outer.mentioned + mentioned, outer.main + main)
    return Inside(name, outer.elements + elements, outer.forms + (name == "form"), outer.named + named, outer.mentioned + mentioned, outer.main)


def flat_blocks(html: str) -> list[Block]:
    """The text blocks of a page in order."""
    state, at, skipping = _State(), 0, ""
    scan, attributes = Scanner(html), []
    depth, start, never = 0, 0, set()
    opened: Counter = Counter()  # blocks open outside of what is skipped
    within: Counter = Counter()  # blocks open in what is skipped
    text_from = 0
    while True:
        less = scan.find("<", at)
        if less < 0 or less + 1 >= len(html):
            if not skipping:
                break
            never.add(skipping)
            at, skipping, text_from, scan = start, "", start, Scanner(html)
            continue
        sign = html[less + 1]
        if sign in "!?":
            comment = html.startswith("<!--", less)
            end = scan.find("-->" if comment else ">", less + (4 if comment else 2))
            end = len(html) if end < 0 else end + (3 if comment else 1)
            name, closing, single = "", False, False
        else:
            closing = sign == "/"
            named = _NAME.match(html, less + 1 + closing)
            if named is None:  # no tag
                at = less + 1
                continue
            name = named[0].lower()
            attributes = [] if name in CONTAINERS and not closing else None
            end = scan.tag_end(named.end(), attributes)
            end, single = (len(html), False) if end < 0 else (end, html[end - 2] == "/")
        if not skipping and less > text_from:
            state.text(html[text_from:less])
        at = text_from = end
        if not name:
            continue
        if name in RAW and not closing:
            if name in BLOCKS and not skipping:
                state.end_block()
            raw_end = scan.end_of(name, at)
            if skipping not in FOREIGN or raw_end >= 0 and not single:
                at = text_from = len(html) if raw_end < 0 else scan.find(">", raw_end) + 1 or len(html)
            continue
        if skipping:
            if name == skipping:
                depth += -1 if closing else name not in FLAT and not single
                if depth == 0:
                    skipping = ""
                continue
            if closing and (within[name] or name not in BLOCKS or not opened[name]):
                within[name] -= within[name] > 0
                continue
            if not closing and (skipping not in FOREIGN or name not in BLOCKS or any(within[x] for x in HTML_PARTS)):
                within[name] += (name in BLOCKS or name in HTML_PARTS) and name not in VOID and not (single and name in HTML_PARTS)
                continue
            skipping = ""
        if name in SKIPPED and not closing:
            if not single and name not in never:
                skipping, depth, start = name, 1, at
                within.clear()
            continue
        if name == "a":
            state.in_link = not closing
        elif name == "br":
            state.text("\n")
        elif name in BLOCKS:
            state.end_block()
            opened[name] += -(opened[name] > 0) if closing else name not in VOID
            state.heading = name in HEADINGS and not closing
            if name in CONTAINERS:
                state.in_link = False
                if closing:
                    while state.names[name]:
                        ended = state.open.pop().name
                        state.names[ended] -= 1
                        if ended == name:
                            break
                elif name not in VOID:
                    state.open.append(_within(name, attributes, state.open[-1] if state.open else OUTSIDE))
                    state.names[name] += 1
    if text_from < len(html):
        state.text(html[text_from:])
    state.end_block()
    return state.blocks


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "elements", "named", "mentioned", "main", "heading",
)
#: Labelled pages (fixed values): the containers, words and linked words of each block, then 1 for main text.
LABELLED = (
    # an article element with furniture around and in it
    (("nav>ul>li", 1, 1, 0), ("nav>ul>li", 2, 2, 0), ("nav>ul>li", 1, 1, 0), ("div.ad", 7, 0, 0), ("article>h1", 12, 0, 1), ("article>p", 55, 0, 1),
     ("article>p", 4, 0, 1), ("article>p", 90, 2, 1), ("article>p", 1, 0, 1), ("article>div.ad", 40, 0, 0), ("article>p", 30, 0, 1), ("footer", 9, 0, 0)),
    (("header>div", 3, 3, 0), ("div.cookie-notice", 25, 1, 0), ("article>header>h1", 7, 0, 1), ("article>header>p", 6, 2, 1), ("article>ul>li", 3, 3, 1), ("article>ul>li", 2, 2, 1),
     ("article>ul>li", 3, 3, 1), ("article>p", 14, 6, 1), ("article>h2", 2, 0, 1), ("article>aside>p", 30, 0, 0), ("article>p", 8, 0, 1), ("article>form>p", 6, 0, 0),
     ("div.related-posts>p", 5, 5, 0), ("div#comments>h2", 3, 0, 0), ("div#comments>p", 33, 0, 0), ("div#comments>p", 60, 0, 0), ("footer>p", 20, 4, 0)),
    (("header>p", 30, 0, 0), ("nav", 6, 6, 0), ("main>h1", 5, 5, 1), ("main>p", 2, 0, 1), ("main>p", 3, 0, 1), ("main>p", 2, 0, 1), ("main>table>tr>td", 1, 0, 1),
     ("main>table>tr>td", 2, 1, 1), ("main>div.share", 4, 4, 0), ("main>section.comments>article.comment>p", 45, 0, 0), ("aside>p", 12, 0, 0), ("footer>div", 40, 3, 0)),
    (("article>p", 20, 0, 1), ("aside>h3", 2, 0, 0), ("aside>p", 25, 0, 0), ("article>p", 21, 0, 1), ("dialog>p", 22, 0, 0), ("article>p", 5, 2, 1), ("menu>li", 2, 2, 0)),
    (("article>h1", 6, 6, 1), ("article>p", 35, 0, 1), ("article>p", 5, 5, 1), ("article>p", 42, 0, 1), ("article>h2", 4, 4, 1), ("article>p", 33, 0, 1), ("article>div.share", 3, 3, 0), ("article>p", 31, 0, 1)),
    (("article>p", 1, 0, 1), ("article>p", 3, 0, 1), ("article>p", 27, 0, 1), ("article>p", 1, 0, 1)),
    (("article>p", 2, 1, 1), ("article>p", 36, 0, 1), ("article>p", 2, 0, 1)),
    (("nav", 3, 3, 0), ("article>p", 1, 0, 1), ("article>p", 2, 0, 1), ("nav", 1, 1, 0)),
    (("nav", 1, 1, 0), ("article>p", 9, 0, 1), ("article>p", 4, 4, 1), ("article>p", 14, 0, 1), ("article>p", 3, 3, 1), ("article>p", 11, 0, 1), ("nav", 1, 1, 0)),
    # containers whose class names an article, some of which mention furniture too
    (("div.site-header", 4, 2, 0), ("div#menu>ul>li", 1, 1, 0), ("div#menu>ul>li", 1, 1, 0), ("div.content.has-sidebar>h1", 6, 0, 1), ("div.content.has-sidebar>p", 48, 0, 1),
     ("div.content.has-sidebar>p", 70, 3, 1), ("div.content.has-sidebar>p", 9, 0, 1), ("div.sidebar>p", 35, 0, 0), ("div.sidebar>ul>li", 3, 3, 0), ("div.site-footer>p", 15, 2, 0)),
    (("div.entry-header>h1", 8, 0, 1), ("div.post-content.comments-open>p", 40, 1, 1), ("div.post-content.comments-open>p", 5, 0, 1), ("div.post-content.comments-open>p", 64, 0, 1),
     ("div.post-comments>p", 44, 0, 0), ("div.post-comments>p", 12, 0, 0), ("div.newsletter>p", 18, 0, 0)),
    (("div.main-menu>ul>li", 1, 1, 0), ("div.main-menu>ul>li", 2, 2, 0), ("div.main-menu>ul>li", 1, 1, 0), ("div#main.header-fixed>h1", 5, 0, 1), ("div#main.header-fixed>p", 33, 0, 1),
     ("div#main.header-fixed>p", 27, 0, 1), ("div.article-footer>p", 4, 3, 0), ("div.advert", 30, 0, 0), ("div.promo", 9, 0, 0), ("div.footer", 11, 1, 0)),
    (("div.story>p", 4, 1, 1), ("div.story>p", 28, 0, 1), ("div.story>div.sponsored>p", 31, 0, 0), ("div.story>p", 40, 0, 1), ("div.story>div.newsletter>p", 8, 0, 0), ("div.story>p", 3, 0, 1)),
    (("div.no-sidebar>p", 38, 0, 1), ("div.no-sidebar>p", 45, 6, 1), ("div.no-sidebar>p", 12, 0, 1), ("div.content-sidebar>ul>li", 3, 3, 0), ("div.content-sidebar>ul>li", 4, 4, 0), ("div.content-sidebar>p", 3, 3, 0)),
    # pages without any mark: only words, links and neighbours
    (("ul>li", 1, 1, 0), ("ul>li", 2, 2, 0), ("ul>li", 1, 1, 0), ("ul>li", 3, 3, 0), ("h1", 7, 0, 1), ("p", 62, 0, 1), ("p", 25, 4, 1), ("p", 6, 0, 1), ("p", 40, 4, 1),
     ("h2", 5, 0, 1), ("p", 58, 0, 1), ("p", 14, 0, 1), ("div", 24, 19, 0), ("div", 5, 5, 0), ("div", 2, 0, 0), ("div", 2, 2, 0)),
    (("div", 2, 2, 0), ("p", 24, 3, 1), ("p", 2, 0, 1), ("p", 23, 4, 1), ("p", 1, 0, 1), ("p", 21, 0, 1), ("div", 5, 5, 0)),
    (("div", 3, 3, 0), ("div", 2, 0, 0), ("div", 2, 2, 0), ("h3", 2, 0, 0), ("div", 1, 1, 0), ("div", 3, 2, 0), ("div", 5, 2, 0), ("div", 4, 3, 0), ("p", 18, 0, 1), ("p", 30, 0, 1), ("div", 1, 1, 0)),
    (("h1", 6, 0, 1), ("p", 44, 0, 1), ("p", 2, 0, 1), ("p", 51, 1, 1), ("p", 1, 0, 1), ("p", 37, 0, 1), ("p", 3, 0, 1), ("p", 48, 0, 1), ("p", 8, 4, 1), ("p", 66, 0, 1), ("p", 12, 6, 1), ("p", 41, 0, 1), ("p", 3, 3, 1), ("p", 35, 0, 1)),
    (("div", 2, 2, 0), ("div", 3, 3, 0), ("div", 9, 0, 0), ("div", 2, 2, 0), ("div", 4, 4, 0), ("div", 13, 0, 0), ("div", 3, 3, 0), ("div", 2, 2, 0), ("div", 16, 1, 0), ("div", 1, 1, 0), ("div", 1, 1, 0), ("p", 47, 0, 1), ("p", 56, 0, 1)),
    (("div", 4, 4, 0), ("div", 12, 4, 0), ("div", 3, 3, 0), ("div", 15, 5, 0), ("div", 4, 4, 0), ("div", 11, 3, 0), ("div", 5, 5, 0), ("h1", 5, 0, 1), ("p", 31, 0, 1), ("p", 2, 0, 1), ("p", 29, 0, 1), ("div", 2, 0, 0), ("div", 1, 1, 0)),
    (("div", 1, 0, 0), ("h1", 6, 0, 1), ("p", 34, 0, 1), ("p", 28, 0, 1), ("div", 2, 0, 0)),
    (("div", 2, 0, 0), ("p", 40, 0, 1), ("p", 22, 0, 1), ("div", 1, 0, 0)),
    (("p", 20, 0, 1),),
    (("div", 11, 0, 1),),
    (("div", 1, 1, 0), ("p", 26, 4, 1), ("p", 12, 0, 1), ("div", 3, 3, 0), ("p", 33, 5, 1), ("div", 2, 2, 0), ("div", 2, 1, 0)),
    # forms: one around a whole page, one that is furniture
    (("form>div#content>h1", 4, 0, 1), ("form>div#content>p", 50, 0, 1), ("form>div#content>p", 7, 0, 1), ("form>p", 3, 0, 0), ("form>p", 20, 0, 0), ("form>label", 2, 0, 0)),
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages, which are written as HTML and read like any page."""
    x, y = [], []
    for page in LABELLED:
        html = []
        for path, words, linked, main in page:
            opened, closed = "", ""
            for step in path.split(">"):
                name, *marks = re.split(r"(?=[.#])", step)
                listed = " ".join(m[1:] for m in marks if m[0] == ".")
                ids = "".join(f' id="{m[1:]}"' for m in marks if m[0] == "#")
                opened += f"<{name}{ids}" + (f' class="{listed}">' if listed else ">")
                closed = f"</{name}>{closed}"
            html.append(f"{opened}<a>{'w ' * linked}</a>{'w ' * (words - linked)}{closed}")
            y.append(main)
        x += block_rows(flat_blocks("".join(html)))
    return np.array(x, dtype=float), np.array(y, dtype=float)


DEPTH = 8


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, below, above) or the share of main text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow_tree(x[low], y[low], depth - 1), grow_tree(x[~low], y[~low], depth - 1)


def block_rows(blocks: list[Block]) -> list[tuple[float, ...]]:
    """The features of each block of a page."""
    none, out = Block(), []
    for i, b in enumerate(blocks):
        before, after = blocks[i - 1] if i else none, blocks[i + 1] if i + 1 < len(blocks) else none
        near = (b.words, b.density, before.words, before.density, after.words, after.density)
        out.append((*near, b.inside.elements + b.inside.forms, b.inside.named, b.inside.mentioned, b.inside.main, b.heading))
    return out


@lru_cache(maxsize=1)
def block_tree() -> tuple | float:
    return grow_tree(*labelled_blocks())


def is_main(tree: tuple | float, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree >= 0.5


def main_text(html: str, tree: tuple | float | None = None) -> str:
    """The blocks of main text, joined by an empty line."""
    tree = block_tree() if tree is None else tree
    blocks = flat_blocks(html)
    return "\n\n".join(b.text for b, row in zip(blocks, block_rows(blocks), strict=True) if is_main(tree, row))


@F.pandas_udf(T.StringType())
def _extracted(pages: pd.Series) -> pd.Series:
    tree = block_tree()
    return pd.Series([main_text(p, tree) for p in pages], dtype=object)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    bounded_batches(pages.sparkSession)
    done = pages.select("page_id", "url", _extracted(whole_text(html_col)).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
