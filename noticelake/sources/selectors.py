"""Fields of stored pages by CSS selectors: templates with a list selector, matched over the stream of tags.

A selector is compiled once into steps; a page is read once into its elements in document
order, each with its parent, and the same elements serve the list selector and all fields.
Selectors: names, ``*``, ``#id``, ``.class``, ``[attr]``, ``[attr=value]`` with ``^=``, ``$=``
and ``*=``, descendants, children (``>``), and several of them with commas.

Defined results: a null or empty page has no items; without a list selector a page is one
item; a field whose selector finds nothing is null; an address field is the href, absolute
where it begins with a slash, null where there is none; text has its white space made one
blank and none at its ends; what scripts, styles and comments hold is no text; elements
that a page leaves open end with their parent.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, elements whose content is no markup, and what ends an open element of the first name (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
ENDED_BY = {"li": {"li"}, "p": {"p", "ul", "ol", "div", "table", "h1", "h2", "h3"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Names of fields whose value is an address (fixed values).
ADDRESSES = ("detail_url", "url", "link", "href", "source_url")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SIMPLE = re.compile(r"(\*|[a-zA-Z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]")


@dataclass(frozen=True)
class Template:
    """Selectors of a platform's pages by field, of the items of a list, and of the link to the next page."""

    name: str
    selectors: dict[str, str] = field(default_factory=dict)
    list_selector: str | None = None
    next_page_selector: str | None = None
    max_pages: int = 1


_templates: dict[str, Template] = {}


def register(template: Template) -> Template:
    """Keep a template under its name; a later one of the same name replaces it."""
    _templates[template.name.lower()] = template
    return template


def template(name: str) -> Template | None:
    return _templates.get(name.lower())


def template_names() -> list[str]:
    return sorted(_templates)


_NOTICE_FIELDS = {"title": "a", "publish_time": ".time, .date, span.time", "location": ".location, .area", "notice_type": ".type, .category", "detail_url": "a", "content": ".content, .summary, p"}
NAVIGATION = register(Template("navigation", {"title": "a", "url": "a"}, "nav ul > li"))
NOTICE_LIST = register(Template("notice_list", _NOTICE_FIELDS, "ul.list > li, ul.bid-list li", "a.next", 5))
ARTICLE = register(Template("article", {"title": "article > h1", "first": "article p", "link": "nav a[href^='/']"}))


@dataclass
class Element:
    name: str
    attrs: dict[str, str]
    parent: int
    #: Elements inside have numbers below this one.
    upto: int = 0
    #: Where its text begins and ends in the pieces of text of the page.
    begin: int = 0
    end: int = 0


def elements(page: str) -> tuple[list[Element], list[str]]:
    """The elements of a page in document order, and its pieces of text."""
    found, pieces, open_, at = [], [], [], 0

    def close(upto: int) -> None:
        while len(open_) > upto:
            e = found[open_.pop()]
            e.upto, e.end = len(found), len(pieces)

    while m := _TAG.search(page, at):
        if m.start() > at:
            pieces.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(open_) - 1, -1, -1):
                if found[open_[i]].name == name:
                    close(i)
                    break
            continue
        while open_ and name in ENDED_BY.get(found[open_[-1]].name, ()):
            close(len(open_) - 1)
        attrs: dict[str, str] = {}
        for k, a, b, c in _ATTR.findall(m[3].rstrip("/") if name in VOID else m[3]):
            attrs.setdefault(k.lower(), html.unescape(a or b or c))
        found.append(Element(name, attrs, open_[-1] if open_ else -1, len(found) + 1, len(pieces), len(pieces)))
        if name in VOID:
            if name == "br":
                pieces.append(" ")
            continue
        open_.append(len(found) - 1)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if name in ("title", "textarea"):
                pieces.append(html.unescape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
            close(len(open_) - 1)
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    close(0)
    return found, pieces


#: A step: whether it has to be the parent of what follows it, and the tests of its element.
Step = tuple[bool, tuple[tuple[str, str, str], ...]]


def compiled(selector: str) -> list[list[Step]]:
    """The alternatives of a selector, each as its steps from the last to the first."""
    out = []
    for alternative in selector.split(","):
        steps: list[Step] = []
        child = False
        for word in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", alternative):
            if word == ">":
                child = True
                continue
            tests, at = [], 0
            while at < len(word):
                m = _SIMPLE.match(word, at)
                if not m:
                    raise ValueError(f"selector not understood: {selector!r}")
                name, id_, class_, attr, how, *values = m.groups()
                value = next((v for v in values if v is not None), "")
                tests.append(("name", "", name.lower()) if name else ("id", "", id_) if id_ else ("class", "", class_) if class_ else (how or "has", attr.lower(), value))
                at = m.end()
            steps.append((child, tuple(tests)))
            child = False
        if not steps:
            raise ValueError(f"selector not understood: {selector!r}")
        out.append(steps[::-1])
    return out


def _fits(e: Element, tests: tuple[tuple[str, str, str], ...]) -> bool:
    for how, attr, value in tests:
        if how == "name":
            ok = value in ("*", e.name)
        elif how == "id":
            ok = e.attrs.get("id") == value
        elif how == "class":
            ok = value in e.attrs.get("class", "").split()
        else:
            own = e.attrs.get(attr)
            ok = own is not None and {
                "has": True, "=": own == value, "~=": value in own.split(), "^=": bool(value) and own.startswith(value), "$=": bool(value) and own.endswith(value),
                "*=": bool(value) and value in own, "|=": own == value or own.startswith(value + "-"),
            }[how]
        if not ok:
            return False
    return True


def _matches(found: list[Element], at: int, steps: list[Step]) -> bool:
    """Whether an element is what the steps end in; ancestors outside an item count too, as in browsers."""
    if not _fits(found[at], steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    up = found[at].parent
    while up >= 0:
        if _matches(found, up, steps[1:]):
            return True
        if steps[0][0]:
            return False
        up = found[up].parent
    return False


def select(found: list[Element], selector: list[list[Step]], within: int = -1) -> Iterator[int]:
    """Numbers of the elements inside ``within`` (all for -1) that a compiled selector matches, in document order."""
    for at in range(within + 1, found[within].upto if within >= 0 else len(found)):
        if any(_matches(found, at, steps) for steps in selector):
            yield at


def address(base: str, href: str | None) -> str | None:
    if not href:
        return None
    if href.startswith("/") and not href.startswith("http"):
        parts = urlsplit(base)
        return f"{parts.scheme}://{parts.netloc}{href}"
    return href


def is_address(name: str) -> bool:
    return name.lower() in ADDRESSES or name.lower().endswith("_url")


def items_of(url: str, page: str, template: Template, fields: dict[str, list[list[Step]]], listed: list[list[Step]] | None) -> list[dict[str, str | None]]:
    found, pieces = elements(page)
    out = []
    for item in select(found, listed) if listed else (-1,):
        row: dict[str, str | None] = {}
        for name, selector in fields.items():
            at = next(select(found, selector, item), None)
            if at is None:
                row[name] = None
            elif listed and is_address(name):
                row[name] = address(url, found[at].attrs.get("href"))
            else:
                row[name] = " ".join("".join(pieces[found[at].begin : found[at].end]).split())
        out.append(row)
    return out


def scrape(pages: DataFrame, template: Template, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, item, the template's fields as text): the items of every page, numbered from 0."""
    fields = {name: compiled(s) for name, s in template.selectors.items()}
    listed = compiled(template.list_selector) if template.list_selector else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, n, *item.values())
                for i, u, p in batch.itertuples(index=False)
                for n, item in enumerate(items_of(u or "", p, template, fields, listed))
            ]
            yield pd.DataFrame(rows, columns=[key, "item", *fields])

    kinds = ", ".join((f"{key} {pages.schema[key].dataType.simpleString()}", "item int", *(f"{n} string" for n in fields)))
    return pages.filter(F.coalesce(page, F.lit("")) != "").select(key, url, page).mapInPandas(read, kinds)
