"""Links of a page from its tag stream: one pass with a stack of open elements,
which answers id containers and class selectors (an ancestor anywhere above) for
markup that is nested, unclosed or wrongly closed. A stack cannot be carried along
a text by built-in expressions in linear time, so this one step is a helper in
Arrow batches; choosing, ordering and capping links are DataFrame operations."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINKS_TYPE = "array<struct<href:string,title:string,selectors:array<int>>>"

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements without content, and elements whose content is no markup
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))


def _attributes(text: str) -> dict[str, str]:
    """Names in small letters; of an attribute given twice, the last one."""
    return {m[1].lower(): unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def links_of(page: str | None, container: str | None, selectors: list[tuple[str, str]]) -> list[tuple[str, str, list[int]]] | None:
    """(href, text, numbers of the selectors) of each link in the first element
    whose id is ``container`` (None: of the whole page), in the order of their
    start tags; None if there is no such element. A selector ``(name, class)``
    holds for a link below an element of that name and class.

    An end tag closes the nearest open element of its name and all inside it; one
    without an open element is ignored. Elements still open end with the page."""
    if page is None:
        return None
    stack: list[tuple[str, frozenset, list | None]] = []  # name, selectors that hold inside, link
    opened: dict[str, int] = {}
    inside, at = 0 if container is None else None, 0  # inside: open elements above the container's content
    found, texts = [], []  # texts: of the links that are open
    while at < len(page):
        m = _TAG.search(page, at)
        gap = page[at:m.start() if m else len(page)]
        for t in texts:
            t.append(gap)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                while True:
                    top, _, text = stack.pop()
                    opened[top] -= 1
                    if text is not None:
                        texts.remove(text)
                    if top == name:
                        break
                if inside is not None and container is not None and len(stack) < inside:
                    break  # the container's end
            continue
        attributes = _attributes(m[3])
        holds = stack[-1][1] if stack else frozenset()
        if inside is None and attributes.get("id") == container:
            inside = len(stack) + 1
            if name in _VOID:
                break
        elif inside is not None and name == "a" and "href" in attributes:
            text: list[str] = []
            found.append((attributes["href"], text, sorted(holds)))
            if not m[3].endswith("/"):
                texts.append(text)
                stack.append((name, holds, text))
                opened[name] = opened.get(name, 0) + 1
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID or m[3].endswith("/"):
            continue
        classes = attributes.get("class", "").split()
        mine = [i for i, (tag, kind) in enumerate(selectors) if tag == name and kind in classes]
        stack.append((name, holds.union(mine) if mine else holds, None))
        opened[name] = opened.get(name, 0) + 1
    if inside is None:
        return None
    return [(href, unescape("".join(text)).strip(), hits) for href, text, hits in found]


def page_links(html, container: str | None = None, selectors: list[tuple[str, str]] = ()) -> Column:
    """:func:`links_of` as a column."""
    chosen = list(selectors)

    @F.pandas_udf(LINKS_TYPE)
    def run(pages: pd.Series) -> pd.Series:
        def rows(page):
            got = links_of(page, container, chosen)
            return None if got is None else [{"href": h, "title": t, "selectors": s} for h, t, s in got]

        return pages.map(rows, na_action=None)

    return run(F.col(html) if isinstance(html, str) else html)
