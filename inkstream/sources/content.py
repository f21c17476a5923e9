"""Bodies by platform: what an API or a book gives, or what a page holds, as clean markup.

``wordpress`` and ``ghost``: the API's body, made clean; where it has no text, an article of wordpress is taken from
its page.  ``essay``: a hand-written site whose text stands in ``font`` blocks.  ``epub``: the body as it is.  All
others: the page's main element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html as pages
from ..functions import html_tree as H

# How a hand-written site dates, advertises and tints.
DATELINE = re.compile(r"^(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{4})\b", re.I)
PROMO = re.compile(r"want to start a startup\?|get funded by\s*y\s*combinator", re.I)
PROMO_MOST = 160
TINTS = ("ffffdd", "fff8dc", "ffffe0")
TABLE = ("table", "tbody", "thead", "tr", "td", "th")


def has_text(markup: str) -> bool:
    """Twenty words, or a picture (``functions.text.assess`` for one string)."""
    return len(re.sub(r"<[^>]*>", " ", markup).split()) >= 20 or bool(re.search(r"<img\b", markup, re.I))


def _plain(node: H.Node, base: str) -> str:
    for img in list(node.find("img")):
        if pages.decorative(img):
            img.remove()
    return pages.sanitise(node, base)


def from_page(page: str, base: str) -> str:
    return _plain(pages.extract_main(H.parse(page)), base)


def from_body(body: str, base: str) -> str:
    holder = H.Node("div")
    for child in H.parse(body).children:
        _into(holder, child)
    return _plain(holder, base)


def _into(parent: H.Node, child: H.Node | str) -> None:
    if isinstance(child, H.Node):
        child.parent = parent
    parent.children.append(child)


def _drop_promo(root: H.Node) -> None:
    """A short notice, with the table parts around it that hold nothing else."""
    for node in list(root.find("b", "font", "td", "p", "div")):
        said = node.text()
        if not said or len(said) > PROMO_MOST or not PROMO.search(said):
            continue
        out = node
        while out.parent and out.parent.tag in TABLE and len(out.parent.text()) <= PROMO_MOST:
            out = out.parent
        out.remove()


def _drop_dateline(node: H.Node) -> bool:
    """Whether the first text was met; it goes if it is a date."""
    for k, child in enumerate(node.children):
        if isinstance(child, H.Node):
            if _drop_dateline(child):
                return True
        elif child.strip():
            if DATELINE.match(child.strip()):
                del node.children[k]
            return True
    return False


def _quote_tinted(root: H.Node) -> None:
    """Outermost tables with a tinted part are quotes."""
    tinted = [n for n in root.find("td", "tr", "table") if n.attrs.get("bgcolor", "").lower().lstrip("#") in TINTS]
    for node in tinted:
        outer, up = (node if node.tag == "table" else None), node.parent
        while up:
            outer, up = (up if up.tag == "table" else outer), up.parent
        if outer:
            for inner in list(outer.find(*TABLE)):
                inner.unwrap()
            outer.tag, outer.attrs = "blockquote", {}


def essay(page: str, base: str) -> str:
    root = H.parse(page)
    for node in list(root.find("map", "script", "style", "noscript")):
        node.remove()
    is_block = lambda n: n.tag == "font" and n.attrs.get("face", "").lower().startswith("verdana")
    blocks = [n for n in root.walk() if is_block(n)]
    if not blocks:
        return _plain(pages.extract_main(root), base)
    holder = H.Node("div")
    for block in blocks:
        up = block.parent
        while up and not is_block(up):
            up = up.parent
        if not up:  # an outermost block brings the ones within
            for child in list(block.children):
                _into(holder, child)
    _drop_promo(holder)
    _drop_dateline(holder)
    _quote_tinted(holder)
    for node in list(holder.find(*TABLE)):
        if node.tag != "table" or not any(node.find("th")):
            node.unwrap()
    for node in list(holder.find("div", "font", "center", "span")):
        node.unwrap()
    return pages.paragraphise(_plain(holder, base))


def essay_title(page: str, slug: str) -> str:
    """The document's title; where that says nothing, the first line of the text."""
    root = H.parse(page)
    title = next((re.sub(r"\s+", " ", n.text()).strip() for n in root.find("title")), slug)
    if title.lower() in ("essays", "", "untitled"):
        for node in list(root.find("title")):
            node.remove()
        title = next((x.strip() for x in root.strings() if x.strip()), title)
    return title.replace("-->", "").strip() or slug


def body_of(platform: str | None, body: str | None, page: str | None, url: str | None) -> tuple[str, str]:
    """Clean markup, and where it is from (api, direct, file)."""
    base = url or ""
    if platform == "epub":
        return body or "", "file"
    if platform == "essay":
        return essay(page or body or "", base), "direct"
    if platform in ("wordpress", "ghost") and body:
        own = from_body(body, base)
        if platform == "wordpress" and not has_text(own) and page and has_text(other := from_page(page, base)):
            return other, "direct"
        return own, "api"
    return from_page(page or body or "", base), "direct"


def content(platform: Column, body: Column, page: Column, url: Column) -> Column:
    """struct(html, status, source); status is ok or empty."""

    @F.pandas_udf("html string, status string, source string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [body_of(*row) for row in zip(*(x.astype(object).where(x.notna(), None) for x in part), strict=True)]
            yield pd.DataFrame([(h, "ok" if has_text(h) else "empty", s) for h, s in rows], columns=["html", "status", "source"])

    return run(platform, body, page, url)
