"""A small lenient HTML tree, and the selectors that extraction needs: tag, .class, #id, [attr], descendant, comma."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        """Elements below, in order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                stack += reversed(x.children)

    def text(self, separator: str = " ") -> str:
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def inside(self, *tags: str) -> bool:
        node = self.parent
        while node:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def classes(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".strip()

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def unwrap(self) -> None:
        if self.parent:
            at = next(i for i, c in enumerate(self.parent.children) if c is self)
            for c in self.children:
                if isinstance(c, Node):
                    c.parent = self.parent
            self.parent.children[at : at + 1] = self.children
            self.parent = None

    def inner(self) -> str:
        return _markup(self.children)

    def outer(self) -> str:
        return _markup([self])


def _markup(parts: list[Node | str]) -> str:
    """Without recursion: elements that are never closed may nest as deep as a page is long."""
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = list(reversed(parts))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(html.escape(x, quote=False))
        elif isinstance(x, tuple):
            out.append(f"</{x[0]}>")
        else:
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items())
            out.append(f"<{x.tag}{attrs}/>" if x.tag in VOID else f"<{x.tag}{attrs}>")
            if x.tag not in VOID:
                stack.append((x.tag,))
                stack += reversed(x.children)
    return "".join(out)


class Measure(NamedTuple):
    """Of an element's text: its strings that aren't blank, their characters and commas, and the characters of the links in it."""

    strings: int = 0
    chars: int = 0
    commas: int = 0
    linked: int = 0

    @property
    def length(self) -> int:
        """Of ``text()``."""
        return self.chars + max(0, self.strings - 1)


def measures(root: Node) -> dict[int, Measure]:
    """By id, of an element and all below, from the innermost outwards: every string is read once, however deep it stands."""
    out: dict[int, Measure] = {}
    for node in reversed([root, *root.walk()]):
        strings = chars = commas = linked = 0
        for c in node.children:
            if isinstance(c, str):
                if c := c.strip():
                    strings, chars, commas = strings + 1, chars + len(c), commas + c.count(",") + c.count("，")
                continue
            m = out[id(c)]
            linked += m.linked + (m.length if c.tag == "a" else 0)
            if c.tag not in ("script", "style"):
                strings, chars, commas = strings + m.strings, chars + m.chars, commas + m.commas
        out[id(node)] = Measure(strings, chars, commas, linked)
    return out


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCK else set())
        node = self.now
        while shut and node.tag in shut:
            node = node.parent
        self.now = node
        new = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(new)
        if tag not in VOID:
            self.now = new

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.now.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no known section: HTML takes all to the next > as a comment
            return self.parse_bogus_comment(i)


#: Numbers too long for int(); no character has one of more than seven digits.
_LONG = re.compile(r"&#(?=[0-9]{4000})0*([0-9]{8})[0-9]*")


def parse(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(_LONG.sub(r"&#\1", page or ""))
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


def _matches(node: Node, simple: str) -> bool:
    for tag, cls, ident, attr, op, value in _SIMPLE.findall(simple):
        own = node.attrs.get(attr or "class", "")
        good = (
            tag in ("*", node.tag)
            if tag
            else cls in own.split()
            if cls
            else node.attrs.get("id") == ident
            if ident
            else attr in node.attrs
            and (not op or own == value and op == "=" or op == "*=" and value in own or op == "^=" and own.startswith(value) or op == "$=" and own.endswith(value))
        )
        if not good:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that match, in order."""
    out = []
    chains = [x.split() for x in selector.split(",")]
    for node in root.walk():
        for chain in chains:
            if chain and _matches(node, chain[-1]):
                up, left = node.parent, chain[:-1]
                while up and left:
                    if _matches(up, left[-1]):
                        left = left[:-1]
                    up = up.parent
                if not left:
                    out.append(node)
                    break
    return out
