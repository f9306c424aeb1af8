"""A page as a tree of elements, and the few CSS selectors that platform descriptions use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag of the key ends open elements of the value, up to their list, table or row.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def up(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)

    def select(self, selector: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and matches(n, selector)]

    def free(self) -> None:
        """Takes the tree apart: parents and children hold each other, and would wait for a search for such circles."""
        for node in list(self.walk()):
            node.parent = None
            node.children.clear()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _end(self, tags: set | frozenset, stop: set | frozenset) -> None:
        found = None
        for node in self.at.up():
            if node.tag in stop or node.parent is None:
                break
            if node.tag in tags:
                found = node
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        elif tag in ENDS_P:
            self._end({"p"}, {"td", "th", "button", "table"})
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for node in self.at.up():
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return

    def handle_data(self, data):
        self.at.children.append(data)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;?)?")


def _whole_reference(m: re.Match) -> str:
    name = m[1] or ""
    return m[0] if name.startswith("#") or name.endswith(";") and name in html5 else "&amp;" + name


def parse(html: str | None, bare: bool = True) -> Node:
    """The tree of a page. ``bare``: references that lack their semicolon stand for their character, as in a browser;
    else they stay as they are written."""
    html = html or ""
    builder = _Builder()
    builder.feed(html if bare else _REFERENCE.sub(_whole_reference, html))
    builder.close()
    return builder.root


@contextmanager
def parsed(html: str | None, bare: bool = True) -> Iterator[Node]:
    """The tree of a page for as long as it is needed; none of its nodes may be kept."""
    root = parse(html, bare)
    try:
        yield root
    finally:
        root.free()


_SIMPLE = re.compile(r"""\[([\w-]+)(?:([*^]?=)['"]?([^'"\]]*)['"]?(\s+i)?)?\]|\.([\w-]+)|([\w-]+)|\*""")


@lru_cache(512)
def _compiled(selector: str) -> tuple:
    """Alternatives, each a chain of compounds, each a tuple of tests."""
    return tuple(tuple(tuple(m.groups() for m in _SIMPLE.finditer(part)) for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", one)) for one in selector.split(","))


def _fits(node: Node, compound: tuple) -> bool:
    for attr, op, value, fold, cls, tag in compound:
        if tag is not None and node.tag != tag.lower():
            return False
        if cls is not None and cls not in node.attrs.get("class", "").split():
            return False
        if attr is not None:
            have = node.attrs.get(attr.lower())
            if have is None:
                return False
            if op:
                have, want = (have.lower(), value.lower()) if fold else (have, value)
                if not (have == want if op == "=" else have.startswith(want) if op == "^=" else want in have):
                    return False
    return True


def matches(node: Node, selector: str) -> bool:
    for chain in _compiled(selector):
        if not _fits(node, chain[-1]):
            continue
        rest = list(chain[:-1])
        for above in node.up():
            if rest and above is not node and _fits(above, rest[-1]):
                rest.pop()
        if not rest:
            return True
    return False


def visible(node: Node) -> bool:
    """Neither it nor anything around it is hidden; styles count only as written here."""
    for n in node.up():
        style = n.attrs.get("style", "")
        if "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or "display: none" in style or "visibility: hidden" in style:
            return False
    return True
