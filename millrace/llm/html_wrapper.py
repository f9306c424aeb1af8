"""Main text of web pages by wrappers inferred per host.

A page's token stream is repaired into nested elements, its runs of like siblings become repeated groups, and the
streams of one host are aligned step by step: where two differ, what only one has becomes an optional group, what
both have is merged; there are no alternatives (a union-free regular expression). Every page is then matched against
its host's wrapper, which names the slot of each of its texts. On a page without an article or main element the wrapper
decides: slots that hold the same text wherever their group occurs belong to the template and are dropped, slots that
differ from page to page hold content, and the lowest element around the content slots is the main region. Where a page
names its region itself (an article, or a main element without one), all that stands in it is kept, whatever other pages
of the host hold: the text of such a page does not depend on the rest of the table.

Elements stand apart (menus, adverts, comments and the like) by their name, or by a word of their class, id or role.
Words say nothing about the whole page or its article, nor about what holds the article; a word beside "no", "has" or
"layout" says nothing either, and the header of a post or article is its own. Inside an article or main element only
names made of such words alone count ("comments", "related-links", not "related-work"), and an article inside another
that is named a comment is one.

Pages are first reduced to their distinct shapes per host (a partial aggregation), so a host with a third of all
pages is aligned over its few shapes, in a tree of merges of about FAN_IN shapes each.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from json.encoder import encode_basestring as quoted
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup_join, steps, tidy
from .url_filter import host_of

# Fixed values of HTML: elements without content, of raw text, that close an open paragraph, and that never hold main text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ITEM_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
APART = {"head", "nav", "aside", "footer", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "svg", "canvas", "dialog", "menu", "textarea", "title", "xmp"}
#: Words of class, id or role that mark what is not main text: whole words and, after them, beginnings.
APART_WORDS = {"ad", "ads", "adbox", "aside", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "signup", "tags"}
APART_STARTS = ("advert", "cookie", "comment", "sidebar", "newsletter", "sponsor")
#: Inside an article or main element: names of these words alone, or of these and words that name a box or list.
APART_INSIDE = {"ad", "adbox", "ads", "advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notices", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
BOXES = {"area", "bar", "block", "body", "box", "buttons", "container", "form", "item", "items", "links", "list", "notice", "post", "article", "posts", "articles", "section", "wrap", "wrapper"}
#: Words beside which the others describe a page ("no-sidebar", "page-with-comments"), and a text's own parts ("post-header").
OF_PAGE = {"no", "not", "has", "with", "without", "layout", "page", "body", "site", "theme"}
OF_TEXT = {"post", "entry", "article", "content", "story", "main", "text"}
#: Elements that words never set apart, and those of them that hold a page's main text.
WHOLE, LANDMARKS = {"html", "body", "main", "article"}, ("article", "main")
#: What an end tag of another element than a block does not close.
REGIONS = {"article", "main", "td", "body"}
#: Deeper elements lie beside one another in the wrapper.
MAX_DEPTH = 60

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: Classes are compared up to their first digit: post-123 is a class of one page.
_DIGITS = re.compile(r"[0-9].*", re.S)
_COMMENT = re.compile(r"comments?(?![a-z0-9])|comment[-_]?[0-9]|repl(?:y|ies)$", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _marked(tokens: list[str]) -> bool:
    """Whether one of these classes, ids or roles sets its element apart."""
    for token in tokens:
        parts = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
        if parts & OF_PAGE:
            continue
        found = parts & APART_WORDS
        if parts & OF_TEXT:
            found -= {"header"}
        if found or any(w.startswith(APART_STARTS) for w in parts):
            return True
    return False


def _marked_inside(tokens: list[str]) -> bool:
    """Whether one of these names sets its element apart although it lies in an article or main element."""
    for token in tokens:
        parts = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
        if parts & APART_INSIDE and parts <= APART_INSIDE | BOXES:
            return True
    return False


#: Why an element stands apart: its name (or that it is hidden), or a word of its class, id or role.
NAME, WORDS = 1, 2


class Element(NamedTuple):
    """What a start tag says by itself."""

    name: str
    label: str  # name and classes
    kind: str  # the label's name
    apart: int  # why the element stands apart, outside a region
    apart_inside: int  # and inside of one
    leaf: bool  # it has no end tag
    opens: tuple  # its events, the first for each reason to stand apart
    closes: tuple


def _element(name: str, attributes: str) -> Element:
    name = name.lower()
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    names = [t for k in ("class", "id", "role") for t in found.get(k, "").split()]
    if name in APART or name not in WHOLE and ("hidden" in found or found.get("aria-hidden") == "true"):
        apart = inside = NAME
    elif name == "article":  # inside a region another text, or a reader's comment
        apart, inside = 0, WORDS if any(_COMMENT.match(t) for t in names) else 0
    elif name in WHOLE:
        apart = inside = 0
    else:
        apart, inside = (WORDS if marked(names) else 0 for marked in (_marked, _marked_inside))
    label = ".".join([name, *sorted({_DIGITS.sub("#", c) for c in entities.unescape(found.get("class", "")).split()})])
    kind, leaf = label.split(".")[0], name in VOID or attributes.endswith("/") and name not in BLOCK
    return Element(name, label, kind, apart, inside, leaf, tuple(("open", label, why, kind) for why in (0, NAME, WORDS)), ("close", label, 0, kind))


#: Tags of up to so many characters are remembered, so many of them.
TAG_CHARS, TAGS = 200, 8192
_remembered = lru_cache(TAGS)(_element)


class Parsed(NamedTuple):
    """A page's elements and texts in order."""

    events: list[tuple[str, str, int, str]]  # (kind, value, apart, name): see ``parsed``
    families: list[tuple[int, list[int], list[str]]]  # parents before children: opening event (-1: none), its children's events and labels
    landmarks: bool  # whether there is an article or main element


def parsed(page: str) -> Parsed:
    """Events are "open" and "close" with the element's label (name and classes) and name, and "text" with raw text.

    Every open has its close; elements whose end is implied are closed where HTML closes them. ``apart`` tells that
    an element holds no main text. Where all articles (or main elements) of a page lie in elements that words set
    apart, those elements are not. Elements nested more than MAX_DEPTH deep are children of the last above, and white
    space between elements is no child.
    """
    seen: list[tuple[str, str, int, str]] = []
    family: tuple[int, list[int], list[str]] = (-1, [], [])
    families = [family]
    stack: list[tuple[Element, int, tuple]] = []  # open elements, why they stand apart, and the family that they stand in
    names: list[str] = []
    named = held = False

    def close_to(depth: int) -> tuple:
        del names[depth:]
        while len(stack) > depth:
            own, _, outer = stack.pop()
            seen.append(own.closes)
        return outer

    at, more = 0, True
    while more:
        more = False
        for m in _TOKEN.finditer(page, at):
            start, after = m.span()
            if start > at:
                text = page[at:start]
                if not text.isspace():
                    family[1].append(len(seen))
                    family[2].append("#")
                seen.append(("text", text, 0, ""))
            at = after
            end, name, attributes, other_end, other_name, other = m.groups()
            if name is None:
                if other_name is None:
                    continue
                end, name, attributes = other_end, other_name, other
            if end:
                name = name.lower()
                if names and names[-1] == name:
                    names.pop()
                    own, _, family = stack.pop()
                    seen.append(own.closes)
                    continue
                for depth in range(len(names) - 1, -1, -1):
                    opened = names[depth]
                    if opened == name:
                        family = close_to(depth)
                        break
                    if opened in REGIONS and name not in BLOCK:
                        break
                continue
            if attributes and not _ATTRIBUTE.search(attributes):
                attributes = attributes[-1]
            own = (_remembered if len(name) + len(attributes) <= TAG_CHARS else _element)(name, attributes)
            name, label, kind, apart, inside, leaf, opens, closes = own
            if name in BLOCK and "p" in names:
                for depth in range(len(names) - 1, -1, -1):
                    opened = names[depth]
                    if opened == "p":
                        family = close_to(depth)
                        break
                    if opened in BLOCK:
                        break
            if name in ITEM:
                for depth in range(len(names) - 1, -1, -1):
                    opened = names[depth]
                    if opened in ITEM_SCOPE[name]:
                        break
                    if opened in ITEM[name]:
                        family = close_to(depth)
                        break
            if apart != inside and ("article" in names or "main" in names):
                apart = inside
            if kind in LANDMARKS:
                named = True
                held = held or any(why == WORDS for _, why, _ in stack)
            k = len(seen)
            family[1].append(k)
            family[2].append(label)
            seen.append(opens[apart])
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                seen.append(closes)
                more = True
                break
            if leaf:
                seen.append(closes)
                continue
            stack.append((own, apart, family))
            names.append(name)
            if len(stack) <= MAX_DEPTH:
                family = (k, [], [])
                families.append(family)
    if at < len(page):
        text = page[at:]
        if not text.isspace():
            family[1].append(len(seen))
            family[2].append("#")
        seen.append(("text", text, 0, ""))
    if stack:
        close_to(0)
    return Parsed(_freed(seen) if held else seen, families, named)


def _freed(found: list) -> list:
    """The events where no landmark of a kind stands free of words: what words set apart around those is not apart."""
    for landmark in LANDMARKS:
        around: set[int] = set()
        stack: list[int] = []
        by_name = by_word = 0
        free = held = False
        for k, (kind, _, apart, name) in enumerate(found):
            if kind == "open":
                if name == landmark and not by_name:
                    held, free = True, free or not by_word
                    around.update(i for i in stack if found[i][2] == WORDS)
                stack.append(k)
                by_name, by_word = by_name + (apart == NAME), by_word + (apart == WORDS)
            elif kind == "close":
                apart = found[stack.pop()][2]
                by_name, by_word = by_name - (apart == NAME), by_word - (apart == WORDS)
        if held and not free:
            found = [(kind, value, 0 if k in around else apart, name) for k, (kind, value, apart, name) in enumerate(found)]
        if held:
            break
    return found


# A wrapper node is [label, mark, children]; mark is "" once, "?" optional, "+" repeated, "*" both. "#" is a text slot.


def _mark(a: str, b: str) -> str:
    optional, repeated = a in "?*" and a != "" or b in "?*" and b != "", a in "+*" and a != "" or b in "+*" and b != ""
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


def _common(a: str, b: str) -> str | None:
    """The label that two labels share, or None: the name and the classes of both, of which there is one at least."""
    if a == b:
        return a
    name, *own = a.split(".")
    other, *theirs = b.split(".")
    both = sorted(set(own) & set(theirs))
    return ".".join([name, *both]) if name == other and both else None


def merge(a: list, b: list) -> list:
    return [_common(a[0], b[0]) or a[0], _mark(a[1], b[1]), align(a[2], b[2])]


def fold(nodes: list) -> list:
    """Runs of like siblings become one repeated group."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = merge(out[-1], node)
            if node[0] != "#":
                out[-1][1] = _mark(out[-1][1], "+")
        else:
            out.append(node)
    return out


def _opcodes(left: list[str], right: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """How to turn one list into the other: a longest common subsequence, of equals the one that comes first.

    Bit i of a row tells whether the common length of ``left[i:]`` and the right list's rest is that of ``left[i + 1:]``;
    a row is one number, so lists of any length go the same way in a 64th of their product. Every ``step``-th row is kept
    and those between are made again on the way back.
    """
    n, m = len(left), len(right)
    full = (1 << n) - 1
    places: dict[str, int] = {}
    for i, label in enumerate(left):
        places[label] = places.get(label, 0) | 1 << (n - 1 - i)

    def rows(row: int, wanted: Iterable[str]) -> Iterator[int]:
        for label in wanted:
            met = row & places.get(label, 0)
            row = (row + met | row - met) & full
            yield row

    step = isqrt(m) + 1
    kept = {m: full}
    for k, row in zip(range(m - 1, -1, -1), rows(full, reversed(right))):
        if k % step == 0:
            kept[k] = row
    i = k = start = since = 0  # the difference at hand began at (start, since)
    block: list[int] = []
    first = -1
    while i < n and k < m:
        if left[i] == right[k]:
            if start < i or since < k:
                yield "replace", start, i, since, k
            j = i
            while i < n and k < m and left[i] == right[k]:
                i, k = i + 1, k + 1
            yield "equal", j, i, k - (i - j), k
            start, since = i, k
            continue
        if k // step != first:
            first = k // step
            upto = min(m, (first + 1) * step)
            block = list(rows(kept[upto], reversed(right[first * step : upto])))[::-1]
        if block[k - first * step] >> (n - 1 - i) & 1:
            i += 1
        else:
            k += 1
    if start < n or since < m:
        yield "replace", start, n, since, m


def _meeting(labels: list[str], wanted: list[str]) -> list[int]:
    """For each wanted label, in order, the next place in ``labels`` that shares it (see ``_common``); -1 where none is left."""
    places: dict[tuple[str, ...], list[int]] = {}
    for i, label in enumerate(labels):
        for key in _keys(label):
            places.setdefault(key, []).append(i)
    out, at = [], 0
    for label in wanted:
        found = (own[n] for key in _keys(label) if (own := places.get(key)) and (n := bisect_left(own, at)) < len(own))
        out.append(min(found, default=-1))
        at = max(at, out[-1] + 1)
    return out


def _keys(label: str) -> set[tuple[str, ...]]:
    """Labels have something in common where they share one of these: the whole, or the name with a class."""
    name, *classes = label.split(".")
    return {(label,), *((name, c) for c in classes)}


def align(a: list, b: list) -> list:
    """Align two sequences; what only one side has is optional, in the order of the sides."""
    if not a and not b:
        return []
    left, right = [n[0] for n in a], [n[0] for n in b]
    if left == right:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out = []
    for kind, i, j, k, m in _opcodes(left, right):
        if kind == "equal":
            out += [merge(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            at = i
            for y, x in zip(b[k:m], _meeting(left[i:j], right[k:m]), strict=True):  # elements that share a class meet, in order
                if x < 0:
                    out.append([y[0], _mark(y[1], "?"), y[2]])
                    continue
                out += [[n[0], _mark(n[1], "?"), n[2]] for n in a[at : i + x]]
                out.append(merge(a[i + x], y))
                at = i + x + 1
            out += [[n[0], _mark(n[1], "?"), n[2]] for n in a[at:j]]
    return fold(out)


def shape(page: str) -> list:
    """A page's own wrapper: its nested elements with like siblings folded."""
    return json.loads(shape_text(page))


def shape_text(page: str) -> str:
    """``shape`` as JSON. Parts are JSON on the way, too, so that small ones which pages have in common are aligned once."""
    folded: dict[int, str] = {}
    for parent, children, labels in reversed(parsed(page).families):
        out: list[str] = []
        last = whole = mark = ""
        for k, label in zip(children, labels, strict=True):
            own = folded.pop(k, "[]")
            if label != last:
                if last:
                    out.append(f"[{quoted(last)},{mark},{whole}]")
                last, whole, mark = label, own, '""'
            elif label != "#":
                mark = '"+"'
                if own != whole:
                    whole = (_met_before if len(whole) + len(own) <= PART_CHARS else _aligned_text)(whole, own)
        if last:
            out.append(f"[{quoted(last)},{mark},{whole}]")
        folded[parent] = f"[{','.join(out)}]"
    return folded[-1]


def _aligned_text(a: str, b: str) -> str:
    return _written(align(json.loads(a), json.loads(b)))


_written = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode
#: Parts of up to so many characters together are remembered, so many pairs of them.
PART_CHARS, PARTS = 1000, 4096
_met_before = lru_cache(PARTS)(_aligned_text)


def expression(nodes: list) -> str:
    """The wrapper as a regular expression over labels, to read."""
    return " ".join((n[0] if n[0] == "#" else f"<{n[0]}>{expression(n[2])}") .join("()" if n[1] else ("", "")) + n[1] for n in nodes)


class Wrapper:
    """A host's wrapper with its nodes numbered in order, to match pages against."""

    def __init__(self, nodes: list):
        self.kids: list[list[tuple[int, str, str]]] = []
        self.met: dict[tuple, list[int]] = {}
        self._number(nodes)

    def _number(self, nodes: list) -> int:
        own = len(self.kids)
        self.kids.append([])
        self.kids[own] = [(self._number(children), label, mark) for label, mark, children in nodes]
        return own

    def place(self, node: int, labels: tuple) -> list[int]:
        """The child of ``node`` that each of these siblings meets, or -1, in order."""
        if (found := self.met.get((node, labels))) is None:
            if len(self.met) > REMEMBERED:
                self.met.clear()
            found = self.met[node, labels] = self._place(self.kids[node], labels)
        return found

    @staticmethod
    def _place(kids: list, labels: tuple) -> list[int]:
        runs = [x for i, x in enumerate(labels) if not i or labels[i - 1] != x]
        if runs == [label for _, label, _ in kids]:
            to = list(range(len(runs)))
        else:
            to = _met(runs, kids)
        out, at = [], -1
        for i, x in enumerate(labels):
            at += not i or labels[i - 1] != x
            out.append(kids[to[at]][0] if to[at] >= 0 else -1)
        return out


def _met(runs: list[str], kids: list) -> list[int]:
    """The child that each run of siblings meets, or -1: most siblings, then most of what the wrapper needs.

    ``best[j]`` of row i is the most that runs from i on and children from j on can give; a row follows from the next one.
    Every ``step``-th row is kept and those between are made again on the way back, so that lists of any length go the
    same way with memory for few rows.
    """
    n, m = len(runs), len(kids)
    own, which = np.unique(np.array([label for _, label, _ in kids], object), return_inverse=True)
    wanted = [(label.split(".")[0], set(label.split(".")[1:])) for label in own]
    many = np.array([mark in ("+", "*") for _, _, mark in kids], bool)
    needed = np.array([mark not in ("?", "*") for _, _, mark in kids], np.int32) + 10
    known: dict[str, tuple] = {}

    def facts(label: str) -> tuple:
        """What meeting each child adds for this label, -1 where they do not meet; and where a child may be met again."""
        if label not in known:
            name, *classes = label.split(".")
            same = np.array([x == label for x in own], bool)[which]
            fits = same | np.array([name == other and bool(some) and some.issubset(classes) for other, some in wanted], bool)[which]
            known[label] = np.where(fits, needed + same, -1).astype(np.int32), many & ~same
        return known[label]

    def meets(i: int, after: np.ndarray) -> np.ndarray:
        adds, again = facts(runs[i])
        return np.where(adds >= 0, adds + np.where(again, after[:-1], after[1:]), -1)

    def row(i: int, after: np.ndarray) -> np.ndarray:
        out = np.zeros(m + 1, np.int32)
        out[:-1] = np.maximum.accumulate(np.maximum(after[:-1], meets(i, after))[::-1])[::-1]
        return out

    step = max(64, isqrt(n))
    kept = {n: np.zeros(m + 1, np.int32)}
    best = kept[n]
    for i in range(n - 1, step - 1, -1):
        best = row(i, best)
        if i % step == 0:
            kept[i] = best
    to, j = [-1] * n, 0
    for first in range(0, n, step):
        upto = min(n, first + step)
        block = [kept[upto]]
        for i in range(upto - 1, first - 1, -1):
            block.append(row(i, block[-1]))
        block.reverse()
        for i in range(first, upto):
            now, after = block[i - first], block[i - first + 1]
            gain = meets(i, after)
            # On to the first child that is met here, or from which on this run gives nothing.
            take = (gain >= now[1:]) & (gain >= after[:-1])
            stay = take | (after[:-1] > now[1:])
            at = j + int(np.argmax(stay[j:])) if stay[j:].any() else m
            if at < m and take[at]:
                to[i] = at
                again = many[at] and kids[at][1] != runs[i]
                j = at if again else at + 1
            else:
                j = at
            if j >= m:
                return to
    return to


def matched(page: str, wrapper: Wrapper | None) -> tuple[Parsed, list[int]]:
    """The page's parts and, for each event, the wrapper's node that it meets (-1: none)."""
    parts = parsed(page)
    node = [-1] * len(parts.events)
    if wrapper:
        for parent, children, labels in parts.families:
            own = 0 if parent < 0 else node[parent]
            if own >= 0 and children:
                for k, x in zip(children, wrapper.place(own, tuple(labels)), strict=True):
                    node[k] = x
    return parts, node


def _landmarks(parts: Parsed) -> set[int]:
    """The events that open the page's regions, if it names any: articles, and main elements without one."""
    found: set[int] = set()
    if not parts.landmarks:
        return found
    stack: list[tuple[int, str]] = []
    apart = 0
    holds: set[int] = set()  # main elements with an article inside
    for k, (kind, _, off, name) in enumerate(parts.events):
        if kind == "open":
            if apart or off:
                apart += 1
            stack.append((k, name))
            if not apart and name in LANDMARKS:
                found.add(k)
                if name == "article":
                    holds.update(i for i, n in stack if n == "main")
        elif kind == "close":
            stack.pop()
            if apart:
                apart -= 1
    return found - holds


def slots(page: str, wrapper: Wrapper) -> dict[int, tuple[str, bool]]:
    """(text, in a header) of each slot of the wrapper that the page fills; slots of one repeated group are one.

    Elements that stand apart are left out, and so is what a page with an article or main element has outside it.
    """
    parts, node = matched(page, wrapper)
    regions = _landmarks(parts)
    found: dict[int, list[str]] = {}
    bare: set[int] = set()  # slots that are not in headers only
    off = inside = head = 0
    for k, (kind, value, apart, name) in enumerate(parts.events):
        if kind == "open":
            if off or apart:
                off += 1
            if inside or k in regions:
                inside += 1
            if head or name == "header" and not inside:
                head += 1
        elif kind == "close":
            if off:
                off -= 1
            if inside:
                inside -= 1
            if head:
                head -= 1
        elif not off and (inside or not regions) and node[k] >= 0 and not value.isspace():
            found.setdefault(node[k], []).append(value)
            if not head:
                bare.add(node[k])
    return {slot: ("".join(texts), slot not in bare) for slot, texts in found.items()}


def _region(parts: Parsed, node: list[int], content: set[int]) -> int | None:
    """The event that opens the lowest element around the parents of the page's content slots; None for the whole page."""
    above = {k: parent for parent, children, _ in parts.families for k in children}
    off = head = 0
    common: list[int] | None = None
    paths: dict[int, list[int]] = {}
    for k, (kind, value, apart, name) in enumerate(parts.events):
        if kind == "open":
            off += 1 if off or apart else 0
            head += 1 if head or name == "header" else 0
        elif kind == "close":
            off -= 1 if off else 0
            head -= 1 if head else 0
        elif not off and not head and not value.isspace() and (node[k] < 0 or node[k] in content):
            own = above[k]
            if own not in paths:
                path, up = [], above[own] if own >= 0 else -1
                while up >= 0:
                    path.append(up)
                    up = above[up]
                paths[own] = path[::-1]
            path = paths[own]
            if common is None:
                common = path
            else:
                n = 0
                while n < min(len(common), len(path)) and common[n] == path[n]:
                    n += 1
                common = common[:n]
    return common[-1] if common else None


def _single_spaced(text: str) -> str:
    """The text with one space for all white space between its words, and none around."""
    # Of white space only the space itself is printable: most texts are found to be as they should without being split.
    if text.isprintable() and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text
    return " ".join(text.split())


def extract(page: str, template: set[int], content: set[int] | None, wrapper: Wrapper | None = None) -> str:
    """The main text: blocks joined by newlines.

    All of the article elements and of main elements without one; on a page that has neither, the lowest element around
    its slots of ``content``, else everything, without the slots of the ``template``. Never inside elements that stand
    apart.
    """
    page_parts, node = matched(page, wrapper)
    seen = page_parts.events
    regions = _landmarks(page_parts)
    start = _region(page_parts, node, content) if not regions and content is not None and wrapper else None
    template = set() if regions else template
    blocks: list[str] = []
    parts: list[str] = []
    off = inside = 0  # depth since the element that stands apart, or that opens the region

    def end_block():
        if text := _single_spaced(entities.unescape("".join(parts))):
            blocks.append(text)
        parts.clear()

    for k, (kind, value, apart, name) in enumerate(seen):
        if kind == "open":
            # A header that belongs to an article carries its title.
            if off or apart or name == "header" and not inside:
                off += 1
            if inside or (k in regions if regions else k == start):
                inside += 1
            if parts and (name in BLOCK or off == 1):
                end_block()
            elif name == "br" and not off:
                parts.append(" ")
        elif kind == "close":
            if parts and name in BLOCK:
                end_block()
            if off:
                off -= 1
            if inside:
                inside -= 1
        elif not off and (inside or not regions and start is None) and node[k] not in template:
            parts.append(value)
    end_block()
    return "\n".join(blocks)


#: On pages that name no region: pages of a host that must agree in a slot, their least share of its pages, and the share
#: of a slot's pages that have a text of their own where it holds content.
MIN_PAGES, MIN_SHARE, OWN_TEXTS = 5, 0.1, 0.5
#: Shapes aligned in one task at a time; placements remembered per wrapper, and wrappers per worker.
FAN_IN, REMEMBERED, WRAPPERS = 64, 20_000, 2_000
#: Wrappers are broadcast up to this many characters in all.
BROADCAST_CHARS = 16_000_000


@tidy
def _shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in steps(batch, "html"):
            shaped = [shape_text(page or "") for page in piece.column("html").to_pylist()]
            yield pa.record_batch([piece.column("host"), pa.array(shaped, pa.string())], ["host", "shape"])


def hash_text(text: str) -> int:
    return int.from_bytes(blake2b(_single_spaced(text).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _aligned(pdf: pd.DataFrame) -> list:
    whole = None
    for text in sorted(pdf["shape"]):
        nodes = json.loads(text)
        whole = nodes if whole is None else align(whole, nodes)
    return whole or []


def _align_part(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "shape": [_written(_aligned(pdf))], "pages": [int(pdf["pages"].sum())]})


def _known():
    """Text of a wrapper to the wrapper, remembered."""
    memory: dict[str, Wrapper] = {}

    def known(text: str | None) -> Wrapper | None:
        if text is None:
            return None
        if text not in memory:
            if len(memory) >= WRAPPERS:
                memory.clear()
            memory[text] = Wrapper(json.loads(text))
        return memory[text]

    return known


@tidy
def _slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _known()
    for batch in batches:
        for piece in steps(batch, "html"):
            ends, slot, hashes, heads, whole = [0], [], [], [], []
            for page, text in zip(piece.column("html").to_pylist(), piece.column("wrapper").to_pylist(), strict=True):
                for k, (v, head) in slots(page or "", known(text)).items() if text is not None else ():
                    slot.append(k)
                    hashes.append(hash_text(v))
                    heads.append(head)
                ends.append(len(slot))
                whole.append(hash_text(page or ""))
            found = pa.StructArray.from_arrays([pa.array(slot, pa.int32()), pa.array(hashes, pa.int64()), pa.array(heads, pa.bool_())], ["slot", "h", "head"])
            yield pa.record_batch([piece.column("host"), pa.array(whole, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["host", "page", "slots"])


def _beside(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Each page with its host's row of ``rules``, which hold the host's pages in ``freq``.

    All rules are broadcast while they are small together; else those of hosts with very many pages, as many as fit the
    same number of characters at the longest wrapper's length.
    """
    whole, longest, total = rules.agg(F.sum(F.length("wrapper")), F.max(F.length("wrapper")), F.sum("freq")).first()
    if (whole or 0) <= BROADCAST_CHARS:
        return pages.join(F.broadcast(rules.drop("freq")), "host", "left")
    return lookup_join(pages, rules, "host", total, max(1, BROADCAST_CHARS // longest)).drop("freq")


def wrappers(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, wrapper, pages, template and content (numbers of the wrapper's slots that are template, or content).

    The wrapper is JSON of nested [label, mark, children]; ``expression`` renders it and ``Wrapper`` numbers it. Null
    html is an empty page; pages without a host are a host of their own; repeated pages count as one where texts are
    compared; an empty table gives an empty result; other columns are ignored.
    """
    with Scratch(pages.sparkSession, "wrappers") as scratch:
        return scratch.settle(_wrappers(pages, min_pages, scratch), "wrappers", keep=True)


def _wrappers(pages: DataFrame, min_pages: int, scratch: Scratch) -> DataFrame:
    own = pages.select(host_of(F.col("url")).alias("host"), "html")
    whole = own.mapInArrow(_shapes, "host string, shape string").groupBy("host", "shape").agg(F.count("*").alias("pages"))
    whole = scratch.settle(whole, "shapes")
    while True:  # each round leaves a host 1 / FAN_IN of its shapes
        counts = scratch.settle(whole.groupBy("host").agg(F.count("*").alias("n")), "counts")
        if not (counts.agg(F.max("n")).first()[0] or 0) > 1:
            break
        parts = whole.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / FAN_IN)))
        whole = scratch.settle(parts.groupBy("host", "part").applyInPandas(_align_part, "host string, shape string, pages long"), "shapes")
    whole = whole.withColumnRenamed("shape", "wrapper")
    seen = _beside(own, whole.select("host", F.col("pages").alias("freq"), "wrapper")).select("host", "html", "wrapper").mapInArrow(_slots, "host string, page long, slots array<struct<slot: int, h: long, head: boolean>>")
    slot = seen.select("host", "page", F.inline("slots")).groupBy("host", "slot").agg(
        F.count("*").alias("on"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.approx_count_distinct("h").alias("texts"), F.approx_count_distinct("page").alias("unlike"), F.min("head").alias("head")
    )
    slot = slot.join(whole.select("host", "pages"), "host")
    same = (F.col("lo") == F.col("hi")) & (F.col("on") >= min_pages) & (F.col("unlike") > 1) & (F.col("on") >= MIN_SHARE * F.col("pages"))
    holds = ~F.col("head") & ((F.col("on") < min_pages) | (F.col("lo") != F.col("hi")) & (F.col("texts") >= OWN_TEXTS * F.col("unlike")))
    found = slot.groupBy("host").agg(F.collect_list(F.when(same, F.col("slot"))).alias("template"), F.collect_list(F.when(holds, F.col("slot"))).alias("content"), F.bool_or(F.col("lo") != F.col("hi")).alias("varies"))
    # On a host whose pages are all alike nothing tells the template from the content: no slot is dropped.
    return whole.join(found, "host", "left").select("host", "wrapper", "pages", F.when(F.col("varies"), F.col("template")).otherwise(F.array().cast("array<int>")).alias("template"), "content")


@tidy
def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _known()
    for batch in batches:
        for piece in steps(batch, "html"):
            rows = zip(*(piece.column(c).to_pylist() for c in ("html", "template", "content", "wrapper")), strict=True)
            texts = [extract(page or "", set(t or ()), set(c or ()), known(w)) for page, t, c, w in rows]
            yield pa.record_batch([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html is an empty page: its text is ''. Pages with a null url, or one without a host, form a host of their
    own. Repeated rows are all returned; an empty table gives an empty result; other columns are ignored. page_id keeps
    its type.
    """
    rules = wrappers(pages).select("host", F.col("pages").alias("freq"), "wrapper", "template", "content")
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return _beside(own, rules).select("page_id", "url", "html", "template", "content", "wrapper").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
