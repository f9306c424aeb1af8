"""Messages, titles, links and tables out of captured pages.

Spark spreads the pages; each task parses one page at a time and yields plain rows. Everything after the parse
(roles, cleaning, repeats, reports) is done by the column expressions of ``operators``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, stable_hash
from ..functions.urls import PLATFORMS, conversation_id, host
from ..operators.schema import CANVAS, CODE, IMAGE, SOURCE, THINKING
from ..operators.shared import pieces
from .dom import Node, matches, parsed, visible

#: Elements of a message that are interface, not content.
INTERFACE = (
    "button, svg, script, style, noscript, template, form, input, textarea, select, [hidden], [aria-hidden='true'], [role='button'], "
    "[contenteditable='true'], [data-testid*='copy' i], [data-testid*='feedback' i], [data-testid*='regenerate' i], [data-testid*='thinking' i], "
    "[data-testid*='reasoning' i], [data-testid*='thought' i], [data-testid*='canvas' i], .sr-only"
)
BLOCKS = frozenset("address article aside blockquote dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header li main nav ol p section ul".split())
_LINK = re.compile(r"https?://[^/\s]|mailto:", re.I)
_SPACE = re.compile(r"\s+")


def one_line(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def language_of(pre: Node) -> str | None:
    """From attributes, then from a class of the block or its code element."""
    near = [*pre.select("code"), *pre.up()]
    for name in ("data-language", "data-code-language", "lang"):
        for node in near:
            if one_line(node.attrs.get(name, "")) and (name != "lang" or node.tag in ("pre", "code")):
                return one_line(node.attrs[name])
    for node in near[: len(pre.select("code")) + 1]:
        for cls in node.attrs.get("class", "").split():
            if m := re.match(r"(?:language|lang)-(.+)", cls):
                return m[1]
    return None


def code_blocks(node: Node) -> list[dict]:
    out = []
    for pre in (n for n in node.walk() if n.tag == "pre"):
        inner = pre.select("code")
        code = (inner[0] if inner else pre).text()
        if code.strip():
            out.append({"language": language_of(pre), "code": code})
    return out


# Elements whose images belong to the interface, that hold avatars, and that show content, and words of an alt text that do.
CONTROLS = "button, form, input, textarea, select, [role='button'], [role='checkbox'], [role='menuitem'], [contenteditable='true'], [data-testid*='copy' i], [data-testid*='feedback' i], [data-testid*='regenerate' i], [data-testid*='rating' i], [aria-label*='copy' i], [aria-label*='copied' i], [aria-label*='feedback' i], [aria-label*='regenerate' i]"
AVATARS = "[data-testid*='avatar' i], [class*='avatar' i]"
SHOWN = "figure, [data-testid*='image' i], [data-testid*='attachment' i]"
SHOWN_WORDS = re.compile(r"\b(?:diagram|chart|photo|image|screenshot|attachment|uploaded)\b", re.A)
ICON_SIZE = 64


def content_images(node: Node) -> list[dict]:
    """Images that are content: visible, no part of a control, no avatar, not tiny unless something speaks for them."""
    out = []
    for img in (n for n in node.walk() if n.tag == "img"):
        size = [int(v) if (v := img.attrs.get(k, "").strip()).isdigit() and int(v) > 0 else None for k in ("width", "height")]
        alt, src, around = img.attrs.get("alt"), img.attrs.get("src", ""), list(img.up())
        said = (alt or "").lower()
        inside = lambda selector: any(matches(n, selector) for n in around)  # noqa: E731, B023
        if not src or not visible(img) or inside(CONTROLS):
            continue
        if "avatar" in said or said in ("user", "chatgpt") or not src[:5].lower() == "data:" and "avatar" in src.lower() or inside(AVATARS):
            continue
        if None not in size and max(size) <= ICON_SIZE and not inside(SHOWN) and not SHOWN_WORDS.search(said.strip()):
            continue
        data = src if src[:11].lower() == "data:image/" else None
        out.append({"alt": alt, "src": None if data else src or None, "dataUri": data, "width": size[0], "height": size[1]})
    return out


def table_rows(table: Node) -> list[list[str]]:
    rows = [[one_line(c.text()) for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in table.walk() if tr.tag == "tr"]
    rows = [r for r in rows if r]
    wide = max(map(len, rows), default=0)
    return [r + [""] * (wide - len(r)) for r in rows]


def table_markdown(table: Node) -> str:
    rows = [[c.replace("\\", "\\\\").replace("|", "\\|") for c in r] for r in table_rows(table)]
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def inline_markup(x: Node, markdown: bool) -> str | None:
    """What an inline element shows by itself; None where its children are shown."""
    if x.tag == "br":
        return "\0"
    if x.tag == "img":
        label = one_line(x.attrs.get("alt", "")) or "Image"
        src = x.attrs.get("src", "")
        return f"![{label}]({src})" if markdown and re.match("https?://", src) else f"Image: {label}"
    if x.tag == "code" and markdown:
        t = one_line(x.text())
        return f"`` {t} ``" if "`" in t else f"`{t}`"
    if x.tag == "a" and markdown and _LINK.match(x.attrs.get("href", "").strip()):
        label = one_line(x.text()).replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
        return f"[{label or x.attrs['href'].strip()}]({x.attrs['href'].strip()})"
    return None


def block_markup(x: Node, markdown: bool, skip: set[int], depth: int) -> str | None:
    """The text of a block that is laid out as a whole; None where its children are."""
    if x.tag == "pre":
        code = (x.select("code") or [x])[0].text().replace("\r\n", "\n").strip("\n")
        longest = max(map(len, re.findall("`+", code)), default=0)
        mark = "`" * max(3, longest + 1)
        language = re.sub(r"[^\w-]", "", language_of(x) or "", flags=re.A)
        return f"{mark}{language}\n{code}\n{mark}" if markdown else code
    if x.tag == "table":
        return table_markdown(x) if markdown else "\n".join("\t".join(r) for r in table_rows(x))
    if x.tag in ("ul", "ol") and markdown and depth < MAX_LISTS:
        items = [render(c, True, skip, depth + 1) for c in x.children if isinstance(c, Node) and c.tag == "li" and id(c) not in skip]
        return "\n".join(f"{'-' if x.tag == 'ul' else f'{i}.'} " + t.replace("\n", "\n  ") for i, t in enumerate(items, 1))
    return None


#: Lists nested deeper than this are laid out as plain blocks.
MAX_LISTS = 50


def render(node: Node, markdown: bool, skip: set[int], depth: int = 0) -> str:
    """Blocks of a message joined by blank lines, as text or as Markdown; ``skip`` holds interface elements."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = "\n".join(one_line(x) for x in "".join(run).split("\0")).strip("\n")
        run.clear()
        if text.strip():
            blocks.append(text)

    # What is still to come, last first; None ends a block. Markup can be nested deeper than Python's stack.
    open_: list = [*reversed(node.children)]
    while open_:
        x = open_.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif id(x) in skip:
            continue
        elif x.tag not in BLOCKS and x.tag not in ("pre", "table"):
            shown = inline_markup(x, markdown)
            if shown is None:
                open_.extend(reversed(x.children))
            else:
                run.append(shown)
        else:
            flush()
            shown = block_markup(x, markdown, skip, depth)
            if shown is None:
                open_.append(None)
                open_.extend(reversed(x.children))
            elif shown or x.tag != "table":
                blocks.append(shown)
    flush()
    return "\n\n".join(blocks)


# Where a message shows its reasoning, canvases and sources.
THINKING_AT = ", ".join(f"[{attr}*='{x}' i]" for attr in ("data-testid", "aria-label") for x in ("thinking", "reasoning", "thought"))
CANVAS_AT = "[data-testid*='canvas' i], [aria-label*='canvas' i]"
SOURCES_AT = "sup a, a[data-source-kind], a[data-source-id], a[data-citation-id], [data-testid*='citation' i] a, [data-testid*='source' i] a, a[aria-label*='source' i], a[aria-label*='citation' i]"
CANVAS_WARNING = "Canvas content was detected but could not be extracted from the current DOM. Open the canvas link or capture it manually."
SOURCE_KINDS = ("citation", "deep_research", "web_search")


def first_attribute(nodes: Iterable[Node | None], names: tuple[str, ...]) -> str | None:
    """The first of these attributes that is there and not blank, element by element."""
    return next((v for n in nodes if n is not None for name in names if (v := n.attrs.get(name, "").strip())), None)


def first_text(node: Node, selector: str) -> str | None:
    return next((t for n in node.select(selector) if (t := one_line(n.text()))), None)


def content_kind(node: Node, turn: Node | None) -> str | None:
    named = first_attribute((node, turn), ("data-content-type",))
    if named and re.sub(r"[\s-]+", "_", named.lower()) == "deep_research" or node.select("[data-testid*='deep-research' i], [aria-label*='Deep Research' i]"):
        return "deep_research"
    return None


def sources_of(node: Node, kind: str | None = None) -> list[dict]:
    """Safe links of citations and source lists with the text around them, the first of each."""
    out: dict = {}
    for a in node.select(SOURCES_AT):
        url = a.attrs.get("href", "").strip()
        if not _LINK.match(url):
            continue
        above = list(a.up())
        named = first_attribute([a], ("data-source-kind",))
        if named and named.lower() in SOURCE_KINDS:
            own = named.lower()
        elif any(matches(n, "sup, [data-testid*='citation' i]") for n in above):
            own = "citation"
        elif any(matches(n, "[data-testid*='search' i], [aria-label*='search' i]") for n in above):
            own = "web_search"
        else:
            own = kind or "citation"
        ident = first_attribute([a], ("data-source-id", "data-citation-id"))
        title = one_line(a.text()) or one_line(a.attrs.get("aria-label", "")) or url
        around = next((n for n in above if n.tag in ("li", "p", "section", "div")), None)
        snippet = one_line(around.text()) if around else None
        out.setdefault((own, ident, url, title), {"id": ident, "kind": own, "title": title, "url": url, "snippet": snippet or None})
    return list(out.values())


def thinking_of(node: Node) -> list[dict]:
    """Visible reasoning: a title where there is one, and the text without it."""
    out = []
    for n in node.select(THINKING_AT):
        if visible(n):
            title = first_text(n, "summary") or one_line(n.attrs.get("aria-label", ""))
            out.append({"title": title or None, "text": render(n, False, {id(x) for x in n.select("summary")})})
    return [x for x in out if x["text"].strip()]


def canvases_of(node: Node) -> list[dict]:
    """Documents beside the conversation: their title and link; their text is not in the page."""
    out = []
    for n in node.select(CANVAS_AT):
        if visible(n):
            href = next((a.attrs["href"].strip() for a in n.select("a[href]")), "")
            title = first_attribute([n], ("data-title", "aria-label")) or first_text(n, "h1, h2, h3") or "Canvas"
            out.append({"title": title, "text": None, "url": href if _LINK.match(href) else None, "warning": CANVAS_WARNING})
    return out


def vendor_parts(node: Node) -> dict:
    """Time, model, participant, kind, sources, reasoning and canvases of a message, from it and then from its turn."""
    turn = next((n for n in node.up() if n is not node and n.attrs.get("data-testid", "").startswith("conversation-turn-")), None)
    both, kind = (node, turn), content_kind(node, turn)
    times = [t.attrs["datetime"] for n in both if n is not None for t in n.select("time[datetime]")]
    return {
        "created_at": first_attribute(both, ("data-created-at", "data-timestamp")) or next(iter(times), None),
        "model": first_attribute(both, ("data-model", "data-message-model", "data-message-model-slug")) or first_text(node, "[data-testid*='model' i], [aria-label*='model' i]"),
        "participant": first_attribute(both, ("data-participant-name", "data-author-name")) or first_text(node, "[data-testid*='participant' i], [data-testid*='author' i]"),
        "content_kind": kind, "sources": sources_of(node, kind) or None, "thinking_blocks": thinking_of(node) or None, "canvas": canvases_of(node) or None,
    }


def message_id(node: Node) -> str | None:
    """The first id attribute that is there; an empty one still hides the others, but not the turn's."""
    for name in ("data-message-id", "data-message-id-testid", "id"):
        if name in node.attrs:
            if node.attrs[name]:
                return node.attrs[name]
            break
    return next((n.attrs["data-testid"] for n in node.up() if n.attrs.get("data-testid", "").startswith("conversation-turn-")), None)


def messages_of(root: Node, platform) -> Iterator[dict]:
    """Outermost message elements of a page in order, with role, author, texts and what they hold."""
    every = ", ".join(s for _, _, s in platform.messages)
    found = [n for n in root.walk() if matches(n, every)]
    inner = {id(n) for n in found if any(id(u) in {id(f) for f in found} for u in n.up() if u is not n)} if platform.name != "chatgpt" else set()
    for node in found:
        if id(node) in inner or not visible(node):
            continue
        role, author, _ = next(m for m in platform.messages if matches(node, m[2]))
        body = next(iter(node.select(platform.content)), node) if platform.content else node
        skip = {id(n) for n in body.walk() if n is not body and matches(n, INTERFACE)}
        row = {
            "id": message_id(node), "role": role or node.attrs["data-message-author-role"], "author_label": author or None, "text": render(body, False, skip),
            "markdown": render(body, True, skip), "code_blocks": code_blocks(body), "images": content_images(body),
        }
        if platform.name == "chatgpt":
            row |= vendor_parts(node)
        else:
            row |= {"sources": sources_of(node) or None, "created_at": next((n.attrs["datetime"] for n in node.select("time[datetime]")), None)}
        if row["text"] or row["code_blocks"]:
            yield row


_ROW = f"page_id long, url string, platform string, page_title string, idx int, id string, role string, author_label string, text string, markdown string, code_blocks array<{CODE}>, images array<{IMAGE}>, sources array<{SOURCE}>, created_at string, model string, participant string, content_kind string, thinking_blocks array<{THINKING}>, canvas array<{CANVAS}>"


def _held(row: dict) -> int:
    """About the bytes of a row: its texts and what it lists."""
    return 500 + sum(len(v) if isinstance(v, str) else sum(_held(x) for x in v) if isinstance(v, list) else 0 for v in row.values())


def extract_messages(pages: DataFrame) -> DataFrame:
    """Raw messages of ``pages`` (page_id, url, html): the page's platform by host, else by what its markup shows.

    Pages of no platform, with null html or without messages give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..operators.schema import struct_of

    schema = to_arrow_schema(struct_of(_ROW))
    known = {h: p for p in PLATFORMS for h in p.hosts}

    def of_page(page: dict) -> Iterator[dict]:
        with parsed(page["html"]) as root:
            platform = known.get(page["host"]) or next((p for p in PLATFORMS if any(matches(n, s) for _, _, s in p.messages for n in root.walk())), None)
            if platform is None:
                return
            title = next((one_line(n.text()) for n in root.walk() if n.tag == "title"), None)
            base = {"page_id": page["page_id"], "url": page["url"], "platform": platform.name, "page_title": title}
            for i, m in enumerate(messages_of(root, platform)):
                yield base | {"idx": i} | m

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces(batches, _held, of_page, lambda rows: pa.RecordBatch.from_pylist(rows, schema=schema))

    return pages.select("page_id", "url", host(F.col("url")).alias("host"), "html").mapInArrow(run, _ROW)


def scan(pages: DataFrame) -> DataFrame:
    """Raw messages keyed by page, with the ids that need the text filled in: ready for ``normalize``."""
    rows = extract_messages(pages)
    derived = F.concat(F.col("role"), F.lit("-"), stable_hash(clean_text(F.col("text"))))
    facts = F.map_filter(F.create_map(F.lit("adapter"), F.col("platform"), F.lit("contentKind"), F.col("content_kind")), lambda k, v: v.isNotNull())
    return rows.withColumns({"conv_id": F.col("page_id"), "id": F.coalesce("id", derived), "conversation_id": conversation_id(F.col("url")), "metadata": facts}).drop("content_kind")


def containers(pages: DataFrame) -> DataFrame:
    """page_id, tag, n_messages: the scrolling element that holds most messages of each page, or the root element.

    An element scrolls if its own style says so; of equals the first stands.
    """
    every = ", ".join(s for p in PLATFORMS for _, _, s in p.messages)

    def of_page(page: dict) -> list[tuple]:
        with parsed(page["html"]) as root:
            held: dict[int, int] = {}
            for m in (n for n in root.walk() if matches(n, every)):
                for above in m.up():
                    if above is not m:
                        held[id(above)] = held.get(id(above), 0) + 1
            rows = [(page["page_id"], at, n.tag, held[id(n)]) for at, n in enumerate(root.walk()) if id(n) in held and _SCROLLS.search(n.attrs.get("style", ""))]
            return [*rows, (page["page_id"], -1, "html", 0)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32())
        return pieces(batches, lambda _: 200, of_page, lambda rows: pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "at", "tag", "n_messages"]))

    found = pages.select("page_id", "html").mapInArrow(run, "page_id long, at int, tag string, n_messages int")
    best = F.max_by(F.struct("tag", "n_messages"), F.struct("n_messages", (-F.col("at")).alias("first")))
    return found.groupBy("page_id").agg(best.alias("b")).select("page_id", "b.*")


_SCROLLS = re.compile(r"overflow(?:-y)?\s*:\s*(?:auto|scroll|overlay)", re.I)


_CONTENT = "page_id long, title string, n_links long, n_tables long, n_code long, text string, links array<struct<text:string,href:string>>"


def page_content(pages: DataFrame, bare: bool = True) -> DataFrame:
    """Any page by the same cleaning: title, text, safe links, numbers of tables and code blocks; ``bare`` as in ``dom.parse``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..operators.schema import struct_of

    schema = to_arrow_schema(struct_of(_CONTENT))

    def of_page(page: dict) -> Iterator[dict]:
        with parsed(page["html"], bare) as root:
            skip = {id(n) for n in root.walk() if matches(n, INTERFACE) or n.tag in ("head", "title")}
            links = [{"text": one_line(a.text()), "href": a.attrs["href"].strip()} for a in root.walk() if a.tag == "a" and _LINK.match(a.attrs.get("href", "").strip())]
            title = next((one_line(n.text()) for n in root.walk() if n.tag == "title"), None)
            yield {"page_id": page["page_id"], "title": title, "n_links": len(links), "n_tables": sum(n.tag == "table" for n in root.walk()), "n_code": len(code_blocks(root)), "text": render(root, False, skip), "links": links}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces(batches, _held, of_page, lambda rows: pa.RecordBatch.from_pylist(rows, schema=schema))

    return pages.select("page_id", "html").mapInArrow(run, _CONTENT)
