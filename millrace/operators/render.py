"""Conversations as text: Markdown in five profiles, plain text, CSV, JSON and HTML.

Every message is rendered where it lies; one aggregate per conversation joins the pieces in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.images import dimensions, image_text, is_safe_url
from ..functions.urls import is_safe_link
from .schema import complete

NL = "\n"
SEPARATOR = "=" * 80
#: Names of the kinds of sources.
SOURCE_LABELS = {"citation": "Citation", "deep_research": "Deep Research source", "web_search": "Web Search source"}
CSV_COLUMNS = ("index", "role", "authorLabel", "text", "model", "createdAt", "messageId")


def lines(*parts) -> Column:
    """Parts joined by line feeds; null parts are left out."""
    return F.concat_ws(NL, *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _section(title: str, items: Column) -> Column:
    """A title and its items, or null where there are none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(title + NL), F.array_join(items, NL)))


def _kind(source: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SOURCE_LABELS.items() for x in pair])[source["kind"]]


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def source_line(source: Column, at: Column) -> Column:
    head = F.concat((at + 1).cast("string"), F.lit(". "), _kind(source), F.lit(": "), source["title"])
    return F.concat_ws(" - ", head, _some(source["url"]), _some(source["snippet"]))


def canvas_line(x: Column) -> Column:
    return F.concat_ws(" - ", _some(F.coalesce(x["title"], F.lit("Canvas"))), _some(x["url"]), _some(x["text"]), _some(x["warning"]))


def thinking_line(x: Column) -> Column:
    return F.when(F.length(x["title"]) > 0, F.concat(x["title"], F.lit(": "), x["text"])).otherwise(x["text"])


def _item(how):
    return lambda x: F.concat(F.lit("- "), how(x))


def advanced_text() -> list[Column]:
    """Sections of sources, canvases and thinking of the message at hand, null where empty."""
    sections = (
        _section("Sources:", F.transform("sources", lambda x, i: F.concat(F.lit("- "), source_line(x, i)))),
        _section("Canvas:", F.transform("canvas", _item(canvas_line))),
        _section("Visible thinking / reasoning:", F.transform("thinking_blocks", _item(thinking_line))),
    )
    return [F.concat(F.lit(NL), s) for s in sections]


def _escape(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("\\\\"))


def advanced_markdown() -> Column:
    base = F.coalesce(_some(F.regexp_replace(F.regexp_replace("id", "[^A-Za-z0-9_-]+", "-"), r"\A-+|-+\z", "")), F.lit("message"))

    def footnote(x: Column, i: Column) -> Column:
        link = F.concat(F.lit("["), T.link_text(x["title"]), F.lit("]("), x["url"], F.lit(")"))
        return F.concat(F.lit("[^"), base, F.lit("-source-"), (i + 1).cast("string"), F.lit("]: "), _kind(x), F.lit(" - "), link, F.coalesce(F.concat(F.lit(" - "), _some(x["snippet"])), F.lit("")))

    def canvas(x: Column) -> Column:
        link = F.coalesce(F.concat(F.lit(" [Open canvas]("), x["url"], F.lit(")")), F.lit(""))
        body = F.concat_ws(" ", _some(x["text"]), _some(x["warning"]))
        return F.concat(F.lit("- "), _escape(F.coalesce(x["title"], F.lit("Canvas"))), link, F.when(body != "", F.concat(F.lit(" - "), body)).otherwise(""))

    notes = F.when(F.size("sources") > 0, F.array_join(F.transform("sources", footnote), NL))
    thinking = _section("Visible thinking / reasoning:", F.transform("thinking_blocks", _item(lambda x: _escape(thinking_line(x)))))
    return F.concat_ws("\n\n", notes, _section("Canvas:", F.transform("canvas", canvas)), thinking)


def advanced_html() -> Column:
    """The same sections for a page."""
    escaped = T.html_escape

    def section(title: str, items: Column, label: str | None = None) -> Column:
        listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
        whole = F.concat(F.lit(f'<section class="advanced-section" aria-label="{label or title}"><h3>{title}</h3><ul>'), listed, F.lit("</ul></section>"))
        return F.when(F.size(items) > 0, whole)

    def link(url: Column, text: Column) -> Column:
        return F.concat(F.lit('<a href="'), F.when(is_safe_link(url), escaped(url)).otherwise("#"), F.lit('" rel="noreferrer">'), text, F.lit("</a>"))

    def source(x: Column) -> Column:
        return F.concat(_kind(x), F.lit(": "), link(x["url"], escaped(x["title"])), F.coalesce(F.concat(F.lit(" - "), escaped(_some(x["snippet"]))), F.lit("")))

    def canvas(x: Column) -> Column:
        body = F.concat_ws(" ", escaped(_some(x["text"])), escaped(_some(x["warning"])))
        opened = F.when(x["url"].isNotNull(), F.concat(F.lit(" "), link(x["url"], F.lit("Open canvas")))).otherwise("")
        return F.concat(escaped(F.coalesce(x["title"], F.lit("Canvas"))), opened, F.when(body != "", F.concat(F.lit(" - "), body)).otherwise(""))

    def thinking(x: Column) -> Column:
        return escaped(F.concat(F.coalesce(F.concat(x["title"], F.lit(": ")), F.lit("")), x["text"]))

    return F.concat_ws(
        "", section("Sources", F.transform("sources", source)), section("Canvas", F.transform("canvas", canvas)),
        section("Visible thinking / reasoning", F.transform("thinking_blocks", thinking), "Visible thinking or reasoning"),
    )


def code_text(x: Column) -> Column:
    return F.regexp_replace(T.line_feeds(x["code"]), r"\n*\z", "")


def code_markdown(x: Column) -> Column:
    mark = T.fence(x["code"])
    return F.concat(mark, F.coalesce(F.regexp_replace(x["language"], "[^A-Za-z0-9_-]", ""), F.lit("")), F.lit(NL), code_text(x), F.lit(NL), mark)


def message_markdown(escape: bool, advanced: bool = True) -> Column:
    """Body, images it does not show, extra sections if asked for, and code blocks unless the body has a fence."""
    blocks = _some(F.array_join(F.transform("code_blocks", code_markdown), "\n\n"))

    def image(x: Column) -> Column:
        source = F.coalesce(x["src"], x["localFilename"])
        label = T.link_text(F.coalesce(T.blank_to_null(x["alt"]), F.lit("Image")))
        linked = F.concat(F.lit("["), label, F.lit("]("), source, F.lit(")"), dimensions(x["width"], x["height"]))
        return F.when(is_safe_url(source), linked).otherwise(image_text(x))

    def with_images(body: Column) -> Column:
        unseen = F.filter("images", lambda x: ~F.coalesce(F.contains(body, F.coalesce(x["src"], x["localFilename"], x["dataUri"])), F.lit(False)))
        return F.concat_ws("\n\n", _some(body), _section("Images:", F.transform(unseen, _item(image))), _some(advanced_markdown()) if advanced else F.lit(None))

    def with_code(text: Column) -> Column:
        return F.when(text.rlike("(?m)^```"), text).otherwise(F.concat_ws("\n\n", _some(text), blocks))

    body = T.trim(T.line_feeds(F.coalesce("markdown", "text")))
    return T.let(T.let(T.html_outside_fences(body) if escape else body, with_images), with_code)


def _gather(messages: DataFrame, piece: Column) -> DataFrame:
    """conv_id, pieces: each conversation's rendered messages in order."""
    rows = messages.select("conv_id", F.struct("idx", piece.alias("piece")).alias("row"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["piece"]).alias("pieces"))


def _frontmatter(profile: str) -> Column:
    def one(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), T.yaml_string(value))

    obsidian = profile == "obsidian"
    tags = F.array(F.lit("ai-chat"), F.concat(F.lit("platform/"), T.tag_slug(F.col("platform"))), F.concat(F.lit("exported/"), F.substring("exported_at", 1, 10)))
    extra = [T.yaml_list("tags", tags), F.lit("backlinks: []")] if obsidian else []
    names = [one("platform", F.col("platform")), one("platform_label", F.col("platform_label"))] if obsidian else [one("platform", F.col("platform_label"))]
    return lines(
        "---", 'schema_version: "1.0"', f'profile: "{profile}"', *names, one("source_url", F.col("source_url")), one("title", F.col("title")),
        one("conversation_id", F.col("conversation_id")), one("exported_at", F.col("exported_at")), F.concat(F.lit("message_count: "), F.col("message_count").cast("string")),
        one("completeness", F.col("status")), *extra, T.yaml_list("warnings", F.col("all_warnings")), "---",
    )


def _table(*rows: tuple[str, Column]) -> Column:
    def row(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"| {name} | "), T.table_cell(F.coalesce(value.cast("string"), F.lit(""))), F.lit(" |"))

    return lines("| Field | Value |", "| --- | --- |", *[row(*r) for r in rows])


def _quoted_warnings(title: str) -> Column:
    return F.concat(F.lit(f"> **{title}**\n"), F.array_join(F.transform("all_warnings", lambda w: F.concat(F.lit("> - "), T.inline_html(w))), NL))


def _yes(c: str) -> Column:
    return F.when(F.col(c), "yes").otherwise("no")


def with_facts(conversations: DataFrame, reports: DataFrame) -> DataFrame:
    """Conversations joined with their report, and both warning lists in one."""
    return conversations.join(reports, "conv_id").withColumn("all_warnings", F.concat("warnings", "platform_warnings"))


def markdown(conversations: DataFrame, messages: DataFrame, reports: DataFrame, profile: str = "default", metadata: bool = True) -> DataFrame:
    """conv_id, text: one Markdown document per conversation that has messages."""
    number = (F.col("idx") + 1).cast("string")
    label = T.single_line(F.col("author_label"))
    head = {
        "obsidian": F.concat(F.lit("## "), T.heading(F.col("author_label")), F.lit(" "), number),
        "gitbook": F.concat(F.lit("### "), number, F.lit(". "), label),
        "research-log": F.concat(F.lit("### "), number, F.lit(". "), label, F.lit(" ("), F.col("role"), F.lit(")")),
    }.get(profile, F.concat(F.lit("## "), number, F.lit(". "), label))
    pieces = _gather(complete(messages), lines("", head, "", message_markdown(profile != "default")))
    title = F.coalesce("title", F.lit("Untitled conversation"))
    title = F.concat(F.lit("# "), T.heading(title) if profile == "obsidian" else T.single_line(title))
    some = F.size("all_warnings") > 0
    listed = F.array_join(F.transform("all_warnings", lambda w: F.concat(F.lit("- "), w)), NL)
    source = [F.concat(F.lit(f"{n}: "), F.col(c)) for n, c in (("Source", "source_url"), ("Exported", "exported_at"), ("Completeness", "status"))]
    facts = {n: (n, F.col(c)) for n, c in (("Platform", "platform_label"), ("Source", "source_url"), ("Exported", "exported_at"), ("Completeness", "status"), ("Messages", "message_count"))}
    parts: list = [title]
    if metadata:
        parts = [_frontmatter(profile), "", title]
        if profile in ("default", "obsidian"):
            parts += ["", *source]
            parts += [F.when(some, F.concat(F.lit("\nWarnings:\n"), listed))] if profile == "default" else []
        elif profile == "github":
            parts += ["", _table(*[facts[n] for n in ("Platform", "Source", "Exported", "Completeness")]), F.when(some, F.concat(F.lit(NL), _quoted_warnings("Warnings")))]
        elif profile == "gitbook":
            parts += ["", "## Summary", "", _table(*[facts[n] for n in ("Platform", "Source", "Exported", "Messages", "Completeness")]), F.when(some, F.concat(F.lit("\n## Warnings\n\n"), listed))]
        else:
            parts += [F.when(some, F.concat(F.lit("\n## Warnings\n\n"), _quoted_warnings("Review before relying on this export")))]
            parts += ["", "## Export Metadata", "", _table(facts["Platform"], ("Source URL", F.col("source_url")), ("Conversation ID", F.col("conversation_id")), ("Exported At", F.col("exported_at")), ("Message Count", F.col("message_count")))]
            parts += ["", "## Completeness Report", "", _table(
                ("Status", F.col("status")), ("Reached Top", _yes("reached_top")), ("Reached Bottom", _yes("reached_bottom")), ("Scroll Steps", F.col("scroll_steps")),
                ("Duplicates Skipped", F.col("duplicate_count")), ("First Message", F.col("first_message_preview")), ("Last Message", F.col("last_message_preview")))]
    parts += {"gitbook": ["", "## Conversation"], "research-log": ["", "## Messages"]}.get(profile, [])
    between = "\n\n---\n" if profile in ("default", "github") else NL
    whole = lines(*parts, F.array_join("pieces", between))
    done = F.concat(F.regexp_replace(whole, rf"[{T.WS}]+\z", ""), F.lit(NL))
    return with_facts(conversations, reports).join(pieces, "conv_id").select("conv_id", done.alias("text"))


def plain_text(conversations: DataFrame, messages: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, text: a header, then the messages between lines of ``=``."""
    head = F.concat((F.col("idx") + 1).cast("string"), F.lit(". "), T.single_line(F.col("author_label")), F.lit(" ("), F.col("role"), F.lit(")"))
    label = lambda x: F.coalesce(F.concat(F.lit("Code block ("), x["language"], F.lit("):")), F.lit("Code block:"))
    code = _some(F.array_join(F.transform("code_blocks", lambda x: F.concat(F.lit(NL), label(x), F.lit(NL), code_text(x))), NL))
    piece = lines(
        "", SEPARATOR, head, F.concat(F.lit("Model: "), F.col("model")), F.concat(F.lit("Created: "), F.col("created_at")), "", T.trim(T.line_feeds(F.col("text"))), code, *advanced_text()
    )
    pieces = _gather(complete(messages), piece)
    listed = F.array_join(F.transform("all_warnings", lambda w: F.concat(F.lit("- "), w)), NL)
    named = (("Platform", F.col("platform_label")), ("Source", F.col("source_url")), ("Exported", F.col("exported_at")), ("Messages", F.col("message_count").cast("string")), ("Completeness", F.col("status")))
    whole = lines(
        F.concat(F.lit("Title: "), T.single_line(F.coalesce("title", F.lit("Untitled conversation")))),
        *[F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit(""))) for n, c in named],
        F.when(F.size("all_warnings") > 0, F.concat(F.lit("Warnings:\n"), listed)),
        F.array_join("pieces", NL),
    )
    done = F.concat(F.regexp_replace(whole, rf"[{T.WS}]+\z", ""), F.lit(NL))
    return with_facts(conversations, reports).join(pieces, "conv_id").select("conv_id", done.alias("text"))


def csv_rows(messages: DataFrame) -> DataFrame:
    """conv_id, idx, line: one CSV line per message."""
    df = complete(messages)
    cells = [(F.col("idx") + 1).cast("string"), *[F.col(c) for c in ("role", "author_label", "text", "model", "created_at", "id")]]
    return df.select("conv_id", "idx", F.concat_ws(",", *[T.csv_field(c) for c in cells]).alias("line"))


def csv(messages: DataFrame) -> DataFrame:
    """conv_id, text: header and lines."""
    pieces = _gather(csv_rows(messages), F.col("line"))
    return pieces.select("conv_id", F.concat(F.lit(",".join(CSV_COLUMNS) + NL), F.array_join("pieces", NL), F.lit(NL)).alias("text"))


def json_documents(conversations: DataFrame, messages: DataFrame, reports: DataFrame, pretty: bool = True) -> DataFrame:
    """conv_id, text: the whole conversation as JSON; missing values are left out, raw HTML too."""
    m = complete(messages)
    name = {"author_label": "authorLabel", "code_blocks": "codeBlocks", "thinking_blocks": "thinkingBlocks", "created_at": "createdAt"}
    order = ("id", "idx", "role", "author_label", "participant", "text", "markdown", "code_blocks", "images", "sources", "thinking_blocks", "canvas", "created_at", "model", "metadata")
    row = F.struct("idx", F.struct(*[F.col(c).alias({"idx": "index"}.get(c, name.get(c, c))) for c in order]).alias("piece"))
    by_position = lambda a, b: F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0)
    gathered = m.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.collect_list("row").alias("rows"))
    pieces = gathered.select("conv_id", F.transform(F.array_sort("rows", by_position), lambda r: r["piece"]).alias("messages"))
    kept = ("status", "warnings", "message_count", "first_message_preview", "last_message_preview", "reached_top", "reached_bottom", "scroll_steps", "duplicate_count", "platform_warnings")
    camel = lambda c: c.split("_")[0] + "".join(w.title() for w in c.split("_")[1:])
    report = F.struct(*[F.col(c).alias(camel(c)) for c in kept])
    top = [F.lit("1.0").alias("schemaVersion"), *[F.col(c).alias(camel(c)) for c in ("platform", "platform_label", "source_url", "title", "conversation_id", "exported_at", "message_count")]]
    text = F.to_json(F.struct(*top, report.alias("completeness"), "messages"), {"pretty": str(pretty).lower()})
    return conversations.join(reports, "conv_id").join(pieces, "conv_id").select("conv_id", F.concat(text, F.lit(NL)).alias("text"))


def html_body(markdown_text: Column) -> Column:
    """A small Markdown to HTML: fenced code, tables, http links and paragraphs; everything else is escaped text."""

    def paragraph(block: Column) -> Column:
        linked = F.regexp_replace(T.html_escape(block), r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)", '<a href="$2" rel="noreferrer">$1</a>')
        return F.when(T.trim(block) == "", "").otherwise(F.concat(F.lit("<p>"), F.replace(linked, F.lit(NL), F.lit("<br>\n")), F.lit("</p>")))

    fenced = r"(?m)^(`{3,})[^\n`]*\n(?s:.*?)\n?^\1[ \t]*$"
    outside = F.split(markdown_text, fenced, -1)
    blocks = F.regexp_extract_all(markdown_text, F.lit(fenced), F.lit(0))

    def paragraphs(text: Column) -> Column:
        return F.array_join(F.filter(F.transform(F.split(T.trim(text), r"\n{2,}"), paragraph), lambda p: p != ""), NL)

    def table(rows: Column) -> Column:
        line = lambda row, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(F.lit(f"<{tag}>"), T.html_escape(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
        rest = F.array_join(F.transform(F.slice(rows, 2, F.size(rows)), lambda row: line(row, "td")), NL)
        return F.concat(F.lit("<table>\n<thead>"), line(F.get(rows, F.lit(0)), "th"), F.lit("</thead>\n<tbody>"), rest, F.lit("</tbody>\n</table>"))

    def prose(text: Column) -> Column:
        mixed = F.zip_with(F.split(text, T.TABLE, -1), T.tables(text), lambda p, t: F.concat_ws(NL, _some(paragraphs(p)), F.when(t.isNotNull(), table(t))))
        return F.when(F.instr(text, "|") > 0, F.array_join(F.filter(mixed, lambda p: p != ""), NL)).otherwise(paragraphs(text))

    def code(block: Column) -> Column:
        language = F.regexp_replace(F.regexp_extract(block, r"\A`{3,}([^\n`]*)", 1), "[^A-Za-z0-9_-]", "")
        inner = F.regexp_replace(F.regexp_replace(block, r"\A[^\n]*\n", ""), r"\n?[^\n]*\z", "")
        attribute = F.when(language != "", F.concat(F.lit(' class="language-'), language, F.lit('"'))).otherwise("")
        return F.concat(F.lit("<pre><code"), attribute, F.lit(">"), T.html_escape(inner), F.lit("</code></pre>"))

    pieces = F.zip_with(outside, blocks, lambda p, b: F.concat_ws(NL, _some(prose(p)), F.when(b.isNotNull(), code(b))))
    return F.array_join(F.filter(pieces, lambda p: p != ""), NL)


def html(conversations: DataFrame, messages: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, text: a page that needs nothing else."""
    head = F.concat(F.lit("<h2>"), (F.col("idx") + 1).cast("string"), F.lit(". "), T.html_escape(T.single_line(F.col("author_label"))), F.lit("</h2>"))
    piece = F.concat(F.lit('<article class="message '), F.col("role"), F.lit('">\n'), head, F.lit(NL), html_body(F.col("body")), F.coalesce(F.concat(F.lit(NL), _some(advanced_html())), F.lit("")), F.lit("\n</article>"))
    pieces = _gather(complete(messages).withColumn("body", message_markdown(False, advanced=False)), piece)
    title = T.html_escape(T.single_line(F.coalesce("title", F.lit("Untitled conversation"))))
    facts = (("Platform", "platform_label"), ("Source", "source_url"), ("Exported", "exported_at"), ("Messages", "message_count"), ("Completeness", "status"))
    rows = [F.concat(F.lit(f"<dt>{n}</dt><dd>"), T.html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</dd>")) for n, c in facts]
    warned = F.array_join(F.transform("all_warnings", lambda w: F.concat(F.lit("<li>"), T.html_escape(w), F.lit("</li>"))), NL)
    whole = lines(
        "<!doctype html>", '<html lang="en">', '<head><meta charset="utf-8">', F.concat(F.lit("<title>"), title, F.lit("</title>")), "</head>", "<body>",
        F.concat(F.lit("<h1>"), title, F.lit("</h1>")), "<dl>", *rows, "</dl>",
        F.when(F.size("all_warnings") > 0, F.concat(F.lit("<ul>\n"), warned, F.lit("\n</ul>"))), F.array_join("pieces", NL), "</body>", "</html>", "",
    )
    return with_facts(conversations, reports).join(pieces, "conv_id").select("conv_id", whole.alias("text"))


def _paragraph(c: Column, style: str | None = None) -> Column:
    """A paragraph of a word-processor document; line feeds are breaks, control characters go."""
    kept = T.xml_escape(F.regexp_replace(T.line_feeds(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""))
    line = lambda x: F.concat(F.lit('<w:t xml:space="preserve">'), x, F.lit("</w:t>"))
    runs = F.array_join(F.transform(F.split(kept, NL, -1), line), "<w:br/>")
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return F.concat(F.lit(f"<w:p>{head}<w:r>"), runs, F.lit("</w:r></w:p>"))


_BORDERS = "".join(f'<w:{x} w:val="single" w:sz="4"/>' for x in ("top", "left", "bottom", "right", "insideH", "insideV"))


def _word_table(rows: Column) -> Column:
    cell = lambda c: F.concat(F.lit('<w:tc><w:tcPr><w:tcW w:w="2400" w:type="dxa"/></w:tcPr>'), _paragraph(c), F.lit("</w:tc>"))
    row = lambda r: F.concat(F.lit("<w:tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</w:tr>"))
    return F.concat(F.lit(f"<w:tbl><w:tblPr><w:tblBorders>{_BORDERS}</w:tblBorders></w:tblPr>"), F.array_join(F.transform(rows, row), ""), F.lit("</w:tbl>"))


def _joined(items: Column, how) -> Column:
    return F.coalesce(F.array_join(F.transform(items, how), ""), F.lit(""))


def word_body(conversations: DataFrame, messages: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, title, exported_at, xml: the body of a word-processor document per conversation.

    Each message has a heading, its role and model, its tables, its paragraphs, its code blocks, its images and its extra
    sections, in this order.
    """
    role = F.concat(F.lit("Role: "), F.col("role"), F.coalesce(F.concat(F.lit(" | Model: "), _some(F.col("model"))), F.lit("")))
    label = lambda x: F.coalesce(F.concat(F.lit("Code ("), _some(x["language"]), F.lit(")")), F.lit("Code"))
    source = lambda x: F.coalesce(x["src"], x["localFilename"])
    named = lambda x: F.coalesce(T.blank_to_null(x["alt"]), F.lit("Image"))
    image = lambda x: F.coalesce(F.concat(F.lit("Image: "), named(x), F.lit(" - "), source(x), dimensions(x["width"], x["height"])), image_text(x))
    extra = F.filter(F.split(F.concat_ws(NL, *advanced_text()), NL, -1), lambda x: x != "")
    piece = F.concat(
        _paragraph(F.concat((F.col("idx") + 1).cast("string"), F.lit(". "), F.col("author_label")), "Heading1"), _paragraph(role),
        _joined(T.tables(T.line_feeds(F.col("markdown"))), _word_table),
        _joined(F.when(F.col("markdown").isNotNull(), T.paragraphs(F.col("markdown"))).otherwise(F.filter(F.transform(F.split(T.line_feeds(F.col("text")), r"\n{2,}", -1), T.trim), lambda p: p != "")), lambda x: _paragraph(x)),
        _joined(F.col("code_blocks"), lambda x: F.concat(_paragraph(label(x), "Heading2"), _paragraph(code_text(x), "CodeBlock"))),
        F.when(F.size("images") > 0, F.concat(_paragraph(F.lit("Images"), "Heading2"), _joined(F.col("images"), lambda x: _paragraph(image(x))))).otherwise(""),
        _joined(extra, lambda x: _paragraph(x)),
    )
    pieces = _gather(complete(messages), piece)
    title = F.coalesce("title", F.lit("Untitled conversation"))
    facts = (("Platform", "platform_label"), ("Source", "source_url"), ("Exported", "exported_at"), ("Messages", "message_count"), ("Completeness", "status"))
    warned = F.concat(_paragraph(F.lit("Warnings"), "Heading2"), _joined(F.col("all_warnings"), lambda x: _paragraph(x)))
    xml = F.concat(
        _paragraph(title, "Title"), *[_paragraph(F.concat(F.lit(f"{n}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))) for n, c in facts],
        F.when(F.size("all_warnings") > 0, warned).otherwise(""), F.array_join("pieces", ""),
    )
    return with_facts(conversations, reports).join(pieces, "conv_id").select("conv_id", title.alias("title"), "exported_at", xml.alias("xml"))


def contents(messages: DataFrame) -> DataFrame:
    """conv_id, toc: a table of contents, one line per message."""
    line = F.concat(F.lit("  "), (F.col("idx") + 1).cast("string"), F.lit(". "), T.single_line(F.col("author_label")))
    return _gather(complete(messages), line).select("conv_id", F.concat(F.lit("Table of contents\n"), F.array_join("pieces", NL), F.lit("\n\n")).alias("toc"))
