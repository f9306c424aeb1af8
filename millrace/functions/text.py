"""Text cleaning, previews, hashes and escapes as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser trims it, inside a character class; the regex class ``\s`` alone misses most of it.
WS = r"\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same without the line feed.
WS_LINE = r"\t\x0B\f\r \u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Lines that are interface labels, not text.
UI_LABELS = ("copy code", "copied", "копировать код", "скопировано", "copy", "копировать")
#: 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME, HASH_DIGITS = 2166136261, 16777619, 7
PREVIEW_CHARS = 160


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value bound once: a nested expression that is used often would multiply the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def single_line(c: Column) -> Column:
    """Runs of white space become one space, edges go."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean_text(c: Column) -> Column:
    """Lines trimmed, interface labels dropped, runs of blank lines made one, blank edges gone.

    Whole-text regular expressions in place of a split into lines keep this in generated code.
    """
    c = F.translate(line_feeds(c), "\u00a0", " ")
    c = F.regexp_replace(c, rf"(?<=\n|\A)[{WS_LINE}]+|[{WS_LINE}]+(?=\n|\z)", "")
    c = F.regexp_replace(c, rf"(?iu)(?<=\n|\A)(?:{'|'.join(UI_LABELS)})(?:\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def clean_code(c: Column) -> Column:
    """White space kept but for line ends and no-break spaces."""
    return F.translate(line_feeds(c), "\u00a0", " ")


def text_preview(c: Column, size: int = PREVIEW_CHARS) -> Column:
    """One line of the cleaned text, with an ellipsis where it is cut."""

    def cut(line: Column) -> Column:
        return F.when(F.length(line) <= size, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, max(0, size - 1))), F.lit("…")))

    return let(single_line(clean_text(c)), cut)


def short_preview(c: Column, size: int = PREVIEW_CHARS) -> Column:
    """One line, cut hard."""
    return F.substring(single_line(c), 1, size)


def stable_hash(c: Column) -> Column:
    """``h`` and seven base-36 digits: 32-bit FNV-1a over UTF-16 units (astral characters count as two)."""

    def step(acc: Column, unit: Column) -> Column:
        return acc.bitwiseXOR(unit) * F.lit(FNV_PRIME).cast("long") % F.lit(1 << 32)

    def add(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("long")
        high, low = F.lit(0xD7C0) + F.shiftright(code, 10), F.lit(0xDC00) + code.bitwiseAND(F.lit(1023))
        return F.when(code < 65536, step(acc, code)).otherwise(step(step(acc, high), low))

    code = F.aggregate(F.split(c, ""), F.lit(FNV_BASIS).cast("long"), lambda acc, ch: F.when(ch == "", acc).otherwise(add(acc, ch)))
    return F.concat(F.lit("h"), F.lpad(F.lower(F.conv(code.cast("string"), 10, 36)), HASH_DIGITS, "0"))


def fingerprint(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(":"), stable_hash(text))


def replace_each(text: Column, pattern: str, how: Callable[[Column], Column]) -> Column:
    """Every match replaced by ``how(match)``, which a plain regular-expression replacement cannot express."""

    def pieces(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        joined = F.zip_with(F.split(t, pattern, -1), found, lambda piece, match: F.concat(piece, F.when(match.isNull(), F.lit("")).otherwise(how(match))))
        return F.when(t.rlike(pattern), F.array_join(joined, "")).otherwise(t)

    return let(text, pieces)


def csv_field(c: Column) -> Column:
    c = line_feeds(F.coalesce(c, F.lit("")))
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def yaml_string(c: Column) -> Column:
    c = line_feeds(_replace_all(c, (("\\", "\\\\"), ('"', '\\"'))))
    return F.concat(F.lit('"'), F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def yaml_list(key: str, values: Column) -> Column:
    lines = F.array_join(F.transform(values, lambda v: F.concat(F.lit("\n  - "), yaml_string(v))), "")
    return F.when(F.size(values) == 0, F.lit(f"{key}: []")).otherwise(F.concat(F.lit(f"{key}:"), lines))


def inline_html(c: Column) -> Column:
    return _replace_all(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def html_escape(c: Column) -> Column:
    return _replace_all(inline_html(c), (('"', "&quot;"), ("'", "&#39;")))


def xml_escape(c: Column) -> Column:
    return _replace_all(inline_html(c), (('"', "&quot;"), ("'", "&apos;")))


def table_cell(c: Column) -> Column:
    return F.replace(inline_html(single_line(c)), F.lit("|"), F.lit("\\|"))


def heading(c: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_replace(single_line(c), r"[`*_#\[\]<>|]", "")), F.lit("Untitled conversation"))


def link_text(c: Column) -> Column:
    return _replace_all(c, (("\\", "\\\\"), ("[", "\\["), ("]", "\\]")))


def html_outside_fences(markdown: Column) -> Column:
    """``&<>`` escaped in every line that is not inside a fenced block."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.ltrim(line).startswith("```")
        shown = F.when(fence | acc["inside"], line).otherwise(inline_html(line))
        return F.struct((acc["inside"] != fence).alias("inside"), F.concat(acc["lines"], F.array(shown)).alias("lines"))

    def escaped(m: Column) -> Column:
        walked = F.aggregate(F.split(m, "\n", -1), start, step, lambda acc: F.array_join(acc["lines"], "\n"))
        return F.when(F.instr(m, "```") > 0, walked).otherwise(inline_html(m))

    return let(markdown, escaped)


def longest_run(c: Column, char: str = "`", least: int = 0) -> Column:
    runs = F.transform(F.regexp_extract_all(c, F.lit(f"{char}+"), F.lit(0)), F.length)
    return F.greatest(F.coalesce(F.array_max(runs), F.lit(0)), F.lit(least))


def fence(code: Column) -> Column:
    """Longer than any run of back-ticks in the code, three at least."""
    return F.repeat(F.lit("`"), longest_run(code, least=2) + 1)


def inline_code(c: Column) -> Column:
    c = single_line(c)
    return F.when(F.instr(c, "`") > 0, F.concat(F.lit("`` "), c, F.lit(" ``"))).otherwise(F.concat(F.lit("`"), c, F.lit("`")))


def strip_inline_markdown(c: Column) -> Column:
    for pattern, new in ((r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)"), (r"`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1")):
        c = F.regexp_replace(c, pattern, new)
    return c


def slugify(c: Column, default: str = "untitled-chat", size: int = 72) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, size), F.lit("")), F.lit(default))


def tag_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9/_-]+", "-"), r"\A-+|-+\z", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def two_line_preview(c: Column, size: int = 100) -> Column:
    """First two lines on one, three dots where it is cut."""
    line = single_line(F.array_join(F.slice(F.split(c, "\n", -1), 1, 2), " "))
    return F.when(F.length(line) > size, F.concat(F.rtrim(F.substring(line, 1, size)), F.lit("..."))).otherwise(line)


def count_of(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def split_tags(c: Column) -> Column:
    """Comma-separated tags: trimmed, blanks dropped, first of each kept."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), trim), lambda t: t != ""))


#: A Markdown table: a row, a divider of cells like --- or :--:, and further rows.
TABLE = r"(?m)^[ \t]*\|[^\n]*\n[ \t]*\|[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$(?:\n[ \t]*\|[^\n]*)*"


def tables(markdown: Column) -> Column:
    """The tables of a text as arrays of rows of cells, without their dividers."""

    def cells(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(trim(line), r"\A\|", ""), r"\|\z", "")
        return F.transform(F.split(bare, r"\|", -1), trim)

    found = F.regexp_extract_all(markdown, F.lit(TABLE), F.lit(0))
    return F.transform(found, lambda block: F.transform(F.filter(F.split(block, "\n", -1), lambda x, i: i != 1), cells))


def paragraphs(markdown: Column) -> Column:
    """Paragraphs of a text without fenced code and tables, inline marks removed."""
    bare = F.regexp_replace(line_feeds(markdown), r"(?m)^```[^\n]*(?:\n(?!```)[^\n]*)*(?:\n```[^\n]*)?", "\n\n")
    bare = F.regexp_replace(bare, TABLE, "\n\n")
    return F.filter(F.transform(F.split(strip_inline_markdown(bare), r"\n[ \t]*\n\s*", -1), trim), lambda p: p != "")
