"""File names from templates; the template is parsed once, while the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, trim

DEFAULT_TEMPLATE = "{datetime}_{platform}_{title}.{format}"
TOKENS = ("conversationId", "date", "datetime", "format", "platform", "time", "title")
UNTITLED = "untitled-conversation"
_TOKEN = re.compile(r"\{([A-Za-z][A-Za-z0-9]*)\}")
_RESERVED = r'[\x00-\x1F<>:"/\\|?*]'


def sanitize_part(c: Column) -> Column:
    c = F.regexp_replace(trim(F.coalesce(c, F.lit(""))), _RESERVED, "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"[{WS}]+", "-"), "-+", "-"), r"\A[.-]+|[.-]+\z", "")


def sanitize_name(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(trim(c), _RESERVED, "-"), r"\.\.+", "-")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"[{WS}]+", "-"), "-+", "-"), r"\A[.-]+|[.-]+\z", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(f"{UNTITLED}.md"))


def export_time(exported_at: Column) -> Column:
    """The time of an ISO string; the epoch where it is none. The session's time zone is to be UTC."""
    return F.coalesce(F.try_to_timestamp(exported_at), F.to_timestamp(F.lit("1970-01-01 00:00:00")))


def template_segments(template: str) -> list[tuple[str, str]]:
    """``("text", ...)`` and ``("token", ...)`` pieces; unknown tokens stay text."""
    out, at = [], 0
    for m in _TOKEN.finditer(template):
        if m[1] in TOKENS:
            out += [("text", template[at : m.start()])] * (m.start() > at) + [("token", m[1])]
            at = m.end()
    return out + [("text", template[at:])] * (at < len(template))


def render_segments(segments: list[tuple[str, str]]) -> str:
    return "".join(f"{{{s}}}" if kind == "token" else s for kind, s in segments)


def move_segment(segments: list[tuple[str, str]], at: int, to: int) -> list[tuple[str, str]]:
    """A copy with one segment moved; positions outside leave it as it is."""
    out = list(segments)
    if 0 <= at < len(out) and 0 <= to < len(out):
        out.insert(to, out.pop(at))
    return out


def filename(template: str | None, exported_at: Column, platform: Column, title: Column, conversation_id: Column, fmt: Column) -> Column:
    """The rendered, sanitised name. Values are inserted once: braces inside a title are not read as tokens."""
    when = export_time(exported_at)
    values = {
        "conversationId": sanitize_part(conversation_id),
        "date": F.date_format(when, "yyyy-MM-dd"),
        "datetime": F.date_format(when, "yyyy-MM-dd'T'HH-mm-ss'Z'"),
        "time": F.date_format(when, "HH-mm-ss"),
        "format": sanitize_part(fmt),
        "platform": sanitize_part(platform),
        "title": F.coalesce(F.nullif(sanitize_part(title), F.lit("")), F.lit(UNTITLED)),
    }
    template = (template or "").strip() or DEFAULT_TEMPLATE
    return sanitize_name(F.concat(*[values[s] if kind == "token" else F.lit(s) for kind, s in template_segments(template)]))
