"""Preparation of conversations for output: scope, redaction, omission of images, optional parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.images import omit_payloads, strip_payload
from ..functions.redaction import Redaction, redact
from ..plans.options import ExportOptions
from .completeness import rescope
from .schema import MESSAGE, complete
from .selection import filter_scope


def _fields(x: Column, rules: Redaction, plain=(), rich=()) -> Column:
    for name in plain:
        x = x.withField(name, redact(x[name], rules))
    for name in rich:
        x = x.withField(name, omit_payloads(redact(x[name], rules)))
    return x


def _image(x: Column, rules: Redaction) -> Column:
    for name in ("alt", "src", "localFilename"):
        x = x.withField(name, redact(x[name], rules))
    for name in ("hash", "mimeType", "omittedReason"):  # recomputed, or gone
        x = x.withField(name, F.lit(None).cast("string"))
    return strip_payload(x)


def prepare_messages(messages: DataFrame, options: ExportOptions) -> DataFrame:
    """Messages in scope with every text redacted and freed of image data; parts not asked for are null.

    Values of ``metadata`` are not redacted.
    """
    rules = options.redaction
    df = filter_scope(complete(messages), options.scope, options.start, options.end)

    def when(on: bool, column: Column, name: str) -> Column:
        return column if on else F.lit(None).cast(MESSAGE[name])

    columns = {n: redact(F.col(n), rules) for n in ("id", "author_label")}
    columns |= {n: omit_payloads(redact(F.col(n), rules)) for n in ("text", "markdown", "html")}
    columns |= {n: when(options.include_metadata, redact(F.col(n), rules), n) for n in ("participant", "created_at", "model")}
    columns |= {
        "code_blocks": F.transform("code_blocks", lambda x: _fields(x, rules, ("language",), ("code",))),
        "images": F.transform("images", lambda x: _image(x, rules)),
        "sources": when(options.include_advanced, F.transform("sources", lambda x: _fields(x, rules, ("id", "title", "url", "snippet"))), "sources"),
        "canvas": when(options.include_advanced, F.transform("canvas", lambda x: _fields(x, rules, ("title", "url", "warning"), ("text",))), "canvas"),
        "thinking_blocks": when(options.include_reasoning, F.transform("thinking_blocks", lambda x: _fields(x, rules, ("title",), ("text",))), "thinking_blocks"),
        "metadata": F.col("metadata") if options.include_metadata else F.expr("cast(map() as map<string,string>)"),
    }
    return df.withColumns(columns)


def prepare_reports(messages: DataFrame, reports: DataFrame, options: ExportOptions) -> DataFrame:
    """Completeness over the prepared ``messages``; a blank one where it is not asked for."""
    df = rescope(messages, reports)
    if options.include_completeness:
        shown = {n: redact(F.col(n), options.redaction) for n in ("first_message_preview", "last_message_preview")}
        shown |= {n: F.transform(n, lambda w: redact(w, options.redaction)) for n in ("warnings", "platform_warnings")}
        return df.withColumns(shown)
    none = F.expr("cast(array() as array<string>)")
    blank = {"status": F.lit("unknown"), "warnings": none, "platform_warnings": none, "reached_top": F.lit(False), "reached_bottom": F.lit(False), "scroll_steps": F.lit(0), "duplicate_count": F.lit(0).cast("long")}
    return df.withColumns(blank | {n: F.lit(None).cast("string") for n in ("first_message_preview", "last_message_preview")})


def prepare_conversations(conversations: DataFrame, options: ExportOptions) -> DataFrame:
    """conv_id, platform, platform_label, source_url, title, conversation_id, exported_at."""
    rules, shown = options.redaction, options.include_metadata
    none = F.lit(None).cast("string")
    return conversations.withColumns(
        {
            "platform_label": omit_payloads(redact(F.col("platform_label"), rules)),
            "source_url": omit_payloads(redact(F.col("source_url"), rules)) if shown else F.lit(""),
            "title": omit_payloads(redact(F.col("title"), rules)) if shown else none,
            "conversation_id": omit_payloads(redact(F.col("conversation_id"), rules)) if shown else none,
        }
    )
