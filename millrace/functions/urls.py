"""Addresses: hosts, conversation ids, safe links and the platforms that hosts belong to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host of an address, lower-cased; null where it does not parse."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_safe_link(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)\A(?:https?:[/\\]*[^/\\?#\s]|mailto:)"), F.lit(False))


def conversation_id(url: Column) -> Column:
    """The path segment after the first segment ``c``; null where there is none."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    at = F.array_position(parts, "c").cast("int")
    return F.when(at > 0, F.try_element_at(parts, at + 1))


@dataclass(frozen=True)
class Platform:
    """One row per platform: hosts, label, how sure its scans are, and where messages stand in its pages."""

    name: str
    label: str
    hosts: tuple[str, ...]
    support: str
    #: (role, author, selectors): the first that fits names role and author.
    messages: tuple[tuple[str, str, str], ...]
    content: str | None = None


#: The platforms in the order in which they are tried.
PLATFORMS = (
    Platform("chatgpt", "ChatGPT", ("chatgpt.com", "chat.openai.com"), "stable", (("", "", "[data-message-author-role]"),)),
    Platform(
        "claude", "Claude", ("claude.ai",), "beta",
        (("user", "User", "[data-testid='user-message']"), ("assistant", "Claude", "[data-testid='assistant-message']"),
         ("user", "User", "[data-local-export-platform='claude'][data-local-export-role='user']"),
         ("assistant", "Claude", "[data-local-export-platform='claude'][data-local-export-role='assistant']")),
        ".font-claude-message, [data-message-content], .prose",
    ),
    Platform(
        "gemini", "Gemini", ("gemini.google.com",), "beta",
        (("user", "User", "[data-testid='user-query'], [data-test-id='user-query'], user-query"),
         ("assistant", "Gemini", "[data-testid='model-response'], [data-test-id='model-response'], [data-testid='response'], [data-test-id='response'], model-response")),
        "[data-message-content], .markdown, .query-text, message-content",
    ),
    Platform(
        "perplexity", "Perplexity", ("www.perplexity.ai", "perplexity.ai"), "experimental",
        (("user", "User", "[data-testid='query-text'], [data-test-id='query-text'], [data-testid='query-content'], [data-testid='thread-question'], [aria-label='Search query'] h1, main header h1, main section h1"),
         ("assistant", "Perplexity", "[data-testid='answer'], [data-test-id='answer'], [data-testid='answer-content'], [data-testid='thread-answer'], main .prose")),
        "article, [data-message-content], [data-testid='query-content'], [data-testid='answer-content'], .prose",
    ),
    Platform(
        "notebooklm", "NotebookLM", ("notebooklm.google.com",), "experimental",
        (("user", "User", "[data-testid='user-query'], [data-test-id='user-query']"), ("assistant", "NotebookLM", "[data-testid='chat-message-answer'], [data-test-id='chat-message-answer']")),
        "[data-message-content], .markdown, .prose",
    ),
)


def platform_hosts(spark: SparkSession, platforms: tuple[Platform, ...] = PLATFORMS) -> DataFrame:
    """host, platform, platform_label, origin: one row per known host."""
    rows = [(h, p.name, p.label, f"https://{h}/*") for p in platforms for h in p.hosts]
    return spark.createDataFrame(rows, "host string, platform string, platform_label string, origin string")
