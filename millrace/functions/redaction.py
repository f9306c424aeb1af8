"""Redaction of e-mail addresses, phone numbers and secrets; presets are resolved while the plan is built."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, let, replace_each

EMAIL, PHONE, SECRET = "[REDACTED_EMAIL]", "[REDACTED_PHONE]", "[REDACTED_SECRET]"
PRESETS = ("off", "basic", "strict", "custom")

#: A word boundary over ASCII; the engine's own is Unicode-aware and would spare addresses after an accented letter.
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_TOKEN = r"[A-Za-z0-9._~+/=-]"
#: The shapes that count as personal data or secrets.
EMAIL_SHAPE = rf"(?i){_B}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_B}"
PHONE_SHAPE = r"(?:\A|(?<=[^A-Za-z0-9]))\+?\d[\d ().-]{7,}\d(?![A-Za-z0-9])"
BEARER_SHAPE = rf"{_B}Bearer[{WS}]+(?={_TOKEN}{{24,}}){_TOKEN}*?(\.*)(?!{_TOKEN})"
API_KEY_SHAPE = rf"{_B}(?:sk|pk|rk|api|key|token)[-_](?:proj[-_])?[A-Za-z0-9_-]{{20,}}{_B}"
LONG_SECRET_SHAPE = rf"{_B}(?:[A-Fa-f0-9]{{32,}}|[A-Za-z0-9+/=_-]{{40,}}){_B}"


@dataclass(frozen=True)
class Redaction:
    """Which rules apply. ``of`` builds one from loose settings."""

    emails: bool = False
    phones: bool = False
    secrets: bool = False
    custom: tuple[str, ...] = ()

    @classmethod
    def of(cls, preset: str | None = None, patterns: Iterable[str] | None = None) -> Redaction:
        """An unknown preset counts as off; the custom one has no rules for secrets but the caller's."""
        on = preset in PRESETS and preset != "off"
        custom = tuple(p.strip() for p in patterns or () if p.strip()) if preset == "custom" else ()
        return cls(on, on, preset == "strict", custom)

    @classmethod
    def legacy(cls, enabled: bool, emails: bool = True, phones: bool = True, api_keys: bool = True, bearer_tokens: bool = True) -> Redaction:
        """The older flags: the rules for secrets go only if both their flags are off."""
        return cls(enabled and emails, enabled and phones, enabled and (api_keys or bearer_tokens))

    @property
    def off(self) -> bool:
        return not (self.emails or self.phones or self.secrets or self.custom)


OFF = Redaction()


def _where(c: Column, sign: Callable[[Column], Column], how: Callable[[Column], Column]) -> Column:
    """``how(c)`` only where a cheap sign says that it may find something; most texts hold nothing to hide."""
    return let(c, lambda x: F.when(sign(x), how(x)).otherwise(x))


def _has(part: str) -> Callable[[Column], Column]:
    return lambda x: F.contains(x, F.lit(part))


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def redact_emails(c: Column) -> Column:
    return _where(c, _has("@"), lambda x: F.regexp_replace(x, EMAIL_SHAPE, EMAIL))


def redact_phones(c: Column) -> Column:
    """8 to 15 digits with separators; ISO dates stay."""

    def judged(found: Column) -> Column:
        digits = F.length(F.regexp_replace(found, r"\D", ""))
        return F.when(digits.between(8, 15) & ~found.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.lit(PHONE)).otherwise(found)

    return _where(c, _like(r"\d[\d ().-]{7}"), lambda x: replace_each(x, PHONE_SHAPE, judged))


def redact_secrets(c: Column) -> Column:
    c = _where(c, _has("Bearer"), lambda x: F.regexp_replace(x, BEARER_SHAPE, rf"Bearer {SECRET}$1"))
    c = _where(c, _like("(?:sk|pk|rk|api|key|token)[-_]"), lambda x: F.regexp_replace(x, API_KEY_SHAPE, SECRET))
    return _where(c, _like("[A-Za-z0-9+/=_-]{32}"), lambda x: F.regexp_replace(x, LONG_SECRET_SHAPE, SECRET))


def compiles(pattern: str) -> bool:
    """Whether the pattern is one of Java's dialect: asked once on the driver."""
    java = SparkContext._active_spark_context._jvm.java.util.regex.Pattern
    try:
        java.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def redact(c: Column, rules: Redaction) -> Column:
    """Null stays null. Custom patterns that Java, which runs them, cannot compile are left out."""
    if rules.emails:
        c = redact_emails(c)
    if rules.phones:
        c = redact_phones(c)
    if rules.secrets:
        c = redact_secrets(c)
    for pattern in rules.custom:
        if not compiles(pattern):
            continue
        c = F.regexp_replace(c, pattern, SECRET)
    return c
