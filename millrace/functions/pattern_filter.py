"""Thousands of redaction patterns: a text meets only the patterns whose required literal it holds.

A literal that every match of a pattern must contain is drawn from the pattern. One pass over a text finds which of all
literals it holds (an automaton over all of them); only these patterns, and those without a literal, are then run, in
their order, so the result is that of the whole chain. The mask put in by an earlier pattern may hold a later one's
literal: such patterns run on every text that any pattern meets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .redaction import SECRET, compiles

_QUANTIFIER = re.compile(r"(?:[?*+]|\{(\d+)(?:,\d*)?\})[?+]?")
_SPECIAL = set(".^$|?*+()[]{}\\")


def literal_of(pattern: str) -> str | None:
    """The longest run of characters that any match must hold, as far as a plain reading tells; else None.

    Classes, groups, escapes of more than one sign and look-arounds end a run; what an alternative or a flag may undo
    counts for nothing.
    """
    if re.search(r"\(\?[a-zA-Z-]|\\[QE]", pattern):  # flags, or a quotation
        return None
    runs, run, at = [""], "", 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "|":
            return None
        if sign in "([":
            end = _closing(pattern, at)
            if end is None:
                return None
            runs.append(run)
            run, at = "", end
            found = _QUANTIFIER.match(pattern, at)
            at = found.end() if found else at
            continue
        char, step = sign, 1
        if sign == "\\":
            after = pattern[at + 1 : at + 2]
            if not after or after.isalnum():
                if after and after in "xucpPkN0123456789":  # more signs belong to it, or it refers to a group
                    return None
                char, step = None, 2
            else:
                char, step = after, 2
        elif sign in _SPECIAL:
            char = None
        at += step
        found = _QUANTIFIER.match(pattern, at) if sign not in "^$" or char else None
        if char is None or found:
            least = int(found[1]) if found and found[1] else 1 if not found or found[0][0] == "+" else 0
            runs.append(run + (char if char and least else ""))
            run = ""
            at = found.end() if found else at
        else:
            run += char
    longest = max([*runs, run], key=len)
    return longest or None


def _closing(pattern: str, at: int) -> int | None:
    """The place after the group or class that opens here."""
    depth, inside = 0, 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            at += 1
        elif sign == "[":
            inside += 1
        elif sign == "]" and inside:
            inside -= 1
        elif not inside:
            depth += (sign == "(") - (sign == ")")
        at += 1
        if not depth and not inside:
            return at
    return None


def redact_many(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """``df`` with every match of the patterns, one after the other, replaced in ``column``; null stays null.

    Patterns are in Java's dialect; those it cannot compile are left out. Their text is sent to the tasks: some MB at most.
    """
    valid = [p for p in patterns if compiles(p)]
    literals: dict[str, list[int]] = {}
    always = []
    for k, pattern in enumerate(valid):
        literal = literal_of(pattern)
        if literal is None:
            always.append(k)
        else:
            literals.setdefault(literal, []).append(k)
    masked = [k for literal, of in literals.items() if literal in SECRET for k in of]
    masked += [k for literal, of in literals.items() if literal not in SECRET and _touches(literal) for k in of]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(literals)
        for batch in batches:
            found = []
            for text in batch.column(column).to_pylist():
                held = {k for _, of in automaton.iter(text) for k in of} if text and literals else set()
                meets = sorted({*held, *always, *masked} if held or always else held) if text else []
                found.append([valid[k] for k in meets])
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "_patterns"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "_patterns array<string>"])
    met = df.mapInArrow(run, schema)
    cleaned = F.aggregate("_patterns", F.col(column), lambda text, pattern: F.regexp_replace(text, pattern, F.lit(SECRET)))
    return met.withColumn(column, F.when(F.size("_patterns") > 0, cleaned).otherwise(F.col(column))).drop("_patterns")


def _touches(literal: str) -> bool:
    """Whether a mask and what is beside it may hold the literal: it begins with the mask's end, or ends with its start."""
    return any(literal.startswith(SECRET[-n:]) or literal.endswith(SECRET[:n]) or SECRET in literal for n in range(1, min(len(literal), len(SECRET)) + 1))


def _automaton(literals: dict[str, list[int]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for literal, of in literals.items():
        out.add_word(literal, of)
    out.make_automaton()
    return out
