"""Incremental capture: windows of a growing page arrive as a stream, each message is let through once.

The windows of one conversation in one micro-batch are sorted in memory; the source's limits per trigger bound them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import clean_text, fingerprint
from ..operators.completeness import judged
from ..operators.normalize import role_of
from ..operators.scan import MAX_STALLS, MAX_STEPS, STALLED, STEP_LIMIT

OUTPUT = "conv_id long, step long, idx long, id string, role string, text string, duplicate boolean"


class _Seen:
    """Keys let through: those of the state store, each looked up once, and those of the windows at hand until ``save``."""

    def __init__(self, store, stored: bool = True):
        self.store, self.stored, self.known, self.new = store, stored, {}, []

    def __contains__(self, key: str) -> bool:
        if key not in self.known:
            self.known[key] = self.stored and self.store.containsKey((key,))
        return self.known[key]

    def add(self, key: str) -> None:
        self.known[key] = True
        self.new.append(key)

    def save(self) -> None:
        for key in self.new:
            self.store.updateValue((key,), (True,))


def _again(ident: str | None, mark: str, ids: _Seen, marks: _Seen) -> bool:
    """Whether a row repeats one let through; one that does not is let through."""
    if ident is not None and ident in ids or mark in marks:
        return True
    if ident is not None:
        ids.add(ident)
    marks.add(mark)
    return False


def _given(value) -> bool:
    """Neither None nor what pandas has in its place."""
    return value is not None and value == value


def _in_order(frames: list[pd.DataFrame], names: tuple[str, ...]) -> list[tuple]:
    """The rows of one key (step, idx and ``names``) by step and idx, rows without an idx last; plain values."""
    rows = [r for f in frames for r in zip(*(f[c].tolist() for c in ("step", "idx", *names)), strict=True)]
    return sorted(rows, key=lambda r: (r[0], not _given(r[1]), r[1] if _given(r[1]) else 0))


class FirstSight(StatefulProcessor):
    """Per conversation, the ids and the fingerprints of messages let through; both live in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids, self.marks = (handle.getMapState(name, "key string", "seen boolean") for name in ("ids", "marks"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["step", "idx"], kind="stable")
        ids, marks = _Seen(self.ids), _Seen(self.marks)
        again = [_again(i if isinstance(i, str) else None, m, ids, marks) for i, m in zip(part["id"].tolist(), part["fp"].tolist(), strict=True)]
        ids.save()
        marks.save()
        yield part.assign(duplicate=again)[["conv_id", "step", "idx", "id", "role", "text", "duplicate"]]

    def close(self) -> None:
        pass


def first_sight(windows: DataFrame) -> DataFrame:
    """A stream of (conv_id, step, idx, id, role, text) with repeats marked; needs the RocksDB state store.

    Null or blank texts are dropped; a null id counts as none. What was seen is kept for good; ``captured`` drops it.
    """
    rows = _cleaned(windows).filter(F.length("text") > 0)
    return rows.groupBy("conv_id").transformWithStateInPandas(FirstSight(), OUTPUT, "append", "none")


def _cleaned(windows: DataFrame, *more: str) -> DataFrame:
    rows = windows.select("conv_id", F.col("step").cast("long").alias("step"), F.col("idx").cast("long").alias("idx"), "id", role_of(F.col("role")).alias("role"), clean_text(F.coalesce("text", F.lit(""))).alias("text"), *more)
    return rows.withColumn("fp", fingerprint(F.col("role"), F.col("text")))


REPORT = "ended_by string, scroll_steps long, stalls long, reached_top boolean, reached_bottom boolean, message_count long, duplicate_count long, first_text string, last_text string"


class Capture(FirstSight):
    """A capture until it ends: at the bottom, after so many steps without progress or in all, or when it falls silent.

    Then one report is given and what was seen is dropped. That the capture is over is remembered ``keep_s`` seconds
    longer, so that windows which come late do not begin another one. Time is that of the windows: timers follow the
    stream's watermark, so a replay ends captures where the first run did.
    """

    FACTS = "step long, run long, stalls long, messages long, duplicates long, top boolean, first string, last string, over boolean"

    def __init__(self, max_steps: int, max_stalls: int, quiet_s: float, keep_s: float):
        self.max_steps, self.max_stalls, self.quiet_ms, self.keep_ms = max_steps, max_stalls, int(quiet_s * 1000), int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.facts = handle.getValueState("facts", self.FACTS)

    def _wake(self, at: int, known: bool = True) -> None:
        for other in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def _ended(self, conv_id, facts: dict, ended_by: str, known: bool = True) -> list:
        """The report; what was seen of a capture that the store knew is dropped."""
        if known:
            self.ids.clear()
            self.marks.clear()
        self.facts.update((facts["step"], 0, 0, 0, 0, facts["top"], None, None, True))
        report = [ended_by, facts["step"], facts["stalls"], facts["top"], ended_by == "bottom", facts["messages"], facts["duplicates"], facts["first"], facts["last"]]
        return [conv_id, facts["step"], None, None, None, None, None, *report]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Keys go to the store once the windows at hand are done, and only if the capture goes on: most end where they began."""
        names = [f.split()[0] for f in self.FACTS.split(", ")]
        before = self.facts.get()
        known = before is not None
        facts = dict(zip(names, before if known else (-1, 0, 0, 0, 0, False, None, None, False), strict=True))
        if facts["over"]:
            return
        frames, out = list(rows), []
        now = int(max(f["at"].max() for f in frames).timestamp() * 1000)
        ids, marks = _Seen(self.ids, known), _Seen(self.marks, known)
        part = _in_order(frames, ("id", "role", "text", "fp", "moved", "at_top", "at_bottom", "closed"))
        for step, of_step in groupby(part, lambda r: r[0]):
            new, told, top, bottom, closed = 0, [], False, False, False
            for _, idx, ident, role, text, mark, moved, at_top, at_bottom, last in of_step:
                told += [moved] if _given(moved) else []
                top, bottom, closed = (a or _given(b) and bool(b) for a, b in ((top, at_top), (bottom, at_bottom), (closed, last)))
                if text == "":
                    continue
                ident = ident if isinstance(ident, str) else None
                again = _again(ident, mark, ids, marks)
                out.append([key[0], int(step), int(idx), ident, role, text, again, *[None] * 9])
                facts["duplicates"] += again
                if not again:
                    new += 1
                    facts["first"] = facts["first"] if facts["first"] is not None else text
                    facts["last"] = text
            facts["messages"] += new
            facts["top"] = bool(facts["top"] or top)
            if step <= facts["step"]:
                continue  # a window of a step that was seen: it adds its messages only
            moved = any(told) if told else new > 0
            facts["step"] = int(step)
            facts["run"] = 0 if moved else facts["run"] + 1
            facts["stalls"] += not moved
            end = "bottom" if bottom else "stalled" if facts["run"] >= self.max_stalls else "limit" if step >= self.max_steps else "closed" if closed else None
            if end:
                yield _frame([*out, self._ended(key[0], facts, end, known)])
                self._wake(now + self.keep_ms, known)
                return
        ids.save()
        marks.save()
        self.facts.update(tuple(facts[n] for n in names))
        self._wake(max(now, timerValues.getCurrentWatermarkInMs()) + self.quiet_ms, known)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Silence: an open capture is reported as it stands; one that is over is forgotten."""
        names = [f.split()[0] for f in self.FACTS.split(", ")]
        held = self.facts.get()
        if held and not held[-1]:
            yield _frame([self._ended(key[0], dict(zip(names, held, strict=True)), "silent")])
            self._wake(timerValues.getCurrentWatermarkInMs() + self.keep_ms)
        else:
            self.facts.clear()


_CAPTURED = f"{OUTPUT}, {REPORT}"


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _CAPTURED.split(", ")]).astype(object)


def captured(windows: DataFrame, max_steps: int = MAX_STEPS, max_stalls: int = MAX_STALLS, quiet_s: int = 600, keep_s: int = 3600, late_s: int = 60) -> DataFrame:
    """The stream of a capture: messages as ``first_sight`` marks them, and one row with ``ended_by`` when it ends.

    ``windows`` has conv_id, step, at (when it was taken), moved, at_top, at_bottom, closed, idx, id, role and text: what is
    visible at a step, or one row with a null text where nothing is. A null ``moved`` means: where a new message is seen.
    ``closed`` says that no step follows. A capture of which nothing comes for ``quiet_s`` seconds while others go on has
    ended. Windows may come ``late_s`` seconds after later ones of the stream. Needs the RocksDB state store.
    """
    rows = _cleaned(windows.withWatermark("at", f"{late_s} seconds"), "at", "moved", "at_top", "at_bottom", "closed")
    return rows.groupBy("conv_id").transformWithStateInPandas(Capture(max_steps, max_stalls, quiet_s, keep_s), _CAPTURED, "append", "eventTime")


def messages_of(captured: DataFrame) -> DataFrame:
    return captured.filter("ended_by IS NULL").select(*(f.split()[0] for f in OUTPUT.split(", ")))


def reports_of(captured: DataFrame) -> DataFrame:
    """Completeness reports, one per capture that has ended."""
    none = F.expr("cast(array() as array<string>)")
    warned = F.when(F.col("ended_by") == "stalled", F.array(F.lit(STALLED))).when(F.col("ended_by") == "limit", F.array(F.lit(STEP_LIMIT))).otherwise(none)
    facts = captured.filter("ended_by IS NOT NULL").withColumns({"scan_warnings": warned, "platform_warnings": none, "virtualized": F.lit(False)})
    return judged(facts)
