"""Captures as a stream: ends, silence, late windows and one report each."""

import datetime as dt

import pytest

from millrace.operators.completeness import BOTTOM, TOP
from millrace.operators.scan import STALLED
from millrace.streaming import capture

SCHEMA = "conv_id long, step int, at timestamp, moved boolean, at_top boolean, at_bottom boolean, closed boolean, idx int, id string, role string, text string"


def window(conv, step, second, *texts, moved=None, top=False, bottom=False, closed=False):
    at = dt.datetime(2026, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=second)
    return [(conv, step, at, moved, top, bottom, closed, i, None, "user", t) for i, t in enumerate(texts or [None])]


@pytest.fixture
def run(spark, tmp_path):
    stores = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(stores)
    spark.conf.set(stores, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(*batches, **how):
        """Each batch is a run of its own over one checkpoint, so that state and watermark are carried on."""
        for rows in batches:
            spark.createDataFrame([r for w in rows for r in w], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = capture.captured(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), **how)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert q.awaitTermination(180)
        out = spark.read.parquet(str(tmp_path / "out"))
        reports = [r.asDict() for r in capture.reports_of(out).orderBy("scroll_steps", "message_count").collect()]
        return sorted((r["conv_id"], r["step"], r["text"], r["duplicate"]) for r in capture.messages_of(out).collect()), reports

    yield go
    spark.conf.set(stores, before)


def test_ends_of_a_capture(run):
    messages, reports = run([
        window(1, 0, 0, "a", "b", top=True), window(1, 1, 1, "b", "c", bottom=True), window(1, 2, 2, "late"),
        window(2, 0, 0, "a"), window(2, 1, 1, "a"), window(2, 2, 2, "a"), window(2, 3, 3, "new"),
        window(3, 0, 0, "a", moved=True), window(3, 1, 1, moved=True), window(3, 2, 2, "z", moved=False), window(3, 3, 3, "y", moved=True, closed=True),
        window(4, 0, 0, "  ", closed=True),
    ], max_stalls=2)
    assert messages == [(1, 0, "a", False), (1, 0, "b", False), (1, 1, "b", True), (1, 1, "c", False), (2, 0, "a", False), (2, 1, "a", True), (2, 2, "a", True), (3, 0, "a", False), (3, 2, "z", False), (3, 3, "y", False)]
    assert len(reports) == 4
    reports = {r["conv_id"]: r for r in reports}
    assert reports[1]["status"] == "complete" and (reports[1]["message_count"], reports[1]["duplicate_count"], reports[1]["scroll_steps"]) == (3, 1, 1)
    assert reports[2]["warnings"] == [STALLED, TOP, BOTTOM] and reports[2]["scroll_steps"] == 2
    assert reports[3]["warnings"] == [TOP, BOTTOM] and reports[3]["last_message_preview"] == "y"
    assert reports[4]["status"] == "unknown" and reports[4]["message_count"] == 0


def test_silence_and_windows_after_the_end(run):
    """Capture 1 falls silent while 2 goes on; what comes for it later, before it is forgotten, begins no other."""
    messages, reports = run(
        [window(1, 0, 0, "a", top=True), window(2, 0, 0, "x", top=True)],
        [window(2, 1, 100, "y")],
        [window(1, 1, 100, "late"), window(2, 2, 102, "x", "z", bottom=True)],
        [window(3, 0, 1000, "q", closed=True)],
        [window(1, 0, 1001, "again", closed=True)],
        quiet_s=30, keep_s=200, late_s=5,
    )
    assert [m for m in messages if m[0] == 1] == [(1, 0, "a", False), (1, 0, "again", False)]
    assert [m for m in messages if m[0] == 2] == [(2, 0, "x", False), (2, 1, "y", False), (2, 2, "x", True), (2, 2, "z", False)]
    assert sorted((r["conv_id"], r["status"], r["message_count"], r["first_message_preview"]) for r in reports) == [(1, "partial", 1, "a"), (1, "partial", 1, "again"), (2, "complete", 3, "x"), (3, "partial", 1, "q")]


def test_a_capture_that_comes_whole_asks_the_store_for_no_key():
    """Each question to the state store is a round trip; what a new capture shows cannot be there."""
    import pandas as pd

    class Store(dict):
        asked = 0

        def containsKey(self, key):
            Store.asked += 1
            return key in self

        def updateValue(self, key, value):
            Store.asked += 1
            self[key] = value

    class Handle:
        def __init__(self):
            self.value, self.timers = None, []

        def getMapState(self, *_):
            return Store()

        def getValueState(self, *_):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def listTimers(self):
            Store.asked += 1
            return iter(())

        def registerTimer(self, at):
            self.timers.append(at)

    of = capture.Capture(6, 2, 600, 3600)
    handle = Handle()
    of.init(handle)
    rows = [(1, s, i, None, "user", f"t{i}", f"f{i}", pd.Timestamp(1_780_000_000 + s, unit="s"), True, True, s == 3, False) for s in range(4) for i in (s, s + 1)]
    part = pd.DataFrame(rows, columns=["conv_id", "step", "idx", "id", "role", "text", "fp", "at", "moved", "at_top", "at_bottom", "closed"])
    out = pd.concat(list(of.handleInputRows((1,), iter([part]), None)))
    report = out[out["ended_by"].notna()].iloc[0]
    assert (report["ended_by"], report["message_count"], report["duplicate_count"]) == ("bottom", 5, 3)
    assert Store.asked == 0 and handle.value[-1] is True and len(handle.timers) == 1
