"""The library under writers at once, with files that are never rewritten."""

import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators.library import Library, search

RECORD = "id string, saved_at string, content_hash string, title string, tags array<string>"


def record(i, title="first", saved="2026-01-01"):
    return (f"r{i}", saved, f"h{title}", title, ["a"])


@pytest.fixture
def library(spark, tmp_path):
    return Library(spark, f"file://{tmp_path}/library")


def titles(library):
    df = library.read()
    return {} if df is None else {r["id"]: r["title"] for r in df.collect()}


def files(tmp_path):
    return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "library/files").rglob("*.parquet")}


def test_put_delete_clear(spark, library, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, RECORD)
    assert library.read() is None and library.list() is None
    library.delete(make(record(1)))
    library.clear()
    library.put(make(*(record(i) for i in range(20))))
    before = files(tmp_path)
    library.put(make(record(3, "second"), record(30), record(30, "later", "2026-01-02")))
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) - len(before) <= 4  # the two records and their ids
    assert titles(library) == {**{f"r{i}": "first" for i in range(20)}, "r3": "second", "r30": "later"}
    library.delete(make(record(3), record(4), record(99)).select("id"))
    library.put(make(record(4, "again")))
    assert titles(library) == {**{f"r{i}": "first" for i in range(20) if i != 3}, "r4": "again", "r30": "later"}
    assert [r["id"] for r in library.list().limit(1).collect()] == ["r30"]
    assert {r["title"] for r in library.get(["r4", "r3", "r7"]).collect()} == {"again", "first"}
    library.clear()
    assert titles(library) == {}
    library.put(make(record(1, "new")))
    assert titles(library) == {"r1": "new"}


def test_get_reads_the_buckets_of_its_ids_only(spark, library):
    library.put(spark.createDataFrame([record(i) for i in range(200)], RECORD))
    plan = library.get(["r7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", " ") or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert [r["id"] for r in library.get(["r7"]).collect()] == ["r7"]


def test_writers_at_once_all_survive(spark, library, tmp_path):
    library.put(spark.createDataFrame([record(i) for i in range(4)], RECORD))
    errors = []

    def write(k):
        try:
            own = Library(spark, library.path)
            own.put(spark.createDataFrame([record(100 + k), record(0, f"of {k}")], RECORD))
            own.delete(spark.createDataFrame([(f"r{k}",)], "id string"))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = titles(library)
    assert not errors and set(found) == {"r0", "r101", "r102", "r103"} and found["r0"].startswith("of ")
    assert library.state()["version"] == 7


def test_version_is_taken_once(library, spark):
    library.put(spark.createDataFrame([record(1)], RECORD))
    state = library.state()
    assert not library._claim(state) and library.state() == state
    assert library._claim(dict(state, version=2)) and not [n for n in library._names("versions") if n.startswith(".")]


@pytest.mark.parametrize("whole", [False, True])
def test_compaction_changes_no_record(spark, library, tmp_path, whole):
    library.COMPACT_AT = 1000
    library.put(spark.createDataFrame([record(i) for i in range(100)], RECORD))
    for k in range(4):
        library.put(spark.createDataFrame([record(k, f"put {k}"), record(50, f"put {k}"), record(200 + k)], RECORD))
        library.delete(spark.createDataFrame([(f"r{60 + k}",), (f"r{200 + k - 1}",)], "id string"))
    want, before = titles(library), files(tmp_path)
    library.compact(whole)
    state = library.state()
    assert titles(library) == want and len(state["data"]) == (1 if whole else 2) and len(state["lists"]) == (0 if whole else 1)
    assert before.items() <= files(tmp_path).items()
    library.put(spark.createDataFrame([record(50, "last")], RECORD))
    library.delete(spark.createDataFrame([("r0",)], "id string"))
    assert titles(library) == {k: "last" if k == "r50" else v for k, v in want.items() if k != "r0"}
    library.vacuum(versions=1, older_than_s=-1)
    assert titles(library) == {k: "last" if k == "r50" else v for k, v in want.items() if k != "r0"} and len(files(tmp_path)) < len(before) + 40


def test_compaction_keeps_what_is_written_meanwhile(spark, library, monkeypatch):
    library.COMPACT_AT = 1000
    for k in range(3):
        library.put(spark.createDataFrame([record(k), record(9, f"put {k}")], RECORD))
    other, commit = Library(spark, library.path), library._commit

    def late(change):
        other.put(spark.createDataFrame([record(9, "meanwhile"), record(7)], RECORD))
        other.delete(spark.createDataFrame([("r1",)], "id string"))
        return commit(change)

    monkeypatch.setattr(library, "_commit", late)
    library.compact(whole=True)
    assert titles(library) == {"r0": "first", "r2": "first", "r9": "meanwhile", "r7": "first"}
    assert len(library.state()["data"]) == 2


def test_new_columns_are_null_in_old_records(spark, library):
    library.put(spark.createDataFrame([record(1)], RECORD))
    library.put(spark.createDataFrame([(*record(2), 5)], f"{RECORD}, stars int"))
    assert {r["id"]: r["stars"] for r in library.read().collect()} == {"r1": None, "r2": 5}


def test_backup_is_put_again(spark, library, tmp_path):
    library.put(spark.createDataFrame([record(1), record(2, "two")], RECORD))
    rows, schema = sorted(library.read().collect()), library.read().schema
    library.backup(f"file://{tmp_path}/backup")
    library.clear()
    library.restore(f"file://{tmp_path}/backup", schema)
    assert sorted(library.read().select(*schema.fieldNames()).collect()) == rows and library.read().filter(F.col("id") == "r2").count() == 1


WHOLE = f"{RECORD}, project_label string, source_platform string, source_url string, completeness_status string"


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path):
    make = lambda ids, word: spark.createDataFrame([(*record(i, f"{word} Été {i}"), "lab" if i % 2 else None, "ChatGPT", f"https://chatgpt.com/c/{i}", "complete") for i in ids], WHOLE)
    store = Library(spark, f"file://{tmp_path}/indexed", indexed=True)
    assert store.search("abc") is None
    store.put(make(range(60), "Alpha"))
    store.put(make(range(50, 70), "Beta"))
    store.delete(make([5], "x").select("id"))
    for whole in (False, True):
        for how in ({"query": "ALPHA été 1"}, {"query": "beta"}, {"query": "/c/5"}, {"query": "no such"}, {"query": "ab"}, {"query": " "}, {"query": "a été", "label": "LAB"}, {"query": "aaaaaa"}, {"platform": "chatgpt"}):
            want = sorted(r["id"] for r in search(store.read(), **how).collect())
            assert sorted(r["id"] for r in store.search(**how).collect()) == want, how
        store.compact(whole=True)
    assert [r["title"] for r in store.search("beta été 55").collect()] == ["Beta Été 55"]
    plan = store.search("beta été 55")._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan and "dynamicpruning" in plan.lower()
    plain = Library(spark, store.path)  # a writer without the index: searches read all again
    plain.put(make([99], "Gamma"))
    assert [r["id"] for r in store.search("gamma").collect()] == ["r99"] and len(store.search("alpha").collect()) == 49
