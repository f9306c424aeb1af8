"""Repeats settled in rounds, without a task that takes a conversation whole."""

import random

import pytest

from millrace.operators import normalize
from millrace.operators.shared import rank_in

KEYED = "conv_id long, idx long, id string, fp string"


def plain(rows):
    out, ids, marks = [], set(), set()
    for conv, idx, ident, mark in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        if (conv, ident) not in ids and (conv, mark) not in marks:
            out.append((conv, idx))
            marks.add((conv, mark))
            if ident is not None:
                ids.add((conv, ident))
    return sorted(out)


def cases():
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.choice([None, *(f"i{k}" for k in range(40))]), f"f{rng.randrange(60)}") for i in range(600)]
    rows += [(7, i, f"i{i // 2}", f"f{(i + 1) // 2}") for i in range(24)]  # every row hangs on the one before
    rows += [(8, i, "same", f"f{i}") for i in range(50)] + [(9, i, f"i{i}", "same") for i in range(50)]
    return rows


@pytest.mark.parametrize("fold", [0, 100, normalize.FOLD_ROWS])
def test_rounds_keep_the_rows_that_the_fold_keeps(spark, monkeypatch, fold):
    monkeypatch.setattr(normalize, "FOLD_ROWS", fold)
    rows = cases()
    df = spark.createDataFrame(rows, KEYED).repartition(4)
    for rounds in (False, True):
        assert sorted((r["conv_id"], r["idx"]) for r in normalize.first_rows(df, rounds).collect()) == plain(rows)
    assert normalize.first_rows(spark.createDataFrame([], KEYED), True).count() == 0


def test_places_in_groups_over_many_partitions(spark):
    rows = [(i % 3 if i % 11 else None, i * 7 % 1000) for i in range(1000)]
    have = rank_in(spark.createDataFrame(rows, "g int, at int").repartition(5), "g", "at", "n")
    want = []
    for g in {r[0] for r in rows}:
        want += [(g, at, n) for n, (_, at) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]))]
    assert sorted(map(repr, map(tuple, have.collect()))) == sorted(map(repr, want)) and have.columns == ["g", "at", "n"]


def test_rows_are_cleaned_once_in_rounds(spark):
    """What follows reads the cleaned rows back; the table itself would be cleaned and hashed for every use."""
    from millrace.plans import catalog

    found = catalog.dedupe_in_rounds(spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "conversations.parquet" in f]


@pytest.mark.parametrize("name", ["render_md_research_log", "render_zip", "render_docx"])
def test_messages_are_made_once_for_all_renderers(spark, name):
    """Only the headers read the table; messages are read back by every renderer and report."""
    from millrace.plans import catalog

    _, found, reports = catalog._parts(spark, "/root/testdata/sf0.001")
    assert not [f for df in (found, reports) for f in df.inputFiles() if "conversations.parquet" in f]
    assert [f for f in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "settled" in f]
