"""Operators on conversations against sequential models and hand-made cases."""

import io
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions.redaction import Redaction
from millrace.operators import batch, completeness, export, library, normalize, quality, render, scan, selection
from millrace.operators.schema import complete
from millrace.plans.options import ExportOptions, PdfSettings
from millrace.sinks import files
from millrace.sources import chat_pages, dom
from tests.core.test_functions import clean_model, hash_model

SF = "/root/testdata/sf0.001"
RAW = "conv_id long, idx long, id string, role string, text string"


def dedupe_model(rows):
    kept, lost, ids, marks = [], 0, set(), set()
    for _, idx, ident, role, text in sorted(rows, key=lambda r: r[1]):
        text = clean_model(text or "")
        if not text:
            continue
        mark = f"{role}:{hash_model(text)}"
        ident = (ident or "").strip() or "msg-" + hash_model(f"{mark}:{len(kept)}")
        if ident in ids or mark in marks:
            lost += 1
            continue
        ids.add(ident)
        marks.add(mark)
        kept.append((len(kept), ident, role, text))
    return kept, lost


def test_dedupe_by_two_keys_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = [(c, i, rng.choice([None, " ", "a", "b", "c", "d"]), rng.choice(["user", "assistant"]), rng.choice(["x", "y", " y ", "z", "w", "", None])) for c in range(300) for i in range(rng.randrange(1, 12))]
    have: dict = {}
    for r in normalize.normalize(spark.createDataFrame(rows, RAW)).collect():
        have.setdefault(r["conv_id"], []).append(r)
    for c in range(300):
        want, lost = dedupe_model([r for r in rows if r[0] == c])
        got = sorted(have.get(c, []), key=lambda r: r["idx"])
        assert [(r["idx"], r["id"], r["role"], r["text"]) for r in got] == want
        assert not got or got[0]["duplicate_count"] == lost


def test_empty_tables(spark):
    none = spark.createDataFrame([], RAW)
    clean = normalize.normalize(none)
    assert clean.count() == 0 and completeness.report(clean).count() == 0 and selection.filter_scope(clean, "range", 0, 1).count() == 0


def test_roles_and_labels(spark):
    df = spark.createDataFrame([(" Human ",), ("BOT",), ("tool",), ("x",), (None,)], "r string")
    got = [tuple(r) for r in df.select(normalize.role_of(F.col("r")).alias("a")).select("a", normalize.author_label(F.lit("  "), F.col("a"))).collect()]
    assert got == [("user", "User"), ("assistant", "Assistant"), ("tool", "Tool"), ("other", "Other"), ("other", "Other")]


def test_selection_and_ranges(spark):
    m = normalize.normalize(spark.createDataFrame([(1, i, f"m{i}", "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(5)], RAW))
    texts = lambda df: [r["text"] for r in df.orderBy("idx").collect()]
    marked = selection.select_messages(m, ["m0"], ["assistant:t1", "user:" + hash_model("t2")])
    assert texts(selection.filter_scope(marked, "selected")) == ["t0", "t1", "t2"]
    keys = spark.createDataFrame([("m0",), ("m0",), ("user:t4",), (None,)], "key string")
    assert texts(selection.filter_scope(selection.select_by_keys(m, keys), "selected")) == ["t0", "t4"]
    assert texts(selection.filter_scope(m, "range", 1, 2)) == ["t1", "t2"] and texts(selection.filter_scope(m, "range", 3, 5)) == []
    assert selection.exported_count(m, "user_only").collect()[0]["exported"] == 3


def test_completeness(spark):
    none = []
    scans = spark.createDataFrame(
        [(1, True, True, 0, 0, none, none, False), (2, False, True, 3, 1, ["w", "w"], ["p"], True), (3, True, True, 0, 0, none, none, True), (4, True, True, 0, 0, none, none, False)],
        "conv_id long, reached_top boolean, reached_bottom boolean, scroll_steps int, duplicate_count long, scan_warnings array<string>, platform_warnings array<string>, virtualized boolean",
    )
    m = normalize.normalize(spark.createDataFrame([(c, 0, None, "user", "hi") for c in (1, 2, 3)], RAW))
    got = {r["conv_id"]: (r["status"], r["warnings"], r["message_count"]) for r in completeness.report(m, scans).collect()}
    assert got == {1: ("complete", [], 1), 2: ("partial", ["w", completeness.TOP, completeness.VIRTUAL], 1), 3: ("probably_complete", [completeness.VIRTUAL], 1), 4: ("unknown", [], 0)}


def _conversation(spark):
    head = spark.createDataFrame([(1, "chatgpt", "ChatGPT", "https://chatgpt.com/c/golden", "Golden Export", "golden", "2026-05-31T10:20:30.000Z")],
                                 "conv_id long, platform string, platform_label string, source_url string, title string, conversation_id string, exported_at string")
    code = "conv_id long, idx long, id string, role string, author_label string, text string, markdown string, code_blocks array<struct<language:string,code:string>>, sources array<struct<id:string,kind:string,title:string,url:string,snippet:string>>, thinking_blocks array<struct<title:string,text:string>>, images array<struct<alt:string,src:string,dataUri:string,localFilename:string,omittedReason:string,mimeType:string,hash:string,width:int,height:int>>"
    rows = [
        (1, 0, "u", "user", None, "Mail me at a@b.org <now>", None, [], None, None, []),
        (1, 1, "a", "assistant", "ChatGPT", "Here is code:", None, [("ts", "const a = `x`;\n\n")], [("s", "citation", "A [b]", "https://x.y", None)], [("Why", "because")],
         [("pic", None, "data:image/png;base64,AAAA", None, None, None, None, 2, 3)]),
    ]
    return head, normalize.normalize(spark.createDataFrame(rows, code))


def test_render_and_options(spark):
    head, m = _conversation(spark)
    got = {r["format"]: r for r in files.render_files(head, m, ExportOptions(formats=("md", "txt", "csv", "json", "html", "docx", "pdf", "png"), redaction=Redaction.of("basic"))).collect()}
    md = got["md"]["text"]
    assert md.startswith('---\nschema_version: "1.0"\nprofile: "default"\nplatform: "ChatGPT"\n') and "## 1. User\n\nMail me at [REDACTED_EMAIL] <now>\n\n---\n\n## 2. ChatGPT\n\nHere is code:\n\nImages:\n- Image omitted: embedded PNG" in md
    assert "[^a-source-1]: Citation - [A \\[b\\]](https://x.y)" in md and md.endswith("```ts\nconst a = `x`;\n```\n") and "because" not in md
    assert got["txt"]["text"].startswith("Title: Golden Export\nPlatform: ChatGPT\n") and "Code block (ts):\nconst a = `x`;" in got["txt"]["text"]
    assert got["csv"]["text"].split("\n")[0] == "index,role,authorLabel,text,model,createdAt,messageId"
    assert '"schemaVersion"' in got["json"]["text"] and "AAAA" not in got["json"]["text"] and "&lt;now&gt;" in got["html"]["text"]
    assert got["md"]["filename"] == "2026-05-31T10-20-30Z_chatgpt_Golden-Export.md" and got["png"]["fallback"] and got["png"]["filename"].endswith(".txt")
    assert "word/document.xml" in zipfile.ZipFile(io.BytesIO(got["docx"]["bytes"])).namelist()
    assert got["pdf"]["bytes"].startswith(b"%PDF-1.4") and b"/Count 1" in got["pdf"]["bytes"]
    shown = files.render_files(head, m, ExportOptions(include_reasoning=True, include_metadata=False, profile="github")).collect()[0]["text"]
    assert "Why: because" in shown and not shown.startswith("---") and "&lt;now&gt;" in shown


def test_zip_bundle_is_stable(spark):
    head, m = _conversation(spark)
    one, two = (files.render_files(head, m, ExportOptions(formats=("zip", "md", "csv"))).collect()[0]["bytes"] for _ in range(2))
    assert one == two and zipfile.ZipFile(io.BytesIO(one)).namelist() == ["manifest.json", "conversation.csv", "conversation.md"]


def test_wrap(spark):
    df = spark.createDataFrame([("aa bb cc\n\nddddddddd e",)], "t string")
    assert df.select(files.wrap(F.col("t"), 5)).collect()[0][0] == ["aa bb", "cc", "", "ddddd", "dddd", "e"]
    pages = df.select(files.pdf_pages(F.lit("a\n---\nb\n"), PdfSettings())).collect()[0][0]
    assert [p[0] for p in pages] == ["a", "b"]
    assert PdfSettings(font_size=99, margin=1, page="x") == PdfSettings()


def test_library(spark, tmp_path):
    head, m = _conversation(spark)
    r = library.records(head, m, completeness.report(m), F.lit("2026-06-01"), F.array(F.lit(" x "), F.lit("x"), F.lit("")))
    store = library.Library(spark, str(tmp_path / "lib"))
    store.clear()
    store.put(r)
    store.put(r)
    assert store.list().count() == 1 and store.read().collect()[0]["tags"] == ["x"]
    assert library.search(store.read(), "GOLDEN", tags=["X"]).count() == 1 and library.search(store.read(), label="no").count() == 0
    store.delete(r.select("id"))
    assert store.read().count() == 0


def test_pages_to_messages(spark):
    html = """<html><head><title> A  chat </title></head><body><article data-testid="conversation-turn-1"><div data-message-author-role="user" data-message-id="u1"><p>Hi <b>there</b></p><button>Copy</button></div></article>
    <article data-testid="conversation-turn-2"><div data-message-author-role="assistant"><ul><li>one<li>two</ul><pre><code class="language-py">x = 1\n  y</code></pre><table><tr><th>a<th>b<tr><td>1|2</table></div></article>
    <div data-message-author-role="user" hidden>gone</div></body></html>"""
    other = "<div data-testid='user-message'>q</div><div data-testid='assistant-message'><div class='prose'><p>an <a href='https://x.y'>link</a></p></div></div>"
    pages = spark.createDataFrame([(1, "https://chatgpt.com/c/77", html), (2, "https://claude.ai/chat", other), (3, "https://none.example", "<p>x"), (4, None, None)], "page_id long, url string, html string")
    rows = {(r["conv_id"], r["idx"]): r for r in chat_pages.scan(pages).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert rows[1, 0]["text"] == "Hi there" and rows[1, 0]["id"] == "u1" and rows[1, 0]["conversation_id"] == "77"
    assert rows[1, 1]["id"] == "conversation-turn-2" and rows[1, 1]["code_blocks"][0]["language"] == "py"
    assert rows[1, 1]["markdown"] == "- one\n- two\n\n```py\nx = 1\n  y\n```\n\n| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    assert rows[2, 1]["markdown"] == "an [link](https://x.y)" and rows[2, 1]["author_label"] == "Claude"
    assert [n.tag for n in dom.parse("<div class='a b'><p id=x>t").select("div.a p")] == ["p"]


def test_snapshots_and_replay(spark):
    windows = spark.createDataFrame([(1, 0, 0, "a", "user", "x"), (1, 1, 0, "a", "user", "x changed"), (1, 1, 1, None, "user", "x"), (1, 1, 2, "b", "user", "y")], "conv_id long, step int, idx int, id string, role string, text string")
    assert [r["text"] for r in scan.merge_snapshots(windows).orderBy("idx").collect()] == ["x", "y"]
    steps = spark.createDataFrame([(1, i, 1 if i == 0 else 0, False) for i in range(12)], "conv_id long, step int, new_messages int, at_bottom boolean")
    assert scan.replay(steps).collect()[0]["scan_warnings"] == [scan.STALLED]


def test_stateful_capture(spark, tmp_path):
    from millrace.streaming.capture import first_sight

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 0, 0, "a", "user", "x"), (1, 1, 0, "a", "user", "z"), (1, 1, 1, None, "user", " x "), (1, 1, 2, "b", "user", "y"), (2, 0, 0, None, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, step int, idx int, id string, role string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, step int, idx int, id string, role string, text string").parquet(str(tmp_path / "in"))
    q = first_sight(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r["conv_id"], r["step"], r["idx"], r["duplicate"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, 0, False), (1, 1, 0, True), (1, 1, 1, True), (1, 1, 2, False), (2, 0, 0, False)]


def test_library_keeps_the_last_of_equal_ids_and_renders_again(spark, tmp_path):
    head, m = _conversation(spark)
    r = library.records(head, m, completeness.report(m), F.lit("2026-06-01"))
    store = library.Library(spark, str(tmp_path / "lib"))
    store.put(r.withColumn("title", F.lit("early")).unionByName(r.withColumns({"title": F.lit("late"), "saved_at": F.lit("2026-06-02")})))
    kept = store.read()
    assert [x["title"] for x in kept.collect()] == ["late"] and len(kept.first()["id"]) == len("library-") + 32
    heads, messages, reports = library.stored(kept)
    made = {x["format"]: x for x in files.render_files(heads, messages, ExportOptions(formats=("md", "zip"), template="{title}.{format}"), reports).collect()}
    assert made["zip"]["filename"] == "late.zip" and zipfile.ZipFile(io.BytesIO(made["zip"]["bytes"])).namelist() == ["manifest.json", "conversation.md"]


def test_deep_markup(spark):
    deep = "<div data-message-author-role='user'>" + "<span>" * 3000 + "inner" + "<ul><li>" * 300 + "item"
    rows = chat_pages.scan(spark.createDataFrame([(1, "https://chatgpt.com/c/1", deep)], "page_id long, url string, html string")).collect()
    assert rows[0]["text"].split() == ["inner", "item"] and "item" in rows[0]["markdown"]


def test_reasoning_canvas_and_kind(spark):
    page = """<article data-testid="conversation-turn-2" data-model="M 2"><div data-content-type="deep-research" data-message-author-role="assistant" data-message-id="a"><time datetime="2026-06-01T10:05:00.000Z">June</time>
    <div class="markdown"><p>Found <sup data-testid="citation"><a data-source-id="c1" href="https://e.org/p">1</a></sup> it.</p></div><details data-testid="thinking"><summary>Thinking</summary><p>Compare first.</p></details>
    <div hidden data-testid="reasoning">no</div><section data-testid="sources"><ol><li><a data-source-kind="deep_research" href="https://e.org/q">Paper</a><p>Reviewed.</p></li><li><a href="javascript:x">bad</a></li></ol></section>
    <div aria-label="Canvas: plan"><h2>Plan</h2><a href="https://chatgpt.com/canvas/1">Open</a></div></div></article>"""
    (row,) = chat_pages.scan(spark.createDataFrame([(1, "https://chatgpt.com/c/1", page)], "page_id long, url string, html string")).collect()
    assert row["metadata"] == {"adapter": "chatgpt", "contentKind": "deep_research"} and row["model"] == "M 2" and row["created_at"] == "2026-06-01T10:05:00.000Z"
    assert [tuple(x) for x in row["thinking_blocks"]] == [("Thinking", "Compare first.")]
    assert [tuple(x) for x in row["canvas"]] == [("Canvas: plan", None, "https://chatgpt.com/canvas/1", chat_pages.CANVAS_WARNING)]
    assert [(x["id"], x["kind"], x["title"], x["snippet"]) for x in row["sources"]] == [("c1", "citation", "1", "Found 1 it."), (None, "deep_research", "Paper", "PaperReviewed.")]


def test_pdf_settings_and_other_scripts():
    data = files.write_pdf([["Größe (a\\b) — Привет"]], PdfSettings(page="letter", landscape=True, theme="dark"))
    assert b"/MediaBox[0 0 792 612]" in data and b"0.067 0.094 0.153 rg" in data and "(Größe \\(a\\\\b\\) — ) Tj".encode("cp1252") in data
    assert b"<FEFF" + "Привет".encode("utf-16-be").hex().upper().encode() + b">" in data and data.endswith(b"%%EOF\n")


def test_validation_and_hygiene(spark):
    head, m = _conversation(spark)
    good = head.withColumns({"schema_version": F.lit("1.0"), "message_count": F.lit(2), "status": F.lit("complete")})
    assert quality.validate(good, m).collect()[0]["errors"] == []
    bad = good.withColumns({"message_count": F.lit(7), "source_url": F.lit(None).cast("string")})
    assert quality.validate(bad, m.withColumn("role", F.lit("x"))).collect()[0]["errors"] == [
        "sourceUrl must be a string", "messages[0].role must be a supported chat role", "messages[1].role must be a supported chat role", "messageCount must match messages.length"]
    assert quality.hygiene(spark.createDataFrame([("data:image x",), (None,)], "text string")).collect()[0]["n_flagged"] == 1


def test_batches(spark):
    tabs = spark.createDataFrame([(1, " ", "https://claude.ai/x"), (2, "A", "https://nowhere.example"), (None, "B", "https://claude.ai"), (3, "A!", None)], "tab_id long, title string, url string")
    found = batch.candidates(tabs)
    assert [tuple(r) for r in batch.entry_names(found.withColumn("batch_id", F.lit(1)), "batch_id").select("tab_id", "title", "entry").collect()] == [(1, "Untitled chat", "claude-untitled-chat-1")]


CATALOG = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", CATALOG)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "documents", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    have = entry.queries()[name](spark, SF)
    cols = sorted(have.columns)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(want, key=key) == sorted((tuple(r) for r in have.select(*cols).collect()), key=key)


@pytest.mark.parametrize(
    ("markup", "kept"),
    [
        *((f"<img alt='{w}' src=https://x.org/a.png width=16 height=16>", True) for w in ("a chart", "Diagram", "photo", "screenshot", "uploaded file", "image")),
        *((f"<img alt='{w}' src=https://x.org/a.png width=300 height=200>", False) for w in ("user", "ChatGPT", "my avatar")),
        ("<img alt=charts src=https://x.org/a.png width=16 height=16>", False),
        ("<img src=https://x.org/a.png width=16>", True),
        ("<img alt=x>", False),
        ("<figure><img src=https://x.org/a.png width=16 height=16></figure>", True),
        ("<div data-testid=Attachment-1><img src=https://x.org/a.png width=16 height=16></div>", True),
        ("<img src=https://x.org/avatars/a.png>", False),
        ("<span class=userAvatar><img src=https://x.org/a.png></span>", False),
        *((f"<{c}><img src=https://x.org/a.png></{c.split()[0]}>", False) for c in ("form", "div role=checkbox", "div role=menuitem", "div contenteditable=true", "div data-testid=copy-turn", "span aria-label='Give feedback'", "span data-testid=rating")),
        ("<div hidden><img src=https://x.org/a.png></div>", False),
        ("<img src='data:image/png;base64,avatar'>", True),
    ],
)
def test_which_images_are_content(markup, kept):
    from millrace.sources import chat_pages, dom

    assert bool(chat_pages.content_images(dom.parse(f"<div>{markup}</div>"))) == kept
