"""Pages: references that a cut text left open, and what a task holds of them."""

import gc
import weakref

import duckdb
import pyarrow as pa

from millrace.operators import shared
from millrace.plans import catalog
from millrace.sources import dom
from millrace.sources.dom import parse


def test_page_content_leaves_references_without_a_semicolon(spark, tmp_path):
    pages = [
        (1, "https://e.org/a", "<html><head><title>A &amp; B &amp</title></head><body><p>x &lt;y&gt; &quo</p><p>and &amp</p><p>&copy; z &quot</p></body></html>"),
        (2, "https://e.org/b", "<html><head><title>t</title></head><body><p>R&D &amp;amp; &a &am</p><p>&#39;q&#39; &copy</p></body></html>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    ours = {tuple(r[c] for c in ("page_id", "title", "n_links", "n_tables", "n_code", "text")) for r in catalog.page_content(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert ours == set(db.execute(f"SELECT page_id, title, n_links, n_tables, n_code, text FROM ({catalog.SQL['page_content']})").fetchall())
    assert {r[5].split("\n\n")[1] for r in ours if r[0] == 1} == {"and &amp"}


def test_references_as_a_browser_and_as_written():
    text = "a&amp b&amp; &notit; &#65 &#65; &#x42; & &&lt;"
    assert parse(f"<p>{text}</p>").text() == "a& b& ¬it; A A B & &<"
    assert parse(f"<p>{text}</p>", bare=False).text() == "a&amp b& &notit; &#65 A B & &<"


def test_a_task_holds_few_rows_and_no_page_that_it_is_done_with(spark):
    """A batch of many pages gives many batches of rows, and a page's tree falls apart once its rows are made."""
    assert hasattr(shared, "pieces")
    given = pa.RecordBatch.from_pylist([{"n": i} for i in range(60)])
    made = list(shared.pieces([given], lambda x: 1 << 20, lambda row: [row["n"]] * 2, lambda rows: pa.record_batch([pa.array(rows)], ["n"])))
    assert max(b.num_rows for b in made) <= 4 and [n for b in made for n in b["n"].to_pylist()] == [n for i in range(60) for n in (i, i)]
    with dom.parsed("<div><p>a<b>c</b></p></div>") as root:
        inner = weakref.ref(next(n for n in root.walk() if n.tag == "b"))
        gc.disable()
    try:
        del root
        assert inner() is None
    finally:
        gc.enable()


def test_queries_on_pages_and_files_lower_the_batches(spark):
    key, sf = "spark.sql.execution.arrow.maxRecordsPerBatch", "/root/testdata/sf0.001"
    before = spark.conf.get(key)
    try:
        for name in ("scan_platforms", "scan_by_markup", "render_docx", "render_docx_tables", "render_zip", "page_content"):
            spark.conf.set(key, "10000")
            catalog.QUERIES[name](spark, sf)
            assert int(spark.conf.get(key)) <= 512, name
    finally:
        spark.conf.set(key, before)
