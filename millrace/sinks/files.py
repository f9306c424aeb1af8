"""Rendered files: text formats from the column renderers, and the binary ones packed row by row.

Layout is done with columns (lines are wrapped and numbered, pages cut) so that Python only writes containers.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filenames import filename
from ..functions.text import stable_hash, strip_inline_markdown, xml_escape
from ..operators import batch, render
from ..operators.completeness import report
from ..operators.export import prepare_conversations, prepare_messages, prepare_reports
from ..operators.shared import pieces
from ..plans.options import THEMES, ExportOptions, PdfSettings

MIME = {
    "md": "text/markdown;charset=utf-8", "txt": "text/plain;charset=utf-8", "json": "application/json;charset=utf-8", "csv": "text/csv;charset=utf-8", "html": "text/html;charset=utf-8",
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "zip": "application/zip", "png": "image/png",
}
#: Raster limits: pixels of width and height, and of a line.
PNG_WIDTH, PNG_MAX_HEIGHT, PNG_LINE, PNG_COLUMNS = 1200, 16000, 24, 96
_STAMP = (1980, 1, 1, 0, 0, 0)
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
# Parts, types and namespaces of the word-processor format.
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006"
_PARTS = (
    ("word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", f"{_OFFICE}/relationships/officeDocument"),
    ("docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml", f"{_PACKAGE}/relationships/metadata/core-properties"),
    ("docProps/app.xml", "application/vnd.openxmlformats-officedocument.extended-properties+xml", f"{_OFFICE}/relationships/extended-properties"),
    ("word/styles.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml", f"{_OFFICE}/relationships/styles"),
)
_STYLES = (("Title", "Title", "<w:b/>", 36), ("Heading1", "Heading 1", "<w:b/>", 28), ("Heading2", "Heading 2", "<w:b/>", 22), ("CodeBlock", "Code Block", '<w:rFonts w:ascii="Consolas" w:hAnsi="Consolas"/>', 20))


def _related(parts) -> str:
    return f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{kind}" Target="{name}"/>' for i, (name, kind) in enumerate(parts, 1)) + "</Relationships>"


_DOCX = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t, _ in _PARTS) + "</Types>",
    "_rels/.rels": _related([(n, k) for n, _, k in _PARTS[:3]]),
    "word/_rels/document.xml.rels": _related([("styles.xml", _PARTS[3][2])]),
    "docProps/app.xml": f'<Properties xmlns="{_OFFICE}/extended-properties"><Application>millrace</Application></Properties>',
    "word/styles.xml": f'<w:styles xmlns:w="{_W}">' + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/><w:rPr>{how}<w:sz w:val="{size}"/></w:rPr></w:style>' for i, n, how, size in _STYLES) + "</w:styles>",
}
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def pack(files: Iterable[tuple[str, bytes]]) -> bytes:
    """A zip whose bytes depend on nothing but its files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, data in files:
            info = zipfile.ZipInfo(name, _STAMP)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def _pdf_text(line: str) -> bytes:
    """Operators that show a line. The font has the Windows Latin characters; a run of others is shown as question marks
    that carry the true text, so that searching and copying find it."""

    def shown(data: bytes) -> bytes:
        return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj "

    out = b""
    for known, run in groupby(line, lambda c: c in _LATIN):
        text = "".join(run)
        if known:
            out += shown(text.encode("cp1252"))
        else:
            out += b"/Span <</ActualText <FEFF" + text.encode("utf-16-be").hex().upper().encode() + b">>> BDC " + shown(b"?" * len(text)) + b"EMC "
    return out + b"T*\n"


_LATIN = frozenset(c for c in map(chr, range(32, 0x2200)) if c.encode("cp1252", "ignore"))


def write_pdf(pages: list[list[str]], settings: PdfSettings) -> bytes:
    """Pages of lines in a standard font."""
    w, h = settings.size
    colour = lambda c, op: " ".join(f"{x:g}" for x in c) + f" {op}"
    back, fore = THEMES[settings.theme]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"]
    for page in pages:
        head = f"{colour(back, 'rg')} 0 0 {w} {h} re f\n{colour(fore, 'rg')}\nBT /F1 {settings.font_size} Tf {settings.font_size * 1.4:.2f} TL {settings.margin} {h - settings.margin} Td\n"
        stream = head.encode() + b"".join(map(_pdf_text, page)) + b"ET"
        objects += [f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {w} {h}]/Resources<</Font<</F1 3 0 R>>>>/Contents {len(objects) + 2} 0 R>>".encode(), b"<</Length %d>>\nstream\n%b\nendstream" % (len(stream), stream)]
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects[1] = f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>".encode()
    out, at = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (i, body)
    table = "".join(f"{a:010d} 00000 n \n" for a in at)
    return out + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n{table}trailer\n<</Size {len(at) + 1}/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF\n".encode("ascii")


def wrap(c: Column, width: int) -> Column:
    """The lines of a text, none longer than ``width``: cut at spaces, long words inside."""
    piece = rf"[^\n]{{1,{width}}}(?=[ \n]|\z) ?|[^\n]{{{width}}}|(?<=\n|\A)(?=\n)|[^\n]+"
    return F.transform(F.regexp_extract_all(c, F.lit(piece), F.lit(0)), lambda line: F.rtrim(line))


def pdf_pages(text: Column, settings: PdfSettings) -> Column:
    """Pages of wrapped lines; a line ``---`` or ``\\pagebreak`` starts a page."""
    w, h = settings.size
    columns = int((w - 2 * settings.margin) / (settings.font_size * 0.6))
    per_page = int((h - 2 * settings.margin) / (settings.font_size * 1.4))
    parts = F.split(text, r"(?m)^(?:---|\\pagebreak)[ \t]*\n", -1)

    def cut(part: Column) -> Column:
        rows = wrap(strip_inline_markdown(part), columns)
        n = F.greatest(F.ceil(F.size(rows) / per_page).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(rows, i * per_page + 1, per_page))

    return F.flatten(F.transform(F.filter(parts, lambda p: F.trim(p) != ""), cut))


def png_height(text: Column) -> Column:
    """Pixels that a raster of the text would need."""
    return F.size(wrap(text, PNG_COLUMNS)) * PNG_LINE + 2 * PNG_LINE


def _packed(df: DataFrame, column: str, how) -> DataFrame:
    """conv_id, bytes: ``how(value)`` of every row of ``df`` (conv_id, column), in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = dict(df.dtypes)["conv_id"]

    schema = pa.schema([("conv_id", to_arrow_type(df.schema["conv_id"].dataType)), ("bytes", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces(batches, lambda row: len(row["bytes"]), lambda row: [{"conv_id": row["conv_id"], "bytes": how(row[column])}], lambda rows: pa.RecordBatch.from_pylist(rows, schema=schema))

    return df.select("conv_id", column).mapInArrow(run, f"conv_id {kind}, bytes binary")


def docx(bodies: DataFrame) -> DataFrame:
    """conv_id, bytes of ``bodies`` (conv_id, title, exported_at, xml; see ``render.word_body``)."""
    stamp = xml_escape(F.coalesce("exported_at", F.lit("")))
    dated = F.concat(*[x for n in ("created", "modified") for x in (F.lit(f'<dcterms:{n} xsi:type="dcterms:W3CDTF">'), stamp, F.lit(f"</dcterms:{n}>"))])
    core = F.concat(
        F.lit(f'<cp:coreProperties xmlns:cp="{_PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><dc:title>'),
        xml_escape(F.regexp_replace("title", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")), F.lit("</dc:title><dc:creator>millrace</dc:creator>"), dated, F.lit("</cp:coreProperties>"),
    )
    page = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr>'
    document = F.concat(F.lit(f'<w:document xmlns:w="{_W}"><w:body>'), F.col("xml"), F.lit(page + "</w:body></w:document>"))
    ready = bodies.select("conv_id", F.struct(core.alias("core"), document.alias("document")).alias("parts"))
    fixed = [(n, (_XML + t).encode()) for n, t in _DOCX.items()]
    return _packed(ready, "parts", lambda x: pack([*fixed, ("docProps/core.xml", (_XML + x["core"]).encode()), ("word/document.xml", (_XML + x["document"]).encode())]))


def pdf(documents: DataFrame, settings: PdfSettings | None = None) -> DataFrame:
    """conv_id, bytes of ``documents`` (conv_id, text)."""
    settings = settings or PdfSettings()
    return _packed(documents.select("conv_id", pdf_pages(F.col("text"), settings).alias("pages")), "pages", lambda pages: write_pdf(pages or [[]], settings))


def _pdf_documents(heads: DataFrame, messages: DataFrame, facts: DataFrame, settings: PdfSettings) -> DataFrame:
    text = render.plain_text(heads, messages, facts)
    if not settings.contents:
        return text
    return text.join(render.contents(messages), "conv_id").select("conv_id", F.concat("toc", "text").alias("text"))


def batch_archive(results: DataFrame, rendered: DataFrame, exported_at: str) -> DataFrame:
    """batch_id, filename, bytes: one zip per batch with the files of its entries and a manifest.

    ``results`` as for ``batch.manifest``, with a row per tab; ``rendered`` has tab_id, format, mime_type, text and
    bytes. Entries are named in the order of entry_no. Batches without a file have no row. A batch must fit a row.
    """
    content = F.coalesce("bytes", F.encode("text", "utf-8"))
    named = batch.entry_names(results.withColumn("title", F.coalesce("title", F.lit(""))), "batch_id", "entry_no").filter("error is null")
    file = F.struct(
        F.concat("entry", F.lit("."), "format").alias("filename"), "format", stable_hash(F.coalesce("text", F.hex("bytes"))).alias("hash"), F.col("mime_type").alias("mimeType"), F.octet_length(content).alias("size"), content.alias("data")
    )
    files = named.select("batch_id", "tab_id", "entry").join(rendered, "tab_id").groupBy("batch_id", "tab_id").agg(F.array_sort(F.collect_list(file)).alias("own"))
    with_files = results.drop("files").join(files, ["batch_id", "tab_id"], "left").withColumn("files", F.transform("own", lambda f: f.dropFields("data"))).drop("own")
    listed = batch.manifest_json(with_files, exported_at).withColumnRenamed("text", "manifest")
    gathered = files.groupBy("batch_id").agg(F.array_sort(F.flatten(F.collect_list(F.transform("own", lambda f: F.struct(f["filename"].alias("name"), f["data"].alias("data")))))).alias("files"))
    root = batch.root_directory(F.lit(exported_at))
    entry = lambda f: F.struct(F.concat(root, F.lit("/"), f["name"]).alias("name"), f["data"].alias("data"))
    manifest = F.array(F.struct(F.concat(root, F.lit("/manifest.json")).alias("name"), F.encode(F.concat("manifest", F.lit("\n")), "utf-8").alias("data")))
    ready = gathered.join(listed, "batch_id").select(F.col("batch_id").alias("conv_id"), F.concat(F.transform("files", entry), manifest).alias("files"))
    packed = _packed(ready, "files", lambda fs: pack((f["name"], f["data"]) for f in fs))
    return packed.select(F.col("conv_id").alias("batch_id"), F.concat(root, F.lit(".zip")).alias("filename"), "bytes")


def bundle(rendered: DataFrame) -> DataFrame:
    """conv_id, bytes: one zip per conversation of ``rendered`` (conv_id, format, text, bytes), manifest first.

    Text stand-ins for formats that could not be rendered are left out.
    """
    content = F.coalesce("bytes", F.encode("text", "utf-8"))
    file = F.struct("format", F.concat(F.lit("conversation."), "format").alias("name"), content.alias("data"), F.octet_length(content).alias("size"), stable_hash(F.coalesce("text", F.hex("bytes"))).alias("hash"))
    files = rendered.filter("not fallback").select("conv_id", file.alias("file")).groupBy("conv_id").agg(F.array_sort(F.collect_list("file")).alias("files"))
    listed = F.to_json(F.struct(F.transform("files", lambda f: f.dropFields("data", "format")).alias("files")))
    ready = files.select("conv_id", F.concat(F.array(F.struct(F.lit("manifest.json").alias("name"), F.encode(listed, "utf-8").alias("data"))), F.transform("files", lambda f: F.struct(f["name"].alias("name"), f["data"].alias("data")))).alias("files"))
    return _packed(ready, "files", lambda fs: pack((f["name"], f["data"]) for f in fs))


def render_files(conversations: DataFrame, messages: DataFrame, options: ExportOptions | None = None, reports: DataFrame | None = None) -> DataFrame:
    """conv_id, format, filename, mime_type, text, bytes, fallback: every asked file of every conversation in scope.

    Conversations without a message in scope have no rows. A raster is not drawn: where one is asked for, a text file
    stands in (``fallback``).
    """
    options = options or ExportOptions()
    ready = prepare_messages(messages, options)
    facts = prepare_reports(ready, reports if reports is not None else report(messages), options)
    heads = prepare_conversations(conversations, options)
    wanted = options.bundle() if "zip" in options.formats else options.formats
    none = F.lit(None)
    plain = lambda: render.markdown(heads, ready, facts, options.profile, options.include_metadata)
    makers = {
        "md": plain, "txt": lambda: render.plain_text(heads, ready, facts), "csv": lambda: render.csv(ready), "json": lambda: render.json_documents(heads, ready, facts),
        "html": lambda: render.html(heads, ready, facts), "png": lambda: render.plain_text(heads, ready, facts), "docx": lambda: docx(render.word_body(heads, ready, facts)), "pdf": lambda: pdf(_pdf_documents(heads, ready, facts, options.pdf), options.pdf),
    }
    out = None
    for fmt in wanted:
        made = makers[fmt]()
        text = F.col("text") if "text" in made.columns else none.cast("string")
        data = F.col("bytes") if "bytes" in made.columns else none.cast("binary")
        one = made.select("conv_id", F.lit(fmt).alias("format"), text.alias("text"), data.alias("bytes"), F.lit(fmt == "png").alias("fallback"))
        out = one if out is None else out.unionByName(one)
    if "zip" in options.formats:
        out = bundle(out).select("conv_id", F.lit("zip").alias("format"), none.cast("string").alias("text"), "bytes", F.lit(False).alias("fallback"))
    name = filename(options.template, F.col("exported_at"), F.col("platform"), F.col("title"), F.col("conversation_id"), F.when(F.col("fallback"), "txt").otherwise(F.col("format")))
    mime = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])[F.when(F.col("fallback"), "txt").otherwise(F.col("format"))]
    return out.join(heads, "conv_id").select("conv_id", "format", name.alias("filename"), mime.alias("mime_type"), "text", "bytes", "fallback")


def save(rendered: DataFrame, path: str) -> None:
    """Files as rows of Parquet, one folder per format: readable in part, safe to write again."""
    rendered.write.partitionBy("format").parquet(path)
