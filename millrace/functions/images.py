"""Embedded images: payloads leave the text, a short description with a hash stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, blank_to_null, let, replace_each, stable_hash

OMITTED = "embedded_image_omitted"
_URI = rf"data:image/[a-z0-9.+-]+;base64,[a-z0-9+/={WS}]+"
DATA_IMAGE = rf"(?i){_URI}"
MARKDOWN_DATA_IMAGE = rf"(?i)!\[[^\]\n]*\]\({_URI}\)"
_SAFE_URL = r"(?i)\A[\x00-\x20]*https?:[/\\]*[^/\\?#\s]"


def is_safe_url(c: Column) -> Column:
    """An absolute http or https address."""
    return F.coalesce(c.rlike(_SAFE_URL), F.lit(False))


def mime_of(uri: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(uri, r"(?i)\Adata:(image/[a-z0-9.+-]+);base64,", 1)), F.lit("")), F.lit("image/unknown"))


def label_of(mime: Column) -> Column:
    sub = F.lower(F.try_element_at(F.split(mime, "/"), F.lit(2)))
    return F.when(sub.isin("jpeg", "jpg"), "JPEG").when(sub.isNull() | sub.isin("", "unknown"), "image").otherwise(F.upper(sub))


def extension_of(mime: Column) -> Column:
    sub = F.lower(F.try_element_at(F.split(mime, "/"), F.lit(2)))
    return F.when(sub == "jpeg", "jpg").when(sub.isin("png", "gif", "webp", "jpg"), sub).otherwise("bin")


def dimensions(width: Column, height: Column) -> Column:
    """``WxH``, or an empty string where either is missing."""
    return F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit(""))


def _described(label: Column, alt: Column, size: Column, digest: Column) -> Column:
    quoted = F.concat(F.lit('alt "'), blank_to_null(alt), F.lit('"'))
    return F.concat_ws("; ", F.concat(F.lit("Image omitted: embedded "), label), quoted, F.nullif(size, F.lit("")), F.concat(F.lit("hash "), digest))


def omit_payloads(c: Column) -> Column:
    """Data images of a text, in Markdown or bare, replaced by their description."""
    none = F.lit(None).cast("string")

    def bare(uri: Column, alt: Column = none) -> Column:
        return _described(let(mime_of(uri), label_of), alt, F.lit(""), stable_hash(uri))

    def marked(found: Column) -> Column:
        return bare(F.regexp_extract(found, r"(?s)\]\((.*)\)\z", 1), F.regexp_extract(found, r"\A!\[([^\]\n]*)\]", 1))

    return replace_each(replace_each(c, MARKDOWN_DATA_IMAGE, marked), DATA_IMAGE, bare)


def image_text(image: Column) -> Column:
    """An image of a message as text."""
    size = dimensions(image["width"], image["height"])
    embedded = _described(
        F.when(image["dataUri"].isNotNull(), label_of(mime_of(image["dataUri"]))).otherwise(label_of(image["mimeType"])),
        image["alt"],
        size,
        F.when(image["dataUri"].isNotNull(), stable_hash(image["dataUri"])).otherwise(image["hash"]),
    )
    source = F.coalesce(image["src"], image["localFilename"])
    local = F.concat_ws("; ", F.lit("Image omitted: local browser image reference"), F.concat(F.lit('alt "'), image["alt"], F.lit('"')), F.nullif(size, F.lit("")))
    named = F.concat(F.coalesce(blank_to_null(image["alt"]), F.lit("Image")), size)
    gone = F.coalesce(image["omittedReason"] == OMITTED, F.lit(False)) | image["dataUri"].isNotNull()
    return F.when(gone, embedded).when(source.isNull() | is_safe_url(source), named).otherwise(local)


def strip_payload(image: Column) -> Column:
    """An image struct whose data is replaced by its hash, type and the reason."""
    has = image["dataUri"].isNotNull()
    none = F.lit(None).cast("string")
    mime = mime_of(image["dataUri"])
    return F.struct(
        image["alt"].alias("alt"),
        F.when(~has, image["src"]).alias("src"),
        none.alias("dataUri"),
        F.when(~has, image["localFilename"]).alias("localFilename"),
        F.when(has, F.lit(OMITTED)).otherwise(image["omittedReason"]).alias("omittedReason"),
        F.when(has, mime).otherwise(image["mimeType"]).alias("mimeType"),
        F.when(has, stable_hash(image["dataUri"])).otherwise(image["hash"]).alias("hash"),
        image["width"].alias("width"),
        image["height"].alias("height"),
    )


def assets(messages):
    """Distinct embedded images of a ``messages`` table, first of each hash per conversation, decoded.

    Payloads that are no base64 are skipped. Columns: conv_id, hash, filename, mime_type, alt, width, height, bytes.
    """
    each = messages.select("conv_id", "idx", F.posexplode("images").alias("at", "image")).filter("image.dataUri is not null")
    uri = F.col("image.dataUri")
    coded = F.regexp_replace(F.regexp_extract(uri, r"(?i)\Adata:image/[a-z0-9.+-]+;base64,([\s\S]+)\z", 1), f"[{WS}]+", "")
    rows = each.select(
        "conv_id", "idx", "at", stable_hash(uri).alias("hash"), mime_of(uri).alias("mime_type"), "image.alt", "image.width", "image.height",
        F.try_to_binary(F.nullif(coded, F.lit("")), F.lit("base64")).alias("bytes"),
    ).filter("bytes is not null")
    first = rows.groupBy("conv_id", "hash").agg(F.min_by(F.struct("mime_type", "alt", "width", "height", "bytes"), F.struct("idx", "at")).alias("first"))
    name = F.concat(F.lit("assets/"), F.col("hash"), F.lit("."), extension_of(F.col("first.mime_type")))
    return first.select("conv_id", "hash", name.alias("filename"), "first.*")
