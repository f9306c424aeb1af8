"""Column expressions against small Python models, with nulls, empty and odd texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import filenames, images, text, urls
from millrace.functions.redaction import Redaction, redact

JS_SPACE = "\t\n\x0b\x0c\r  ﻿        　"


def column(spark, values, how):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", how(F.col("t")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def clean_model(s):
    out, blank = [], True
    for line in s.replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ").split("\n"):
        line = line.strip(JS_SPACE)
        if line.lower() in text.UI_LABELS:
            continue
        if line or not blank:
            out.append(line)
        blank = not line
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def hash_model(s):
    h = 0x811C9DC5
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x01000193 % (1 << 32)
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return "h" + digits.rjust(7, "0")


def phone_model(s):
    def one(m):
        n = len(re.sub(r"[^0-9]", "", m[2]))
        return m[0] if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", m[2]) or not 8 <= n <= 15 else m[1] + "[REDACTED_PHONE]"

    return re.sub(r"(^|[^A-Za-z0-9])(\+?[0-9][0-9 ().-]{7,}[0-9])(?![A-Za-z0-9])", one, s)


def test_clean_text_and_preview(spark):
    rng = random.Random(1)
    bits = ["a", " b", " ", "﻿", "\r\n", "\n", "\r", "\t", "Copy", "COPIED", "копировать код", "x ", "\x0b", "\n\n\n", " "]
    values = ["".join(rng.choices(bits, k=rng.randrange(0, 14))) for _ in range(400)] + ["", "copy", "a\ncopy\ncopy\nb", None]
    assert column(spark, values, text.clean_text) == [None if v is None else clean_model(v) for v in values]
    long = "word " * 60
    assert column(spark, [long, "a\n b"], text.text_preview) == [long[:159].rstrip() + "…", "a b"]
    assert column(spark, [long], text.short_preview) == [long[:160]]
    assert column(spark, ["x\r\ny  "], text.clean_code) == ["x\ny  "]


def test_stable_hash(spark):
    values = ["", "hello", "é", "漢字", "😀 astral 𝒳", "a" * 5000, None]
    assert column(spark, values, text.stable_hash) == [None if v is None else hash_model(v) for v in values]


@pytest.mark.parametrize("preset", ["basic", "strict"])
def test_redaction(spark, preset):
    hexes = "0123456789abcdef" * 2
    cases = {
        "mail éabc@x.com, A.b+c@d-e.org!": "mail é[REDACTED_EMAIL], [REDACTED_EMAIL]!",
        "call +1 (415) 555-0100 now": "call [REDACTED_PHONE] now",
        "on 2024-01-31 v1.2.3 id 12345": "on 2024-01-31 v1.2.3 id 12345",
        f"id {hexes}": "id [REDACTED_SECRET]" if preset == "strict" else f"id {hexes}",
        "Bearer abcdefghijklmnopqrstuvwx.": "Bearer [REDACTED_SECRET]." if preset == "strict" else "Bearer abcdefghijklmnopqrstuvwx.",
        "sk-proj-abcdefghijABCDEFGHIJ": "[REDACTED_SECRET]" if preset == "strict" else "sk-proj-abcdefghijABCDEFGHIJ",
        "": "",
        None: None,
    }
    assert column(spark, list(cases), lambda c: redact(c, Redaction.of(preset))) == list(cases.values())


def test_phones_against_model(spark):
    rng = random.Random(2)
    values = ["".join(rng.choices("0123456789 ().-+a_", weights=[4] * 10 + [2] * 8, k=rng.randrange(0, 60))) for _ in range(1500)]
    assert column(spark, values, lambda c: redact(c, Redaction(phones=True))) == [phone_model(v) for v in values]


def test_redaction_presets(spark):
    assert Redaction.of("nonsense").off and Redaction.of(None).off
    assert Redaction.legacy(True, emails=False).phones and Redaction.legacy(True, api_keys=False, bearer_tokens=False).secrets is False
    custom = Redaction.of("custom", ["  secret-\\d+ ", "(", "", "(?P<x>a)", "(?<y>[a-z&&[^b]]{3}0)\\k<y>"])
    assert column(spark, ["secret-12 a@b.cc cde0cde0"], lambda c: redact(c, custom)) == ["[REDACTED_SECRET] [REDACTED_EMAIL] [REDACTED_SECRET]"]


def test_images(spark):
    uri = "data:image/jpeg;base64,AAAA"
    got = column(spark, [f"x ![ alt ]({uri}) y", uri, "none", "", None], images.omit_payloads)
    assert got == [f'x Image omitted: embedded JPEG; alt "alt"; hash {hash_model(uri)} y', f"Image omitted: embedded JPEG; hash {hash_model(uri)}", "none", "", None]
    assert column(spark, ["https://a.b/c", "blob:x", "HTTP://q", None], images.is_safe_url) == [True, False, True, False]
    assert column(spark, ["image/jpeg", "image/PNG", "image/x", "x"], images.extension_of) == ["jpg", "png", "bin", "bin"]


def test_filenames(spark):
    name = lambda t: filenames.filename("{date}_{title}_{nope}.{format}", F.lit("2026-05-31T10:20:30.000Z"), F.lit("chatgpt"), t, F.lit("c"), F.lit("md"))
    assert column(spark, ["a/b: c?", "{format}", " ", None], name) == ["2026-05-31_a-b-c_{nope}.md", "2026-05-31_{format}_{nope}.md", "2026-05-31_untitled-conversation_{nope}.md", "2026-05-31_untitled-conversation_{nope}.md"]
    stamp = lambda t: filenames.filename("", t, F.lit("p"), F.lit("t"), F.lit("c"), F.lit("md"))
    assert column(spark, ["2026-05-31T10:20:30.000Z", "bad", None], stamp) == ["2026-05-31T10-20-30Z_p_t.md", "1970-01-01T00-00-00Z_p_t.md", "1970-01-01T00-00-00Z_p_t.md"]
    assert column(spark, ["..a..b.", "<>", ""], filenames.sanitize_name) == ["a-b", "untitled-conversation.md", "untitled-conversation.md"]
    parts = filenames.template_segments("{date}-{x}{title}")
    assert filenames.render_segments(parts) == "{date}-{x}{title}" and filenames.render_segments(filenames.move_segment(parts, 0, 2)) == "-{x}{title}{date}"


def test_urls(spark):
    values = ["https://ChatGPT.com/c/abc?x=1", "https://a.b/x/c/", "not a url", None, "https://a.b/c/1/c/2"]
    assert column(spark, values, urls.conversation_id) == ["abc", None, None, None, "1"]
    assert column(spark, values, urls.host)[:2] == ["chatgpt.com", "a.b"]
    assert column(spark, ["mailto:a", "javascript:x", "/rel", "https://x"], urls.is_safe_link) == [True, False, False, True]


def test_escapes(spark):
    assert column(spark, ['a"b', "a,b", "x\r\ny", "z", None], text.csv_field) == ['"a""b"', '"a,b"', '"x\ny"', "z", ""]
    assert column(spark, ['a"\\\n'], text.yaml_string) == ['"a\\"\\\\\\n"']
    assert column(spark, ["<a>\n```\n<b>\n```\n<c>", "<d>", None], text.html_outside_fences) == ["&lt;a&gt;\n```\n<b>\n```\n&lt;c&gt;", "&lt;d&gt;", None]
    assert column(spark, ["a`b", "````", ""], text.fence) == ["```", "`````", "```"]
    assert column(spark, [" Ünï Code! ", "", "a" * 80], text.slugify) == ["n-code", "untitled-chat", "a" * 72]
    assert column(spark, ["[a](b) `c` **d** *e*"], text.strip_inline_markdown) == ["a (b) c d e"]
    assert column(spark, [" a, b ,a,,"], text.split_tags) == [["a", "b"]]
    assert column(spark, ["#*`", "a _b_"], text.heading) == ["Untitled conversation", "a b"]
