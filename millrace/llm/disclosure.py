"""Personal data, and the words beside it that give it away.

Base: e-mail and IP addresses, card and phone numbers are found by their shape. These values are the protected entities,
and so is the domain of an address, which names an organisation.

Method (information-theoretic sanitisation): a word t within WINDOW words of an entity c reveals it as far as the corpus
says so. With n documents, n(c) that hold the entity, n(t) that hold the word and n(c, t) that hold it beside the
entity, ``log(n * n(c, t) / (n(c) * n(t)))`` is what t tells about c, and ``log(n / n(c))`` all there is to tell. Where
the quotient of the two reaches GENERALISE, the word's places beside the entity become spans of kind ``term``, which
``sanitise`` replaces by their class; from REMOVE on it takes them out. A word counts only if SUPPORT documents hold it
beside the entity, as fewer say nothing about a corpus.

Everything is counted over all documents; equal texts count as often as they occur. Work is linear in the text: a place
has at most 2 * WINDOW words beside it, and stands for two entities at most. Null and empty texts have no spans; repeated rows are returned each; an empty
table gives an empty result; other columns are ignored by ``detect`` and pass through ``sanitise``. Where ``doc_id`` is
null or repeated, rows still keep their own spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup_join, own_names, steps, tidy

KINDS = ("email", "ip", "card", "phone")
#: Words to either side of an entity that may reveal it, and in how many documents they must.
WINDOW, SUPPORT = 8, 3
#: Shares of what there is to tell about an entity from which on a word is generalised, or removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Distinct words a task counts before it hands them on.
COUNTED = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a match can only begin where one begins, and never ends inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_NOT_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """From every at sign with a domain after it back over what may stand before it: linear, whatever the text."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end, text[start:end].lower()


def _ips(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.start(), m.end(), ".".join(p or "0" for p in parts)


def _cards(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), digits


def _phones(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _PHONE.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 9 <= len(digits) <= 15:
            yield m.start(), m.end(), digits


_FINDERS = tuple(zip(KINDS, (_emails, _ips, _cards, _phones), ("@", ".", None, "+"), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of its kind, end, the value in one form) of the base, by start and then kind."""
    found = []
    for number, (_, finder, sign) in enumerate(_FINDERS):
        if sign is None or sign in text:
            found += [(a, number, b, value) for a, b, value in finder(text)]
    return sorted(found)


def entities(number: int, value: str) -> list[str]:
    """The protected entities that a base span stands for."""
    return [f"{KINDS[number]}:{value}", *([f"domain:{value.rpartition('@')[2]}"] if KINDS[number] == "email" else [])]


def contexts(text: str, spans: list[tuple[int, int, int, str]], window: int = WINDOW) -> dict[tuple[str, str], set[tuple[int, int]]]:
    """The places of each (entity, word) where the word stands within ``window`` words of the entity.

    A word that overlaps a base span is none; case does not tell words apart.
    """
    words, taken = [], 0  # ``taken``: the first span that may still overlap
    reach = 0
    for m in _TERM.finditer(text):
        while taken < len(spans) and spans[taken][0] < m.end():
            reach = max(reach, spans[taken][2])
            taken += 1
        if m.start() >= reach:
            words.append((m.start(), m.end(), m[0].lower()))
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    out = defaultdict(set)
    for a, number, b, value in spans:
        left, right = bisect_right(ends, a), bisect_left(starts, b)
        for start, end, word in words[max(0, left - window) : left] + words[right : right + window]:
            for entity in entities(number, value):
                out[entity, word].add((start, end))
    return out


#: Rows of the scan: a document, an entity that it holds, a word beside an entity, and how many documents hold a word.
_DOC, _ENTITY, _BESIDE, _WORD = range(4)


def _scan(key: str, kind: str, window: int):
    fields = f"what tinyint, {key} long, doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, entity string, word string, n long, places array<bigint>"
    names = [f.split()[0] for f in fields.split(", ")]

    @tidy
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, held = pa.int64(), Counter()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int8(), pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def counted() -> Iterator[pa.RecordBatch]:
            found = list(held.items())
            for at in range(0, len(found), 20_000):
                yield table([(_WORD, None, None, *[None] * 4, None, None, w, n, None) for w, n in found[at : at + 20_000]])
            held.clear()

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for piece in steps(batch, "text"):
                rows = []
                for k, doc_id, text in zip(piece.column(key).to_pylist(), piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    text = text or ""
                    held.update({w.lower() for w in set(_TERM.findall(text))})
                    spans = base_spans(text)
                    n = Counter(s[1] for s in spans)
                    rows.append((_DOC, k, doc_id, n[0], n[1], n[2], n[3], ",".join(f"{KINDS[i]}:{a}:{b}" for a, i, b, _ in spans), None, None, None, None))
                    rows += [(_ENTITY, k, None, *[None] * 4, None, e, None, None, None) for e in {e for _, i, _, v in spans for e in entities(i, v)}]
                    for (entity, word), places in contexts(text, spans, window).items() if spans else ():
                        rows.append((_BESIDE, k, None, *[None] * 4, None, entity, word, None, [x for p in sorted(places) for x in p]))
                yield table(rows)
                if len(held) >= COUNTED:
                    yield from counted()
        yield from counted()

    return scan, fields


def _disclosing(facts: DataFrame, total: int, support: int, least: float, scratch: Scratch) -> DataFrame:
    """entity, word, freq and share of the words that reveal an entity; ``freq`` is the number of documents with both."""
    pairs = facts.filter(F.col("what") == _BESIDE).groupBy("entity", "word").agg(F.count("*").alias("both")).filter(F.col("both") >= support)
    pairs = scratch.settle(pairs, "pairs")
    # A common word stands beside many entities, and a common entity beside many words: either may be a hot key.
    n, asked = pairs.count(), lambda by: pairs.groupBy(by).agg(F.count("*").alias("freq"))
    held = facts.filter(F.col("what") == _ENTITY).groupBy("entity").agg(F.count("*").alias("n_entity"))
    known = facts.filter(F.col("what") == _WORD).groupBy("word").agg(F.sum("n").alias("n_word"))
    pairs = lookup_join(pairs, held.join(asked("entity"), "entity"), "entity", n).drop("freq")
    pairs = lookup_join(pairs, known.join(asked("word"), "word"), "word", n).drop("freq")
    told = F.log(F.lit(float(total)) * F.col("both") / (F.col("n_entity") * F.col("n_word")))
    share = told / F.log(F.lit(float(total)) / F.col("n_entity"))
    return pairs.filter(F.col("n_entity") < total).select("entity", "word", F.col("both").alias("freq"), share.alias("share")).filter(F.col("share") >= least)


def _terms(docs: DataFrame, key: str, scratch: Scratch, window: int, support: int, least: float, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a row per document with its base, the places of revealing words per document: key, start, end, share); ``keep`` where they are read later."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = scratch.settle(docs.select(key, "doc_id", "text").mapInArrow(*_scan(key, kind, window)), "facts", keep)
    sizes = facts.agg(F.count_if(F.col("what") == _DOC).alias("docs"), F.count_if(F.col("what") == _BESIDE).alias("beside")).first()
    found = scratch.settle(_disclosing(facts, sizes["docs"], support, least, scratch), "disclosing", keep)
    beside = facts.filter(F.col("what") == _BESIDE).select("entity", "word", key, "places")
    met = lookup_join(beside, found, ["entity", "word"], max(1, sizes["beside"]))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("int(size(places) div 2 - 1)")), lambda i: F.struct(F.col("places")[2 * i].alias("start"), F.col("places")[2 * i + 1].alias("end")))
    places = met.select(key, F.explode(pairs).alias("p"), "share").select(key, "p.start", "p.end", "share").groupBy(key, "start", "end").agg(F.max("share").alias("share"))
    return facts.filter(F.col("what") == _DOC), places


def _parsed(spans: Column) -> Column:
    """Spans in text form as structs (start, number of the kind, end)."""
    number = lambda p: F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), p).cast("int")
    part = lambda s, i: F.split_part(s, F.lit(":"), F.lit(i))
    return F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.struct(part(s, 2).cast("long").alias("start"), number(part(s, 1)).alias("kind"), part(s, 3).cast("long").alias("end")))


def _with_terms(rows: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``spans``: base and term spans by start, then kind."""
    terms = places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS) + 1).alias("kind"), "end"))).alias("terms"))
    joined = rows.join(terms, key, "left")
    names = F.array(*map(F.lit, (*KINDS, "term")))
    both = F.array_sort(F.concat(_parsed(F.col("base")), F.col("terms")))
    text = F.array_join(F.transform(both, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")
    return joined.withColumn("spans", F.when(F.col("terms").isNull(), F.col("base")).otherwise(text))


def detect(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_terms of every document.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind (email, ip, card, phone, term).
    """
    (key,) = own_names(1)
    with Scratch(docs.sparkSession, "disclosure") as scratch:
        rows, places = _terms(docs.select("doc_id", "text").withColumn(key, F.monotonically_increasing_id()), key, scratch, window, support, least)
        out = _with_terms(rows, places, key)
        out = out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", F.when(F.col("terms").isNull(), 0).otherwise(F.size("terms")).cast("long").alias("n_terms"))
        return scratch.settle(out, "spans", keep=True)


def disclosing_words(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """entity, word, n_docs and share of the words that reveal an entity, for review."""
    (key,) = own_names(1)
    with Scratch(docs.sparkSession, "disclosure") as scratch:
        keyed = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").withColumn(key, F.monotonically_increasing_id())
        facts = scratch.settle(keyed.mapInArrow(*_scan(key, "bigint", window)), "facts")
        total = facts.filter(F.col("what") == _DOC).count()
        return scratch.settle(_disclosing(facts, total, support, least, scratch).withColumnRenamed("freq", "n_docs"), "words", keep=True)


def sanitise(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with ``text`` sanitised: base spans become ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``.

    A revealing word becomes its class (``[NUMBER]`` with a digit in it, ``[NAME]`` with a capital first, else
    ``[TERM]``), or nothing where it reaches ``remove``. Of overlapping spans the one that starts first is replaced
    and covers the rest of the others. A null text stays null.
    """
    key, edits = own_names(2)
    spark = docs.sparkSession
    with Scratch(spark, "sanitise") as scratch:
        keyed = scratch.settle(docs.withColumn(key, F.monotonically_increasing_id()), "docs", keep=True)  # a row's number is that of the file from here on
        rows, places = _terms(keyed.select(key, F.lit(None).cast("long").alias("doc_id"), "text"), key, scratch, window, support, generalise, keep=True)
        gone = places.groupBy(key).agg(F.collect_list(F.struct("start", F.lit(len(KINDS) + 1).alias("kind"), "end", (F.col("share") >= remove).alias("remove"))).alias("terms"))
        base = F.transform(_parsed(F.col("base")), lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit(False).alias("remove")))
        found = rows.filter("base != ''").join(gone, key, "left").select(key, F.array_sort(F.concat(base, F.coalesce("terms", F.filter(base, lambda _: F.lit(False))))).alias(edits))
        joined = keyed.join(found, key, "left")

        @tidy
        def replaced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in steps(batch, "text"):
                    texts = [t if not e else _edited(t, e) for t, e in zip(piece.column("text").to_pylist(), piece.column(edits).to_pylist(), strict=True)]
                    rest = [i for i, n in enumerate(piece.schema.names) if n != edits]
                    yield pa.record_batch([pa.array(texts, piece.schema.field("text").type) if piece.schema.names[i] == "text" else piece.column(i) for i in rest], [piece.schema.names[i] for i in rest])

        return joined.drop(key).mapInArrow(replaced, docs.schema)


def _edited(text: str, edits: list[dict]) -> str:
    parts, at = [], 0
    for e in edits:
        if e["end"] <= at:
            continue
        start = max(e["start"], at)
        parts.append(text[at:start])
        if e["start"] >= at and not e["remove"]:
            word = text[start : e["end"]]
            name = KINDS[e["kind"] - 1].upper() if e["kind"] <= len(KINDS) else "NUMBER" if any(c.isdigit() for c in word) else "NAME" if word[0].isupper() else "TERM"
            parts.append(f"[{name}]")
        at = e["end"]
    return "".join([*parts, text[at:]])

