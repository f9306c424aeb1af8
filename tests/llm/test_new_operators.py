"""Alignment of tokenizers, personal data and ball trees against plain versions; token ids and hashes of hostile texts."""

import bisect
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ball_tree, disclosure, near_dedup, text_hash, token_align, token_pack

from .test_operators import clash, got

DOCS = "doc_id long, text string"
ODD = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", "　", "é", "é", "ß", "İ", "Σ", "中", "😀", "▁", "'s", "'ll", "1", "23", ".", ",", "-", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "\x00", "\x01", "​", "﻿", "ﬁ", "½", "가", "א", "T̈"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(n)]


class PlainAligner:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(token_align._path(token_align.TOKENIZER_A))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=token_align._path(token_align.TOKENIZER_B))
        self.entries = {i: e for e, i in self.a.get_vocab().items()}
        self.of = token_align.byte_level()

    def piece(self, i):
        name = self.b.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", name)
        return bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()

    def links(self, text):
        """(n_a, n_b, n_groups, groups_sha256, linked id pairs)."""
        raw = f" {text}".encode()
        a, b = (self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(self.of[c] for c in self.entries[i]) for i in a], [self.piece(i) for i in b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return 0, 0, 0, "", []

        def spans(parts):
            ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
            return list(zip([0, *ends], ends, strict=False))

        of_a, of_b = spans(bytes_a), spans(bytes_b)
        cuts = sorted({e for _, e in of_a} & {e for _, e in of_b})
        groups = [([], []) for _ in cuts]
        for side, (ids, places) in enumerate(((a, of_a), (b, of_b))):
            for i, (_, end) in zip(ids, places, strict=True):
                groups[bisect.bisect_left(cuts, end)][side].append(str(i))
        pairs = [(i, j) for i, (s, e) in zip(a, of_a, strict=True) for j, (t, f) in zip(b, of_b, strict=True) if s < f and t < e]
        return len(a), len(b), len(cuts), hashlib.sha256(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups).encode()).hexdigest(), pairs


@pytest.mark.parametrize("bound", [token_align.BROADCAST_ROWS, 0])
def test_alignment(spark, monkeypatch, bound):
    monkeypatch.setattr(token_align, "BROADCAST_ROWS", bound)
    texts = [None, "", " ", "\n", "Hello, world!", "Hello, world!", "a▁b", "x" * 5000, *odd_texts(1, 150), *(r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.substring("text", 1, 400)).limit(40).collect())]
    rows = [(None if i == 7 else i % 190, t) for i, t in enumerate(texts)]
    plain = PlainAligner()
    found = [plain.links(t) for t in texts]
    held = collections.Counter(p for f in found for p in set(f[4]))
    best = collections.defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = [(d, *f[:3], len(f[4]), sum(held[p] == best[p[0]] for p in f[4]), sum(held[p] for p in f[4]), f[3]) for (d, _), f in zip(rows, found, strict=True)]
    have = token_align.alignment(clash(spark.createDataFrame(rows, DOCS).repartition(3), "pair", "freq", "times", "n_a"))
    assert have.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, have.collect()))) == sorted(map(repr, want))
    counts = token_align.links(spark.createDataFrame(rows, DOCS))
    assert {(r["id_a"], r["id_b"]): r["n_docs"] for r in counts.collect()} == dict(held)
    assert token_align.alignment(spark.createDataFrame([], DOCS)).count() == 0


def test_parts_are_aligned_as_whole_texts_are(monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 300)  # words are forgotten all the time
    paths = token_align._path(token_align.TOKENIZER_A), token_align._path(token_align.TOKENIZER_B)
    parts, whole = token_align.Aligner(*paths), token_align.Aligner(*paths)
    assert parts.by_parts
    whole.by_parts = False
    for seed in range(20):
        texts = odd_texts(seed, 100)
        of = []
        for own in (parts, whole):
            of.append([])
            for r in own.of_texts(texts):
                ok = own.facts[r, 3].all()
                of[-1].append((own.facts[r, :3].sum(axis=0).tolist(), b";".join(own.digests[k] for k in r), np.sort(own.pairs[token_align.ragged(own.begin[r], own.links[r])]).tolist()) if ok else None)
        assert of[0] == of[1] and any(of[0])


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def plain_base(text):
    out = []
    for number, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            value = {"email": m[0].lower(), "ip": ".".join(str(int(p)) for p in m[0].split(".")) if kind == "ip" else ""}.get(kind, digits)
            out.append((m.start(), number, m.end(), value))
    return sorted(out)


def test_base_spans_of_random_texts():
    rng = random.Random(4)
    parts = ["a", "b", ".", ".", "@", "@", "1", "23", "256", "0255", "+", "-", " ", "(", ")", "%", "4539 1488 0343 6467", "4539148803436467", "é", "\n", "+1 (555) 555-0100", "x.y@mail.example.com"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert disclosure.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 300_000, "+1" * 300_000, "@a.b" * 200_000, "1 " * 500_000])
def test_base_spans_take_linear_time(text):
    disclosure.base_spans(text)


def plain_disclosing(texts, window=disclosure.WINDOW, support=disclosure.SUPPORT, least=disclosure.GENERALISE):
    """{(entity, word): share}, and the places of each pair per text."""
    term = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
    n_word, n_entity, n_both, places = collections.Counter(), collections.Counter(), collections.Counter(), []
    for text in texts:
        text = text or ""
        n_word.update({m[0].lower() for m in term.finditer(text)})
        base, own = plain_base(text), collections.defaultdict(set)
        words = [m for m in term.finditer(text) if not any(m.start() < b and a < m.end() for a, _, b, _ in base)]
        held = set()
        for a, kind, b, value in base:
            names = [f"{disclosure.KINDS[kind]}:{value}", *([f"domain:{value.split('@')[1]}"] if kind == 0 else [])]
            held.update(names)
            for m in [m for m in words if m.end() <= a][-window:] + [m for m in words if m.start() >= b][:window]:
                for e in names:
                    own[e, m[0].lower()].add((m.start(), m.end()))
        n_entity.update(held)
        n_both.update(own.keys())
        places.append(own)
    n = len(texts)
    share = {(e, w): math.log(n * k / (n_entity[e] * n_word[w])) / math.log(n / n_entity[e]) for (e, w), k in n_both.items() if k >= support and n_entity[e] < n}
    return {p: s for p, s in share.items() if s >= least}, places


def private_texts():
    rng = random.Random(6)
    filler = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    out = [None, "", "no data here"]
    for i in range(120):
        out.append(f"{filler(20)} Call Zebulon’s desk {i} zebulon@corp.example +1 (555) 555-0100 {filler(12)}" if i % 6 == 0 else f"{filler(9)} user{i}@mail.example.org 10.0.0.{i} {filler(9)}" if i % 6 == 1 else filler(40))
    out += [out[3], out[3], "the zebulon alone", "4539148803436467, " * 3]
    return out


def test_disclosure(spark):
    texts = private_texts()
    rows = [(None if i == 9 else i, t) for i, t in enumerate(texts)]
    told, places = plain_disclosing(texts)
    want = []
    for (d, text), own in zip(rows, places, strict=True):
        base = plain_base(text or "")
        terms = {(a, len(disclosure.KINDS), b) for p, at in own.items() if p in told for a, b in at}
        names = (*disclosure.KINDS, "term")
        say = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        first = [s[:3] for s in base]
        count = collections.Counter(s[1] for s in base)
        want.append((d, *(count[k] for k in range(4)), hashlib.sha256(say(first).encode()).hexdigest(), say(sorted([*first, *terms])), len(terms)))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    have = disclosure.detect(clash(docs, "places", "word", "entity", "key", "base"))
    assert have.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms"]
    assert sorted(map(repr, map(tuple, have.collect()))) == sorted(map(repr, want))
    assert any(p[1] == "zebulon’s" for p in told) and not any(p[1].startswith("w") for p in told)
    found = {(r["entity"], r["word"]): r["share"] for r in disclosure.disclosing_words(docs).collect()}
    assert found == {p: pytest.approx(s) for p, s in told.items()}
    assert disclosure.detect(spark.createDataFrame([], DOCS)).count() == 0


def test_sanitise(spark):
    texts = private_texts()
    docs = clash(spark.createDataFrame(list(enumerate(texts)), DOCS), "base", "terms")
    have = disclosure.sanitise(docs, remove=2.0)
    by = {r["doc_id"]: r["text"] for r in have.collect()}
    assert have.columns == docs.columns and by[0] is None and by[2] == "no data here" and by[len(texts) - 2] == "the zebulon alone"
    assert "[EMAIL] [PHONE]" in by[3] and "[NAME]" in by[3] and "ebulon" not in by[3] and "[EMAIL] [IP]" in by[4]
    assert by[len(texts) - 1] == "[CARD], " * 3
    gone = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs, generalise=0.8, remove=0.8).collect()}
    assert "[NAME]" not in gone[3] and "ebulon" not in gone[3]


def plain_means(rows, k=ball_tree.CENTROIDS):
    kept = [(d, tuple(math.floor(256 * float(x)) for x in v)) for d, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = [list(v) for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda: [min(range(len(at)), key=lambda c: (far(v, at[c]), c)) for _, v in kept]  # noqa: E731, B023
    for _ in range(ball_tree.ROUNDS):
        to = nearest()
        for c in set(to):
            own = [v for (_, v), t in zip(kept, to, strict=True) if t == c]
            at[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = nearest()
    apart = [far(v, at[c]) for (_, v), c in zip(kept, to, strict=True)]
    of = collections.Counter()
    for c, d in zip(to, apart, strict=True):
        of[c] += d
    return [(d, c, x, of[c], sum(apart), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for (d, _), c, x in zip(kept, to, apart, strict=True)]


VECTORS = "vec_id long, embedding array<float>"


def vectors(n, spread):
    rng = np.random.default_rng(n)
    middle = rng.normal(size=(9, 64))
    rows = [(i, [float(x) for x in np.float32(middle[i % 9] + spread * rng.normal(size=64))]) for i in range(n)]
    one = rows[3][1]
    rows += [(n + i, one) for i in range(150)] + [(5, one), (None, one), (None, rows[4][1]), (n + 200, None), (n + 201, one[:63]), (n + 202, [*one[:63], None]), (n + 203, [*one[:63], float("nan")]), (n + 204, [*one[:63], float("-inf")]), (n + 205, []), (n + 206, [0.0] * 64)]
    return rows


@pytest.mark.parametrize(("n", "spread"), [(700, 0.01), (500, 1.0), (20, 0.5)])
def test_ball_tree(spark, monkeypatch, n, spread):
    monkeypatch.setattr(ball_tree, "TREE", 256)
    rows = vectors(n, spread)
    df = clash(spark.createDataFrame(rows, VECTORS).repartition(3), "cluster", "v", "n", "sums", "ids")
    have = ball_tree.cluster(df)
    assert have.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, map(tuple, have.collect()))) == sorted(map(repr, plain_means(rows)))
    assert ball_tree.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    huge = ball_tree.cluster(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], VECTORS), k=1)
    assert {r["distance"] for r in huge.collect()} == {64 * (1 << 28) ** 2, 0} or len(huge.collect()) == 2


def test_balls_go_whole_where_they_can():
    """Tight groups are settled at inner nodes, but for leaves with two of them, and with the same totals."""
    rng = np.random.default_rng(3)
    middle = rng.integers(-500, 500, (8, 64))
    points = (middle[rng.integers(0, 8, 4000)] + rng.integers(-2, 3, (4000, 64))).astype(np.int32)
    order, tree = ball_tree.grow(points)
    nodes, to, leaves, _ = ball_tree.descend(tree, middle)
    assert (tree.stop - tree.start)[leaves].sum() < 400 and (tree.stop - tree.start)[nodes].sum() > 3600 and len(nodes) < 80
    label = ball_tree.distances(points, middle).argmin(axis=1)
    assert (ball_tree.labels(tree, middle) == label[order]).all()
    count, sums = ball_tree.totals(tree, middle)
    assert (count == np.bincount(label, minlength=8)).all() and all((sums[c] == points[label == c].sum(axis=0)).all() for c in range(8))


def test_token_ids_of_random_texts():
    from tokenizers import Tokenizer

    path = token_pack.tokenizer_path()
    own, plain, rng = token_pack.WordEncoder(path), Tokenizer.from_file(path), random.Random(9)
    assert own.cuts
    marks = [chr(c) for c in (*range(0x300, 0x370), 0x1AB0, 0x1DC0, 0x20D0, 0x5B0, 0x64B, 0x93C, 0x3099)]
    letters = [*map(chr, range(65, 91)), *map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100)), *"İıǅΣσςſKÅﬁ中가각क"]
    other = [" ", "  ", "\n", "\x85", " ", "\x01", "\x1c", "1", "²", "_", "🙂", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = ["TARİHİ, DENİZLİ.", "T̈ H̱ W̊ Y̊ J̌", "J̌."]
    texts += ["".join(rng.choice(rng.choice([marks, letters, letters, other, signs])) for _ in range(rng.randrange(14))) for _ in range(50_000)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert [x.tolist() for x in own.encode(some)] == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]


def test_texts_made_to_collide_stay_apart(spark):
    """The Thue-Morse sequence and its complement have one polynomial hash modulo 2**64, whatever its base."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    a, b = ("".join(s[t] for t in bits) for s in ("ab", "ba"))
    ends, data = (np.array([0]), np.array([1024])), [np.frombuffer(t.encode(), np.uint8) for t in (a, b)]
    assert len({text_hash.ranges(text_hash.prefix(d), *ends)[0] for d in data}) == 1
    assert len({text_hash.prime_ranges(text_hash.prime_prefix(d), *ends)[0] for d in data}) == 2
    have = near_dedup.cluster(spark.createDataFrame([(1, a), (2, b), (3, a)], DOCS))
    assert got(have, "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]


def test_second_hash_is_a_polynomial_modulo_a_prime():
    rng = random.Random(2)
    data = np.frombuffer(rng.randbytes(700) * 2, np.uint8)
    sums = text_hash.prime_prefix(data)
    for k, base in enumerate(text_hash._PRIME_BASES):
        assert int(sums[k, -1]) % text_hash.PRIME == sum(int(text_hash.PRIME_BYTES[k][x]) * pow(base, i, text_hash.PRIME) for i, x in enumerate(data)) % text_hash.PRIME
    h = text_hash.prime_ranges(sums, np.array([0, 700, 1, 701]), np.array([700, 1400, 701, 1400]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3
    assert (text_hash._reduced(np.array([0, text_hash.PRIME - 1, text_hash.PRIME, 2**62, 2**64 - 1], np.uint64)) == [x % text_hash.PRIME for x in (0, text_hash.PRIME - 1, text_hash.PRIME, 2**62, 2**64 - 1)]).all()
