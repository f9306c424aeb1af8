"""Each operator against its plain version, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import budget_mix, decontaminate, html_wrapper, line_quality, near_dedup, repeated_spans, sharding, text_hash, token_pack, toxicity, url_filter
from millrace.llm import queries as Q

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = words_of(rng, 200)
    out = [(0, None, "s0"), (1, "", "s0"), (2, " \n\t ", None), (3, "One two", "s1"), (4, "ONE\ttwo", "s1"), (5, base, "s0"), (6, base, "s0")]
    for i in range(7, 40):  # near copies of all degrees, some of them each other's only
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        out.append((i, " ".join(w), f"s{i % 4}"))
    out += [(i, words_of(rng, rng.randrange(1, 120)), None if i % 7 == 0 else f"s{i % 4}") for i in range(40, 60)]
    long = words_of(rng, 30_000, 5000)
    out += [(60, long, "s2"), (61, long[1000:], "s2"), (62, "aaaa" * 2000, "s3"), (63, "é" * 900 + words_of(rng, 90), "s3"), (64, "x" * 399, "s1"), (65, "x" * 399, "s1")]
    out += [(66, f"top {i} line\n" * 3 + "shared line of the host\n" + words_of(rng, 60), "s9") for i in range(1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS).repartition(5)


def clash(docs, *names):
    """Extra columns whose names the operators use themselves."""
    return docs.withColumns({n: F.lit("x") for n in names})


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hashes_of_equal_ranges_agree():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = text_hash.ranges(text_hash.prefix(data), np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_near_dedup_finds_every_link(docs, rows):
    want = brute.near([(d, t) for d, t, _ in rows])
    have = near_dedup.cluster(clash(docs, "cid", "sig", "token", "label", "n", "rep"))
    assert got(have, "doc_id", "n_shingles", "component_id", "kept") == sorted((d, n, c, c == d) for d, (n, c) in want.items())


def test_near_dedup_on_the_given_table(spark):
    want = brute.near([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
    assert got(Q.op9_near_dedup(spark, SF), "doc_id", "n_shingles", "component_id") == sorted((d, n, c) for d, (n, c) in want.items())


def test_near_dedup_star_of_far_copies(spark):
    """Copies that link to one hub only, and a chain that no hub reaches."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        w = list(base)
        for i in rng.sample(range(5, 145), 2):
            w[i] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(100)]
    for k in range(30):
        texts.append(" ".join(chain[: 100 - k] + [f"d{i}" for i in range(k)]))
    docs = [(i, t) for i, t in enumerate([*texts, " ".join(base)])]
    have = near_dedup.cluster(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got(have, "doc_id", "n_shingles", "component_id") == sorted((d, n, c) for d, (n, c) in brute.near(docs).items())


def test_keep_one(docs, rows):
    kept = got(near_dedup.keep_one(docs), "doc_id")
    assert kept == sorted((d,) for d, (_, c) in brute.near([(d, t) for d, t, _ in rows]).items() if c == d)
    twice = near_dedup.keep_one(docs.union(docs))
    assert got(twice, "doc_id") == kept and twice.columns == docs.columns


@pytest.mark.parametrize("length", [400, 30])
def test_repeated_spans(spark, docs, rows, length):
    some = [(d, t) for d, t, _ in rows if len(t or "") < 40_000]
    df = docs.filter(F.length(F.coalesce("text", F.lit(""))) < 40_000)
    have = repeated_spans.digest(clash(df, "rid", "key", "units", "low", "high"), length)
    assert got(have, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(some, length))


def test_repeated_spans_with_variants_of_one_passage(spark):
    """Ends of matches that differ by a byte, overlaps within a document, repeated rows and a null id."""
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = []
    for i in range(60):
        a = rng.randrange(0, 2500)
        b = a + rng.randrange(395, 480) if i % 2 else rng.randrange(a + 1, 3000)
        pad = lambda: "".join(rng.choice("stuvwxyz") for _ in range(rng.randrange(0, 90)))
        rows.append((i, pad() + text[a:b] + pad() + (text[a : a + 410] if i % 5 == 0 else "")))
    rows += [(7, rows[7][1]), (None, "n" * 500), (None, "m" * 100)]
    have = repeated_spans.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in have.collect()], key=key) == sorted(brute.repeats(rows), key=key)


def test_passages_of_over_fifty_words_are_told(spark):
    """Strings of more than 50 words that another document holds, though shorter than what is removed."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    text = lambda n: " ".join(word(5) for _ in range(n))
    own = [text(51), text(55), text(50), text(40), text(90)]  # 305, 329, 299, 239 and 539 bytes
    rows = []
    for k, passage in enumerate(own):
        for j in range(3):
            rows.append((10 * k + j, f"{text(30 + j)} {passage} {text(20 + j)}"))
    rows += [(60, text(200)), (61, text(200)), (62, text(60) + " ! " + (twin := text(52)) + " ? " + twin), (63, None), (64, own[0])]
    have = {r["doc_id"]: r for r in repeated_spans.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, r in have.items() if r["has_passage"]} == {0, 1, 2, 10, 11, 12, 40, 41, 42, 64}
    assert {d for d, r in have.items() if r["n_removed"]} == {40, 41, 42}


def test_repeated_spans_count_few_rows(spark, monkeypatch):
    """Rows that are written on the way, per byte of text: most of the work is counting and joining them."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(5000)) for _ in range(40)]
    settle, rows = repeated_spans.Scratch.settle, []

    def counted(self, df, name, keep=False):
        back = settle(self, df, name, keep)
        rows.append(back.count())
        return back

    monkeypatch.setattr(repeated_spans.Scratch, "settle", counted)
    for docs, bytes_per_row in ((texts, 60), ([t for t in texts[:10] for _ in range(4)], 20)):
        rows.clear()
        have = repeated_spans.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
        assert {r["n_removed"] for r in have.collect()} == {0 if docs is texts else 5000}
        assert sum(rows) < sum(map(len, docs)) / bytes_per_row


def test_windows_are_parsed_alike_wherever_they_stand():
    """Each window belongs to one phrase end, at the same place in equal windows, also in texts that repeat themselves."""
    import pyarrow as pa

    rng = random.Random(9)
    some = "".join(rng.choice("ab") for _ in range(90))
    texts = ["", some, "zz" + some[20:] + "y", "a" * 80, "ab" * 30 + "c" + "ab" * 30, "x" * 9, some[:40] * 2, "", "aab" * 25]
    for length in (1, 2, 10, 40):
        found = repeated_spans.Texts(pa.array(["left out", *texts])[1:])
        row, low, high, at = repeated_spans.phrases(found, length)
        place, seen = {}, 0
        for r, a, b, c in zip(*(x.tolist() for x in (row, low, high, at)), strict=True):
            for w in range(a, b + 1):
                window = found.data[w : w + length].tobytes()
                seen += 1
                assert found.start[r] <= w and w + length <= found.end[r] and place.setdefault(window, c - w) == c - w
        assert seen == sum(max(len(t) - length + 1, 0) for t in texts)


def test_repeated_spans_on_the_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(Q.op6_repeated_spans(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(docs))


def test_line_quality_base_counts(docs, rows):
    have = line_quality.judge(clash(docs, "th", "w", "h", "pos", "lines"))
    want = sorted((d, *brute.base_rules(t)) for d, t, _ in rows)
    assert got(have, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


def test_line_quality_compares_the_words_of_equal_hashes(spark, docs, rows, monkeypatch):
    some = [(d, t) for d, t, _ in rows if len(t or "") < 3000]
    for clash in (lambda *w: F.length(w[0]).cast("long"), lambda *w: F.lit(1 << 40)):  # noqa: PLW0640
        monkeypatch.setattr(line_quality, "window_hash", clash)
        have = line_quality.judge(docs.filter("coalesce(length(text), 0) < 3000"))
        assert got(have, "doc_id", "n_repeat_words") == sorted((d, brute.base_rules(t)[4]) for d, t in some)


def test_line_quality_on_the_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    gone = brute.removed_words(docs, 2)
    want = []
    for d, t, _ in docs:
        own = brute.base_rules(t)
        want.append((d, *own[:5], gone[d], own[5], not own[5] and own[0] - gone[d] >= 0.5 * own[0]))
    assert sum(gone.values()) and got(line_quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), min_docs=2), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept") == sorted(want)


def test_line_quality_of_long_texts(spark):
    rng = random.Random(3)
    text = words_of(rng, 70_000, 60)
    have = line_quality.judge(spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string"))
    assert got(have, "n_words", "n_repeat_words") == [(brute.base_rules(text)[0], brute.base_rules(text)[4])]


def test_line_quality_removes_frequent_lines_per_host(spark):
    rng = random.Random(5)
    rows = [(i, "Shared  LINE 12 of this host and its friends\n" + words_of(rng, 60), "a" if i < 12 else None) for i in range(24)]
    rows += [(i, words_of(rng, 20) + "\n" + "\n".join(["shared line 34 of this host and its friends"] * 9), None) for i in range(24, 26)]
    rows += [rows[-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    have = {r["doc_id"]: r for r in line_quality.judge(df, min_docs=12).collect()}
    assert have[0]["n_removed_words"] == 9 and have[0]["kept"] and have[20]["n_removed_words"] == 9
    assert have[25]["n_removed_words"] == 81 and not have[25]["kept"]
    assert line_quality.judge(df, min_docs=30).filter("n_removed_words > 0").count() == 0
    cleaned = {r["doc_id"]: r["text"] for r in line_quality.clean(df, min_docs=12).collect()}
    assert "hared" not in cleaned[0] and cleaned[0] == rows[0][1].split("\n")[1] and len(cleaned) == 26


def test_line_quality_judges_a_line_alike_in_any_host(spark):
    """Ten documents with a line are enough in a host of 6,000 as in one of ten."""
    own = lambda i: "own " + "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, f"the shared line\n{own(i)}" if i < 10 else own(i), "large") for i in range(6000)]
    rows += [(i, f"the shared line\n{own(i)}", "small") for i in range(6000, 6010)]
    have = line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got(have.filter("n_removed_words > 0"), "doc_id", "n_removed_words") == [(i, 3) for i in (*range(10), *range(6000, 6010))]


def test_token_pack_round_trip(spark, docs, rows, tmp_path):
    path = token_pack.tokenizer_path()
    odd = docs.union(docs.filter("doc_id in (3, 5)")).unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    given = [(d, t) for d, t, _ in rows] + [(d, t) for d, t, _ in rows if d in (3, 5)] + [(None, rows[4][1])]
    have = token_pack.round_trip(clash(odd, "part", "block", "start"))
    key = lambda r: (r[1],)
    assert sorted([tuple(r) for r in have.select("doc_id", "start", "n_tokens", "ids_crc32").collect()], key=key) == brute.tokens(given, path)
    token_pack.write(docs, str(tmp_path / "t"), block_tokens=500)
    own = token_pack.WordEncoder(path).encode([rows[5][1]])[0]
    assert np.array_equal(token_pack.tokens_of(spark, str(tmp_path / "t"), 5)[0], np.append(own, 1))


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_packing_is_exact_at_any_offset(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000, np.uint64)
    packed = token_pack.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    for start, n in ((0, 1000), (1, 1), (333, 500), (999, 1), (5, 0)):
        assert np.array_equal(token_pack.unpack(packed, bits, start, n), ids[start : start + n])


def test_tokens_of_texts_with_special_strings():
    from tokenizers import Tokenizer

    path = token_pack.tokenizer_path()
    texts = ["WORD, word. (Word) it's IT'S 'stop o'clock... a=\u0338b x,\u0327y e\u0301! \u01c5; don't've", "A<|ENDOFTEXT|>B, c<|startoftext|>.", "\u03a3'A ab.\u03a3 \u039f\u03a3, x", "a<|endoftext|>b it's\r\x0bDON'T\u00a0x\u2003y  \u0301z 12ab Σίσυφος ΟΔΟΣ", "\x1cq\x85r", "日本語 text, ends."]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in token_pack.WordEncoder(path).encode(texts)] == want


def test_budget_mix(docs, rows):
    have = budget_mix.mix(clash(docs, "size", "draw", "bucket", "copies"))
    again = budget_mix.mix(docs.repartition(2))
    cols = ("doc_id", "size", "source_size", "target", "taken")
    assert got(have, *cols) == got(again, *cols)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = brute.fill_level(sizes)
    taken: dict = {}
    for r in have.collect():
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    longest = {s: max(len(brute.WORD.findall(t or "")) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= max(1, longest[s] / 2) for s in sizes)


def test_targets_of_many_sources(spark):
    """Sources ranked over many partitions, with ties, capped ones and a null one."""
    from millrace.llm.common import Scratch

    rng = random.Random(21)
    sizes = {f"s{i:03d}": rng.choice([3, 7, 50, 900, 100_000]) for i in range(400)} | {None: 12, "": 5, "é": 8}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        with Scratch(spark, "test") as scratch:
            have = {r["source"]: r["target"] for r in budget_mix.targets(table, scratch).collect()}
    finally:
        spark.conf.unset(key)
    assert have == pytest.approx(brute.fill_level(sizes))


def test_fit_counts_is_a_best_subset_sum():
    rng = random.Random(9)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randrange(1, 5))
        counts = [rng.randrange(1, 4) for _ in lengths]
        budget = rng.randrange(0, sum(a * b for a, b in zip(lengths, counts, strict=True)) + 1)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = budget_mix.fit_counts(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert abs(sum(n * t for n, t in zip(lengths, take, strict=True)) - budget) == min(abs(s - budget) for s in sums)
    lengths, counts = list(range(3, 2000, 7)), [50 + i % 9 for i in range(286)]
    take = budget_mix.fit_counts(lengths, counts, 9_876_543)
    assert sum(n * t for n, t in zip(lengths, take, strict=True)) == 9_876_543


def test_mixed_corpus_repeats_rows(docs):
    mixed = budget_mix.apply(docs)
    assert mixed.columns == docs.columns
    want = {r["doc_id"]: r["taken"] // r["size"] for r in budget_mix.mix(docs).filter("taken > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    doubled = docs.union(docs)
    total = budget_mix.mix(doubled).agg(F.sum("taken")).first()[0]
    assert budget_mix.sized(budget_mix.apply(doubled)).agg(F.sum("size")).first()[0] == total


def test_sharding_moves_few_keys(spark):
    keys = spark.range(4000).withColumn("slot", F.lit(-1))
    names = [f"n{i}" for i in range(20)]
    before = {r["id"]: r["shard"] for r in sharding.place(keys, "id", names, 2003).collect()}
    after = {r["id"]: r["shard"] for r in sharding.place(keys, "id", names[:-1], 2003).collect()}
    moved = [k for k in before if before[k] != after[k] and before[k] != "n19"]
    assert len(moved) < 0.1 * 4000 and set(after.values()) == set(names[:-1])
    table = sharding.fill(names, 2003)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    assert sharding.place(spark.createDataFrame([(None,), (None,)], "id string"), "id").select("shard").distinct().count() == 1


def test_url_parts_rules_and_reputation(spark):
    rows = [
        (1, "https://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
        (3, "http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        (4, "http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        (5, None, "", "", None, "allow"),
        (6, "no-scheme/en/", "", "", None, "allow"),
        (7, "a://b?x://c/d", "b", "", None, "allow"),
        (8, "s://h.org\n/es/x\n?y", "h.org\n", "/es/x\n", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u) for i, u, *_ in rows], "page_id long, url string").withColumn("host", F.lit("clash"))
    have = url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad int"))
    assert sorted(tuple(r)[:5] for r in have.collect()) == [(i, h, p, r, v) for i, _, h, p, r, v in rows]
    many = [(i, f"http://bad.site.info/{i}") for i in range(60)] + [(100 + i, f"http://good.page.info/{i}") for i in range(60)] + [(300, "http://new.site.info/")]
    outcomes = [(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(50)] + [(101, None)]
    judged = url_filter.judge(spark.createDataFrame(many, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"))
    verdict = {r["host"]: r["verdict"] for r in judged.collect()}
    assert verdict["bad.site.info"] == "block" and verdict["good.page.info"] == "allow"


def test_url_posteriors(spark):
    rng = random.Random(15)
    hosts = ["a.x.com", "b.x.com", "x.com", "c.y.co.uk", "y.co.uk", "d.z.org", "z.org", "e.w.com", "lone"]
    rate = {h: rng.random() ** 2 for h in hosts}
    pages = [(i, f"http://{h}/{i}") for i, h in enumerate(rng.choice(hosts) for _ in range(600))] + [(600, None), (601, "http://new.x.com/")]
    outcomes = [(i, int(rng.random() < rate[u.split("/")[2]])) for i, u in pages[:500] if u] + [(3, 1), (4, None), (9999, 1)]
    two = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: two(h) if two(h) in url_filter.TWO_LABEL_SUFFIXES else h.split(".")[-1]
    domain = lambda h: ".".join(h.split(".")[-3:]) if two(h) in url_filter.TWO_LABEL_SUFFIXES else two(h)
    want = brute.reputation(pages, outcomes, suffix, domain, lambda u: u.split("/")[2] if u else "")
    have = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), rules=())
    for r in have.collect():
        mean, lower = want[r["host"]]
        assert r["bad_rate"] == pytest.approx(mean, abs=1e-6) and r["verdict"] == ("block" if lower > url_filter.CUTOFF else "allow")
    assert {r["verdict"] for r in have.collect()} == {"allow", "block"}


def test_toxicity_catches_unseen_misspellings(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(700):
        w = words_of(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(["moronic", "morons", "moron", "disgusting", "disgustingly"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, words_of(rng, 30) + " moronnic " + words_of(rng, 9)), (1001, words_of(rng, 40)), (1002, None), (1003, ""), (1004, "disgusteng")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(1))
    have = {r["doc_id"]: r for r in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [have[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004)] == [1, 0, 0, 0, 1]
    out = [have[i] for i, *_ in labels if have[i]["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out)
    assert 0.1 < len(out) / 700 < 0.3 and right >= 0.98 * len(out)
    kept = toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in have.items() if not r["predicted"]}


def test_toxicity_without_labels(spark, docs):
    have = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert have.count() == docs.count() and have.filter("predicted = 1").count() == 0


def test_decontaminate_catches_copies_and_new_parameters(spark):
    item = "When Alice bought 12 kg of apples from Bob for 30 dollars, how many apples did Alice give back to Bob after 12 days?"
    changed = item.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "7").replace("30", "55")
    mixed = item.replace("Alice", "Carol", 1).replace("Bob", "Dave")
    items = [(1, item), (2, None), (3, "two words"), (4, "a plain short item without any slot"), (5, item)]
    docs = [(1, "Before. " + item + " After it."), (2, "Some text, and then: " + changed + " The end."), (3, "So: " + mixed), (4, None), (5, ""), (6, "x a PLAIN short item, without any slot y"), (7, "nothing at all like the others here, not a word of it"), (8, item[:60])]
    have = decontaminate.matches(spark.createDataFrame(docs + docs[:1], "doc_id long, text string").withColumn("size", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert got(have, "doc_id", "item_id", "exact") == [(1, 1, True), (1, 5, True), (2, 1, False), (2, 5, False), (6, 4, True)]
    kept = decontaminate.keep_clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(kept, "doc_id") == [(3,), (4,), (5,), (7,), (8,)]


def test_decontaminate_follows_slots_of_other_lengths(spark):
    """Slots that change their number of words, with less than 13 words at each side, and items that are nearly all slots."""
    item = "When the baker Anna sold a box of rolls to the shop in Paris for 25 euros, what did the shop pay her for one of them?"
    changed = item.replace("Anna", "Mary Ann").replace("Paris", "New York").replace("25", "twenty five")
    hyphen = item.replace("25", "twenty-five").replace("Paris", "New York")
    cut = "the baker sold a large box to the shop for 25 very old silver coins of that town last week"
    longer = cut.replace("25", "a heap and 25")
    numbers = "12 7 99 1 4 55 6 81 23 17 3 9"
    items = [(1, item), (2, numbers), (3, cut)]
    docs = [(1, "So: " + changed + " The end."), (2, "So: " + hyphen), (3, "see " + numbers + " there"), (4, "see " + numbers.replace("55", "56") + " there"), (5, "So " + longer + " again"), (6, item.replace("Anna", "Mary Ann") + " x " + item)]
    have = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(have, "doc_id", "item_id") == [(1, 1), (2, 1), (3, 2), (5, 3), (6, 1)]


def test_decontaminate_of_very_long_texts(spark):
    """Words, sentences and windows that lie across the pieces in which a text is read."""
    rng = random.Random(17)
    item = "When the baker Anna sold a box of rolls to the shop in Paris for 25 euros, what did the shop pay her for one of them?"
    filler = " ".join(f"{'W' if rng.random() < 0.1 else 'w'}{rng.randrange(999)}{rng.choice(['', '.', ','])}" for _ in range(150_000))
    docs = [(1, filler[:k] + " " + item + " " + filler[k:]) for k in (decontaminate.PIECE - 60,)] + [(2, filler), (3, filler + item), (4, "x" * 700_000 + " " + item)]
    have = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert got(have, "doc_id", "item_id") == [(1, 9), (3, 9), (4, 9)]
    whole = decontaminate.template([filler.encode()])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontaminate, "PIECE", 1000)
        assert all(np.array_equal(a, b) for a, b in zip(vars(whole).values(), vars(decontaminate.template([filler.encode()])).values(), strict=True))


def test_toxicity_scores_as_defined():
    """Every n-gram hashed by itself, windows of three words, the highest window."""
    rng = random.Random(19)
    model = toxicity.Model(np.random.default_rng(4).normal(size=toxicity.BUCKETS), -0.3)

    def plain(text):
        best, found = None, text.split()
        for i in range(0, len(found), 3):
            total, n = 0.0, 0
            for w in found[i : i + 3]:
                marked = b"<" + w.lower() + b">"
                for g in toxicity.GRAMS:
                    for at in range(len(marked) - g + 1):
                        h = text_hash.ranges(text_hash.prefix(np.frombuffer(marked[at : at + g], np.uint8)), np.array([0]), np.array([g]))[0]
                        total, n = total + model.weight[int(h) >> (64 - toxicity.BUCKETS.bit_length() + 1)], n + 1
            logit = total / max(n, 48) + model.bias
            best = logit if best is None else max(best, logit)
        return 1 / (1 + np.exp(-(min(model.bias, -1.0) if best is None else best)))

    texts = [words_of(rng, n).encode() for n in (1, 2, 3, 7, 20)] + [b"", b" \t", "Ünïcode ÀB c\u0301 a".encode(), b"A bb CCC dddd"]
    assert model.scores(texts) == pytest.approx([plain(t) for t in texts])


def test_toxicity_of_very_long_texts():
    model = toxicity.Model(np.random.default_rng(3).normal(size=toxicity.BUCKETS), 0.2)
    rng = random.Random(18)
    text = words_of(rng, 90_000, 5000).encode()
    w = text.split()
    thirds = [b" ".join(w[at : at + 30_000]) for at in range(0, 90_000, 30_000)]
    assert model.scores([text])[0] == pytest.approx(max(model.scores(thirds)))
    alone = np.concatenate([model.scores([t]) for t in (*thirds, b"", b" a  b ")])
    assert model.scores([*thirds, b"", b" a  b "]) == pytest.approx(alone)


def test_decontaminate_in_several_scans(spark, monkeypatch):
    whole = got(Q.op5_decontaminate(spark, SF), "doc_id", "item_id", "n_windows")
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 1000)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert whole and got(Q.op5_decontaminate(spark, SF), "doc_id", "item_id", "n_windows") == whole


def test_decontaminate_finds_items_of_few_words(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Define photosynthesis briefly."), (2, "Yes"), (3, "so what"), (4, ""), (5, " ... ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Task: define photosynthesis briefly, please"), (2, "define photosynthesis"), (3, "yes"), (4, "yes and so what else"), (5, " So what? "), (6, "yes yes"), (7, ""), (8, None)], "doc_id long, text string")
    want = [(1, 1), (3, 2), (5, 3)]
    assert got(decontaminate.matches(docs, items), "doc_id", "item_id") == want
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 1)
    assert got(decontaminate.matches(docs, items), "doc_id", "item_id") == want


def test_the_pipeline_leaves_its_result_only(spark, tmp_path):
    import os

    import corpus_pipeline

    left = lambda: set(os.listdir(f"{shared}/millrace")) if os.path.isdir(f"{shared}/millrace") else set()
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = left()
    rows = corpus_pipeline.run(spark, SF).count()
    made = {x for x in left() - before if any(os.scandir(f"{shared}/millrace/{x}"))}
    assert rows and len(made) == 1 and made.pop().startswith("pipeline-")


def test_decontaminate_against_substrings(spark):
    items = {r["item_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d, i) for d, t in docs for i, x in items.items() if x in t)
    assert got(Q.op5_decontaminate(spark, SF), "doc_id", "item_id") == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li>News</ul></nav><div class="cookie-notice">We use cookies</div><!-- c <p>no</p> -->
<header><h1>Site</h1></header>%s<aside>Side</aside><form><p>Mail</p><input></form><footer>&copy; x</footer>"""


def test_html_main_text():
    body = "<article><header><h1>Head &amp;\n line</h1></header><p><b>One.<br><p>Two <i>in</i>line&nbsp; x</p><div class='ad-box ad'>Buy</div><ul><li>a<li>b</ul><section id=comments><p>Nice!</p></section>tail</article>"
    assert html_wrapper.extract(PAGE % body, set(), None) == "Head & line\nOne.\nTwo inline x\na\nb\ntail"
    assert html_wrapper.extract("", set(), None) == "" and html_wrapper.extract("just text <", set(), None) == "just text <"
    assert html_wrapper.extract("<p>a<script>b", set(), None) == "a"
    assert html_wrapper.extract(PAGE % "<div id=content><p>Body</p></div>", set(), None) == "Body"


@pytest.mark.parametrize("around", ["<body class='no-sidebar single-post'>%s", "<body class='has-sidebar'>%s", "<div class='page-with-comments'>%s</div>", "<div id=comments>%s</div>", "<main class=widget>%s</main>", "<div class=related><article>Teaser</article></div>%s"])
def test_html_class_words_spare_what_holds_the_article(around):
    page = "<article class='post-comments'><div class='post-header'><h1>Title</h1></div><p class=warning>Careful</p><div class='article-comments'>Nice!</div></article>"
    assert html_wrapper.extract(around % page, set(), None) == "Title\nCareful"


@pytest.mark.parametrize("page", ["<article>" + "<span>" * 5000 + "deep" + "<div>" * 5000 + "text", "<article>" + "".join(f"<h2>a</h2><p>b{i}</p>" for i in range(4000))])
def test_html_of_deep_and_long_markup(spark, page):
    rows = [(1, "http://h.com/1", page), (2, "http://h.com/2", page.replace("deep", "other").replace("<p>b7</p>", "<ul><li>x</ul>")), (3, "http://h.com/3", "<article><p>short")]
    have = {r["page_id"]: r["text"] for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert have[3] == "short" and have[1].split() == [w for w in html_wrapper.re.sub("<[^>]*>", " ", page).split()]


def test_wrapper_alignment():
    a, b = html_wrapper.shape("<div><p>x</p><p>y</p></div>"), html_wrapper.shape("<div><h2>t</h2><p>x</p></div>")
    assert html_wrapper.expression(html_wrapper.align(a, b)) == "<div>(<h2>#)? (<p>#)+"
    assert html_wrapper.align(a, a) == a and html_wrapper.align(b, b) == b


def test_html_wrapper_query(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h.com/{i}", f"<body><div class=x><p>{words_of(rng, 40)}</p></div><div class=y><p>{'abc' if i % 2 else 'Same on every page'}</p><b>Template</b></div>") for i in range(8)]
    rows += [(100, None, None), (101, "http://one.org/", PAGE % "<article><p>Only page</p></article>"), (101, "http://one.org/", PAGE % "<article><p>Only page</p></article>"), (102, "u", "")]
    have = html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")))
    by = {r["page_id"]: (r["text"], r["n_chars"]) for r in have.collect()}
    assert have.count() == 12 and by[100] == ("", 0) and by[102] == ("", 0) and by[101] == ("Only page", 9)
    assert by[0][0] == rows[0][2].split("<p>")[1].split("</p>")[0]


def test_html_wrapper_tells_slots_of_equal_paths_apart(spark):
    """Two slots at one path, the first of the template: only a match against the wrapper tells them apart."""
    rng = random.Random(12)
    texts = [words_of(rng, 30) for _ in range(8)]
    rows = [(i, f"http://h.com/{i}", f"<body><div><p>Read this first</p><hr><p>{t}</p></div></body>") for i, t in enumerate(texts)]
    have = html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got(have, "page_id", "text") == list(enumerate(texts))
    assert html_wrapper.extract(rows[0][2], set(), None) == f"Read this first\n{texts[0]}"  # what the wrapper changes


@pytest.mark.parametrize("n", [3, 8, 40])
def test_html_article_is_whole_however_many_pages_are_alike(spark, n):
    rows = [(i, f"http://h.com/{i}", f"<body><nav>Menu</nav><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>rice {i}</p><h2>Method</h2><p>boil {i}</p></article><b>Site</b></body>") for i in range(n)]
    have = html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got(have, "page_id", "text") == [(i, f"Dish {i}\nIngredients\nrice {i}\nMethod\nboil {i}") for i in range(n)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body aria-hidden='true'><article><p>Text</p></article>", "Text"),
        ("<article aria-hidden=true><p>Text</p></article>", "Text"),
        ("<article><div class=cookie-recipe>Cookies</div><p class=commentary>View</p><ul class=related-work><li>Paper</ul></article>", "Cookies\nView\nPaper"),
        ("<article><table class=search-results><tr><td>1<td>2</table><p class=advertising-history>Old</p><div class=reply>So</div><figure><figcaption class=banner>Fig</figcaption></figure><object>Fall</object></article>", "1\n2\nOld\nSo\nFig\nFall"),
        ("<article><p>Text</p><article class=comment><p>Nice!</p></article><article id=comment-7><p>Me too</p></article><article><p>Part</p></article></article>", "Text\nPart"),
        ("<article>teaser</article><main><p>long text</p></main>", "teaser\nlong text"),
        ("<main><h1>All</h1><article><p>Text</p></article></main>", "Text"),
        ("<article><p>Text</p><div class='related-links'>More</div><div class=share>Share</div><section class=comment-list>Nice!</section></article>", "Text"),
    ],
)
def test_html_region_is_whole(page, text):
    assert html_wrapper.extract(page, set(), None) == text


def test_html_wrapper_merges_in_a_tree(spark, monkeypatch):
    """Many shapes of one host, aligned a few at a time, with the same texts."""
    rows = [(i, "http://h.com/x", "<body><div>" + "".join(f"<{n}>{n} {i}</{n}>" for j, n in enumerate(("h2", "ul", "p", "dl", "pre")) if i >> j & 1) + "<b>Template</b></div></body>") for i in range(1, 32)]
    monkeypatch.setattr(html_wrapper, "FAN_IN", 3)
    have = {r["page_id"]: r["text"] for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert have[31] == "h2 31\nul 31\np 31\ndl 31\npre 31" and have[4] == "p 4" and len(have) == 31


@pytest.mark.parametrize("chars", [html_wrapper.BROADCAST_CHARS, 900])
def test_html_wrapper_finds_a_region_on_every_page(spark, monkeypatch, chars):
    """Hosts without article or main: classes of one page, two layouts, parts side by side, no url, marked bodies."""
    monkeypatch.setattr(html_wrapper, "BROADCAST_CHARS", chars)
    rng = random.Random(13)
    rows, want = [], []

    def add(url, page, *texts):
        rows.append((len(rows), url, page))
        want.append((len(want), "\n".join(texts)))

    for i in range(8):
        a, b, c = words_of(rng, 30), words_of(rng, 9), words_of(rng, 12)
        add(f"http://classes.com/{i}", f"<body class='has-sidebar comments-open'><div class=top><b>Site</b></div><div class='post post-{i} of-{'abcdefgh'[i]}'><p>{a}</p></div></body>", a)
        add(f"http://layouts.com/{i}", f"<body><b>Site</b><div class=old><p>{a}</p></div></body>" if i % 4 else f"<body><b>Site</b><section class=new><div><span>{b}</span></div></section></body>", a if i % 4 else b)
        add(f"http://parts.com/{i}", f"<body><b>Site</b><div class=body><div class=lead><p>{a}</p></div><div class=rest><p>{b}</p></div></div></body>", a, b)
        add(None, f"<body><div class=k{'abcdefgh'[i]}><p>{c}</p></div></body>", c)
    have = html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got(have, "page_id", "text") == want


def test_html_of_the_given_pages(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op8_html_wrapper(spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


#: Names that operators use on the way, or have used.
CLASHES = ("rows", "_times", "_d", "_s", "_n", "_k", "_i", "_size", "_r", "size", "Slot", "SHARD", "cid", "label", "rid", "key", "freq", "kept", "th", "id", "h", "units", "w", "pos", "host", "page", "part", "block", "start", "score", "draw", "a.b", "_hot", "_gone", "_kept", "toxic_")


def clashing(df):
    return df.withColumns({n: F.lit(f"own {n}") for n in CLASHES})


@pytest.mark.parametrize("name", [n for n, f in Q.QUERIES.items() if n not in ("op1_sharding", "op8_html_wrapper", "op2_url_filter", "op13_ball_tree")])
def test_extra_columns_change_nothing(spark, name, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (clashing(df) if t == "documents" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    have, want = Q.QUERIES[name](spark, str(tmp_path)), Q.QUERIES[name](spark, SF)
    assert have.columns == want.columns and got(have, *want.columns) == got(want, *want.columns)


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_near_duplicates", "drop_leaks", "mix_sources"])
def test_stages_pass_extra_columns_through(spark, docs, stage):
    import corpus_pipeline

    f = getattr(corpus_pipeline, stage)
    odd = clashing(docs.unionByName(docs.filter("doc_id in (5, 40)")).unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))))
    plain, have = f(spark, odd.select(*docs.columns), SF), f(spark, odd, SF)
    assert have.columns == odd.columns
    assert all(r[n] == f"own {n}" for r in have.collect() for n in CLASHES)
    key = lambda rows: sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
    assert key(have.collect()) == key(plain.collect())
    assert f(spark, odd.limit(0), SF).count() == 0


def test_placing_passes_extra_columns_through(spark, docs, tmp_path):
    odd = clashing(docs)
    have = sharding.place(odd, "doc_id")
    assert [c for c in have.columns if c not in ("slot", "shard")] == [c for c in odd.columns if c not in ("Slot", "SHARD")]
    assert got(have, "doc_id", "slot", "shard") == got(sharding.place(docs, "doc_id"), "doc_id", "slot", "shard")
    assert sharding.place(odd, "Slot").select("shard").distinct().count() == 1
    sharding.write_sharded(docs, "doc_id", str(tmp_path / "s"), parts_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert got(back, "doc_id", "shard") == got(sharding.place(docs, "doc_id"), "doc_id", "shard")


def test_ids_may_be_text(spark, docs):
    named = docs.filter("doc_id < 60").withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    back = lambda df: df.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("long"))
    own = docs.filter("doc_id < 60")
    for f, cols in ((repeated_spans.digest, ("doc_id", "n_removed", "kept_sha256")), (line_quality.judge, ("doc_id", "n_words", "kept")), (token_pack.round_trip, ("doc_id", "start", "ids_crc32")), (near_dedup.cluster, ("doc_id", "n_shingles", "kept"))):
        assert got(back(f(named)), *cols) == got(f(own), *cols)
    items = spark.createDataFrame([("q1", own.first()["text"] or own.filter("doc_id = 5").first()["text"])], "item_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(named, items).collect()} >= {("d005", "q1"), ("d006", "q1")}


def test_operators_leave_the_session_and_the_shared_folder_as_they_were(spark, docs):
    import os

    from millrace.llm.common import BATCHES, shared_dir

    key = next(iter(BATCHES))
    spark.conf.set(key, "777")
    try:
        near_dedup.cluster(docs).count(), repeated_spans.digest(docs).count(), decontaminate.matches(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(3)).count()
        assert spark.conf.get(key) == "777"
    finally:
        spark.conf.unset(key)
    left = {}
    for top, _, files in os.walk(f"{shared_dir(spark)}/millrace"):
        if files and "-" in os.path.basename(top):
            left.setdefault(os.path.basename(os.path.dirname(top)).split("-")[0], set()).add(os.path.basename(top).split("-")[1])
    assert left.get("near_dedup") == {"clusters"} and left.get("repeats", set()) <= {"ids", "changed"} and left.get("decontaminate") == {"leaks"}


def test_packing_through_files_at_17_bits(spark, docs, rows):
    have = token_pack.round_trip(docs, end_id=70_000, block_tokens=300)
    want = brute.tokens([(d, t) for d, t, _ in rows], token_pack.tokenizer_path(), 70_000)
    assert got(have, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want)


def test_tokenizers_that_keep_white_space_get_whole_texts(rows):
    from tokenizers import Tokenizer

    path = token_pack.tokenizer_path("byte_bpe_50k.json")
    own = token_pack.WordEncoder(path)
    texts = [t for _, t, _ in rows if t][:20]
    assert not own.by_words and token_pack.WordEncoder(token_pack.tokenizer_path()).cuts
    assert [x.tolist() for x in own.encode(texts)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_agreements_follow_from_the_threshold():
    assert near_dedup.agreements(85) == 36 and near_dedup.agreements(80) == 31 and near_dedup.agreements(100) == 64
    with pytest.raises(ValueError):
        near_dedup.agreements(5)


@pytest.mark.parametrize("name", Q.QUERIES)
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert Q.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in Q.op3_toxicity(spark, SF).filter("predicted = 1").collect()}
    first = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    second = corpus_pipeline.drop_near_duplicates(spark, first, SF)
    groups = brute.near([(r["doc_id"], r["text"]) for r in first.collect()], 80)
    assert {r["doc_id"] for r in second.collect()} == {d for d, (_, c) in groups.items() if c == d}
    third = corpus_pipeline.drop_leaks(spark, second, SF)
    leaks = {r["doc_id"] for r in decontaminate.matches(second, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect()} - leaks
    out = corpus_pipeline.run(spark, SF)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in budget_mix.mix(third).filter("taken > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
