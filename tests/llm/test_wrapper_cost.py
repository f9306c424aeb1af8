"""Each page of op8 is parsed in every pass: tags and parts that pages have in common are worked out once."""

import random

import pytest

from millrace.llm import html_wrapper as hw

TAGS = ["<div class=ad>", "<div class='post comments'>", "</div>", "<article>", "<article class=comment>", "</article>", "<p>", "<p class='a1 b'>", "<b>", "</b>", "<li>", "<ul id=related>", "</ul>", "<br>", "text ", " ", "\n", "a &amp; b", "<img src='a>b' class=k>", "<script>x</script>"]


def pages(n, seed=1):
    r = random.Random(seed)
    return ["<body class=no-sidebar><div class=share><a href=/x>s</a></div><article>" + "".join(f"<p class=lead>{'<b>x</b>' * (r.random() < 0.5)}text {r.random()}{'<br>' * (r.random() < 0.5)}</p>" for _ in range(20)) + "</article>" for _ in range(n)]


def counted(monkeypatch, name):
    calls, run = [], getattr(hw, name)
    monkeypatch.setattr(hw, name, lambda *a: calls.append(1) or run(*a))
    return calls


def test_a_tag_is_judged_once(monkeypatch):
    outside, inside = counted(monkeypatch, "_marked"), counted(monkeypatch, "_marked_inside")
    for page in pages(30):
        assert hw.extract(page, set(), None).count("text") == 20
    assert len(outside) <= 5 and len(inside) <= 5  # div, a, p, b, br


def test_parts_that_pages_share_are_aligned_once(monkeypatch):
    calls = counted(monkeypatch, "align")
    for page in pages(30):
        hw.shape(page)
    assert len(calls) < 100


@pytest.mark.parametrize("seed", range(5))
def test_what_is_remembered_changes_nothing(monkeypatch, seed):
    r = random.Random(seed)
    some = ["".join(r.choice(TAGS) for _ in range(r.choice([3, 10, 60]))) for _ in range(60)]
    run = lambda: [(hw.shape(p), hw.extract(p, {2, 5}, {1, 3}, hw.Wrapper(hw.shape(some[0])))) for p in some]
    have = run()
    monkeypatch.setattr(hw, "TAG_CHARS", -1)
    monkeypatch.setattr(hw, "PART_CHARS", -1)
    assert run() == have


def test_spaces_of_every_kind_become_one():
    for c in map(chr, [*range(0x3100), 0xD800, 0xE000, 0xFEFF, 0x10FFFF]):
        for text in (c, f"a{c}", f"{c}a", f"a{c}b", f"a {c}b", f"a{c}{c}b"):
            assert hw._single_spaced(text) == " ".join(text.split())
