"""The wrapper of op8 treats lists of siblings of every length by the same rules."""

import random

import pytest

from millrace.llm import html_wrapper as hw

LABELS = ["p", "h2", "div.a", "div.a.b", "div.b.c", "ul", "#", "div", "p.x", "p.x.y"]


def common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if a[i] == b[j] else max(rows[i + 1][j], rows[i][j + 1])
    return rows[0][0]


def met(runs, kids):
    """The plain table of scores: a run meets a child, or one of both is passed over."""
    n, m = len(runs), len(kids)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    step = [[0] * m for _ in range(n)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            score, how = max((best[i][j + 1], 1), (best[i + 1][j], 0))
            _, label, mark = kids[j]
            same, name, classes = label == runs[i], label.split(".")[0], set(label.split(".")[1:])
            if same or runs[i].split(".")[0] == name and classes and classes <= set(runs[i].split(".")[1:]):
                meets = 10 + same + (mark not in ("?", "*")) + best[i + 1][j if mark in ("+", "*") and not same else j + 1]
                if meets >= score:
                    score, how = meets, 2
            best[i][j], step[i][j] = score, how
    to, i, j = [-1] * n, 0, 0
    while i < n and j < m:
        how = step[i][j]
        if how == 2:
            to[i] = j
            i, j = i + 1, j if kids[j][2] in ("+", "*") and kids[j][1] != runs[i] else j + 1
        else:
            i, j = (i, j + 1) if how else (i + 1, j)
    return to


@pytest.mark.parametrize("most", [0, 1, 5, 30, 700])
def test_alignment_is_the_longest_at_any_length(most):
    r = random.Random(most)
    for _ in range(200 if most < 100 else 1):
        a, b = ([r.choice(LABELS) for _ in range(r.randint(most // 2, most))] for _ in range(2))
        steps = list(hw._opcodes(a, b))
        assert [x for kind, i, j, k, m in steps if kind == "equal" for x in a[i:j]] == [x for kind, i, j, k, m in steps if kind == "equal" for x in b[k:m]]
        assert sum(j - i for kind, i, j, _, _ in steps if kind == "equal") == common(a, b)
        ends = [(0, 0), *((j, m) for _, _, j, _, m in steps)]
        assert [(i, k) for _, i, _, k, _ in steps] == ends[:-1] and ends[-1] == (len(a), len(b))
        at, want = 0, []
        for y in b:
            want.append(next((x for x in range(at, len(a)) if hw._common(a[x], y)), -1))
            at = want[-1] + 1 if want[-1] >= 0 else at
        assert hw._meeting(a, b) == want


@pytest.mark.parametrize("most", [0, 1, 5, 30, 700])
def test_placement_is_the_best_at_any_length(most):
    r = random.Random(most)
    for _ in range(200 if most < 100 else 1):
        kids = [(i, r.choice(LABELS), r.choice(["", "?", "+", "*"])) for i in range(r.randint(most // 2, most))]
        runs = [r.choice(LABELS) for _ in range(r.randint(most // 2, most))]
        assert not kids or hw._met(runs, kids) == met(runs, kids)


@pytest.mark.parametrize("pairs", [3, 300])
def test_a_block_moved_to_the_front_costs_itself_only(pairs):
    """One pass met the moved block at the end of a long list and none of what lies between."""
    page = lambda moved: f"<body>{moved}{'<p>x</p><h2>y</h2>' * pairs}{'<ul><li>z</li></ul>' if not moved else ''}</body>"
    body = hw.align(hw.shape(page("")), hw.shape(page("<ul><li>z</li></ul>")))[0]
    assert [n[1] for n in body[2] if n[0] in ("p", "h2")] == [""] * (2 * pairs)
    assert [n[:2] for n in body[2] if n[0] == "ul"] == [["ul", "?"]] * 2
