from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm.variants import near_words, roots, spelling_variants

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, slip=None):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    v = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in v if one_edit(w, x)] for w in v}
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= 5 * v[w] else None
    out = []
    for w in v:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, v[w], form[w], r, len(near[w]), v.get(form[w])))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted([tuple(r) for r in spelling_variants(df, **kw).select(
        "word", "n", "form", "root", "n_near", "form_n").collect()], key=repr)


@pytest.mark.parametrize("slip", [None, 7])
def test_equals_brute_force(spark, slip):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéÀz") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(20):
            w = stems[min(int(rng.expovariate(0.3)), 24)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "b", w[k] * 2]) + w[k + 1:]
            words.append(w.capitalize() if rng.random() < 0.3 else w)
        rows.append((i, rng.choice([" ", "-", "1"]).join(words)))
    want = brute(rows, slip)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), slip=slip) == want
    assert any(r[2] for r in want)


def test_near_words_of_one_reduced_form(spark):
    """Thousands of words over two letters that reduce alike meet only their neighbours."""
    words = sorted({format(k, "012b").replace("0", "a").replace("1", "e") for k in range(1200)})
    got = {tuple(r) for r in near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 1)
           .select("word", "near").collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


@settings(max_examples=6, deadline=None)
@given(st.sets(st.text("abcé", min_size=1, max_size=6), max_size=40))
def test_short_words_near(spark, words):
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in near_words(df).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_roots_follow_long_chains(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}" if i < 99 else None) for i in range(100)]
    got = dict(tuple(r) for r in roots(spark.createDataFrame(rows, "word string, form string")).collect())
    assert set(got.values()) == {"w099"} and len(got) == 100


def test_edges(edge):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert run(edge, slip=199) == brute(rows, 199)


def test_empty(empty):
    assert spelling_variants(empty).collect() == []
