from __future__ import annotations

import random
import re

from hearth.llm.line_dedup import dedup_lines
from hearth.llm.line_passages import MIN_WORDS, drop_passages


def sentences(t):
    """(first word, words) of each sentence."""
    out, at = [], 0
    for line in (t or "").split("\n"):
        for s in re.split(r"(?<=[.!?])\s", line):
            if s.split():
                out.append((at, s.split()))
                at += len(s.split())
    return out


def brute(rows, least):
    """Each shortest window, in the order of places, against the first place of its words."""
    first, out = {}, {}
    for i, t in rows:
        body = sentences(t)
        gone = set()
        size = [len(w) for _, w in body]
        spans = set()
        for a in range(len(body)):
            fit = [b for b in range(a + 1, len(body) + 1) if sum(size[a:b]) >= least]
            if fit:
                spans.add((a, fit[0]))
            fit = [b for b in range(a + 1) if sum(size[b:a + 1]) >= least]
            if fit:
                spans.add((fit[-1], a + 1))
        for a, b in sorted(spans):
            key = tuple(tuple(w) for _, w in body[a:b])
            left = body[a - 1][1][::-1] if a else []
            right = body[b][1] if b < len(body) else []
            if key not in first:
                first[key] = (left, right)
                continue
            lo, hi = body[a][0], body[b - 1][0] + size[b - 1]
            for mine, other, step in ((left, first[key][0], -1), (right, first[key][1], 1)):
                for x, y in zip(mine, other, strict=False):
                    if x != y:
                        break
                    lo, hi = (lo - 1, hi) if step < 0 else (lo, hi + 1)
            gone.update(range(lo, hi))
        out[i] = gone
    return out


def check(df, rows, least):
    want = brute(rows, least)
    removed = 0
    for r in drop_passages(df, min_words=least).select("row.*", F_text(), "words_removed", "passages").collect():
        gone = {k for span in r.passages.split(",") if span for k in range(*map(int, span.split("-")))}
        assert gone == want[r.doc_id], r.doc_id
        words = (dict(rows)[r.doc_id] or "").split()
        assert (r.kept or "").split() == [w for k, w in enumerate(words) if k not in gone]
        assert r.words_removed == len(gone)
        removed += len(gone)
    return removed


def F_text():
    from pyspark.sql import functions as F
    return F.col("text").alias("kept")


def test_equals_brute_force_on_random_sentences(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) + rng.choice(".!?,") for _ in range(14)]
    rows = [(i, "".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(0, 12))))
            for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert check(df, rows, 6) > 500


def test_equals_brute_force_on_documents_after_the_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    left = dedup_lines(docs).select("row.doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in left.collect())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert check(df, rows, MIN_WORDS) > 0


def test_a_passage_inside_lines_goes_with_its_ends(spark):
    rng = random.Random(5)

    def prose(n):
        return [f"w{rng.randint(0, 10 ** 6)}" for _ in range(n)]
    passage = prose(60)
    for k in (9, 20, 33, 48):
        passage[k] += "."
    rows = []
    for k, cut in enumerate([10, 21, 34, 49, 10]):  # the line breaks elsewhere in each copy
        rows.append((k, " ".join([*prose(30), *passage[:cut]]) + "\n" + " ".join([*passage[cut:], *prose(30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.passages for r in drop_passages(df).select("row.doc_id", "passages").collect()}
    assert got == {0: "", 1: "30-90", 2: "30-90", 3: "30-90", 4: "30-90"}


def test_edges(edge, empty):
    got = drop_passages(edge).select("row.doc_id", "text", "words_removed").collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].text is None and by[4][0].text == "" and by[5][0].text == " \t\n "
    assert by[6][0].words_removed == 0 and [r.text for r in by[7]] == ["", ""]
    assert by[8][0].words_removed == 0 and by[9][0].text == ""
    assert sorted(r.words_removed for r in by[None]) == [0, 0] and by[1][0].text == "" and by[11][0].text == ""
    assert drop_passages(empty).count() == 0


def test_sentences_are_the_same_whatever_parts_their_words():
    from hearth.llm.line_passages import _Sentences
    even = _Sentences(["One two. Three!\nfour . Five? 3.5 six", "", "Three!"])
    assert even.words.tolist() == [2, 1, 2, 1, 2, 1] and even.text.tolist() == [0, 0, 0, 0, 0, 2]
    assert even.of_text.tolist() == [0, 8, 8, 9] and even.whole[1] == even.whole[5]
    odd = _Sentences(["\n One\ttwo.\u00a0 Three! \n\n four\u3000. Five?\r3.5\x1csix ", " \n", "Three!"])
    assert odd.whole.tolist() == even.whole.tolist() and odd.first.tolist() == even.first.tolist()


def test_lines_without_words_stay_beside_what_goes():
    import numpy as np

    from hearth.llm.line_passages import without
    assert without("a b\n\n c\nd", np.array([1, 1]), np.array([3, 2])) == ("a\n\nd", 2, [(1, 3)])


def test_common_first_words(spark):
    from hearth.llm.line_passages import _common
    rows = [([], [], 0), ([1], [], 0), ([1, 2], [1, 2], 2), ([1, 2, 3], [1, 2], 2), ([1, 2, 3], [1, 4, 3], 1), ([2], [1], 0)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, n int")
    assert [r.n for r in df.select("n", _common("a", "b").alias("m")).collect() if r.n != r.m] == []
