from __future__ import annotations

import random
import re

import numpy as np
import pytest

from hearth.llm.substring_dedup import maximal, remove_repeats


def brute(rows, length=13):
    """Per row: (words, words removed, kept text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least: dict = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - length + 1):
            if i is not None:
                k = tuple(w[s:s + length])
                least[k] = min(i, least.get(k, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - length + 1):
            if i is not None and least[tuple(w[s:s + length])] < i:
                gone |= set(range(s, s + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in remove_repeats(df, **kw).select(
        "row.doc_id", "n_words", "n_removed", "text").collect()], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" if rng.random() < 0.9 else "the" for j in range(rng.randint(5, 60))] for k in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(passages)
            a = rng.randint(0, len(part) // 2)
            part = part[a:a + rng.randint(3, 50)]
            if rng.random() < 0.3 and part:
                part = [*part]
                part[rng.randrange(len(part))] = "edit"
            w += [f"own{rng.randint(0, 9)}" for _ in range(rng.randint(0, 6))] + part
        rows.append((rng.choice([i, i, i // 2]), rng.choice([" ", "\n", " \t "]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == brute(rows)
    assert any(r[2] for r in brute(rows))


def test_periodic_text_and_low_alphabet(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(200))) for i in range(20)]
    rows += [(100, "a " * 500), (101, "a " * 40), (102, "b " + "a " * 14)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_passage_that_only_later_documents_share(spark):
    """The first holder of a seed is not the source of the whole passage."""
    p = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(p[10:17])), (2, " ".join(["x", *p[5:22], "y"])), (3, " ".join(["z", *p[3:30]])),
            (4, " ".join(p)), (5, " ".join(p[20:32]))]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_repeats_are_maximal_and_name_their_source(spark):
    p = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(["a", "b", *p])), (2, " ".join(["c", *p, "d"])), (3, " ".join(["e", *p[:20], "f"]))]
    got = {r.doc_id: (r.removed, [tuple(x) for x in r.repeats]) for r in remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "removed", "repeats").collect()}
    assert got == {1: ([], []), 2: (["1-31"], [(1, 31, 1, 2)]), 3: (["1-21"], [(1, 21, 1, 2)])}


def test_maximal_merges_one_diagonal_only():
    start = np.array([0, 1, 2, 30, 3, 40])
    source = np.array([7, 7, 7, 7, 8, 7])
    at = np.array([5, 6, 7, 35, 0, 99])
    size = np.array([1, 1, 1, 3, 1, 1])
    assert maximal(start, size, source, at, 13) == [(0, 15, 7, 5), (3, 16, 8, 0), (30, 45, 7, 35), (40, 53, 7, 99)]


def test_edges(edge):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert run(edge) == brute(rows)
    out = remove_repeats(edge)
    assert out.select("row.*").columns == edge.columns


def test_empty(empty):
    assert remove_repeats(empty).collect() == []
