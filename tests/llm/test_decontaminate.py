from __future__ import annotations

import itertools
import random
import re

import numpy as np

from hearth.llm.decontaminate import (
    MASKS,
    MIN_IDENTITY,
    MIN_ITEM,
    MIN_OVERLAP,
    best_run,
    drop_contaminated,
    find_overlaps,
)

D = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    """Every alignment of every pair, compared word by word."""
    out = set()
    for di, dt in docs:
        d = np.array(words(dt), dtype=object)
        for ii, it in items:
            t = np.array(words(it), dtype=object)
            if len(t) < MIN_ITEM:
                continue
            for shift in range(-len(t) + 1, len(d)):
                a, b = max(0, shift), min(len(d), shift + len(t))
                same = d[a:b] == t[a - shift:b - shift]
                if same.sum() < min(MIN_OVERLAP, len(t)) * MIN_IDENTITY:
                    continue
                _, n, ok = best_run(same)
                if n >= min(MIN_OVERLAP, len(t)) and ok >= MIN_IDENTITY * n:
                    out.add((di, ii))
    return out


def test_best_run():
    assert best_run(np.array([0, 1, 1, 0, 1, 1, 1, 0, 0], bool)) == (4, 3, 3)
    assert best_run(np.zeros(3, bool))[1] == 0
    for _ in range(200):
        e = np.random.default_rng(_).random(12) < 0.6
        gains = [(sum(np.where(e[a:b], 1, -2)), a, b) for a in range(13) for b in range(a, 13)]
        s, n, _k = best_run(e)
        assert sum(np.where(e[s:s + n], 1, -2)) == max(gains)[0]


def test_short_items_match_as_a_whole(spark):
    items = spark.createDataFrame([(3, "one two three"), (4, "alpha beta gamma delta"), (5, "what is the melting point"),
                                   (6, "six words are in this item"), (2, "two words"), (1, "word")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "he asked: What is the melting point of it?"), (2, "what is a melting point"), (3, "zero one two three four"),
        (4, "alpha beta gamma, delta"), (5, "six words are in this item"), (6, "six words are in that item"),
        (7, "two words and one word")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.overlap) for r in find_overlaps(docs, items).collect())
    assert got == [(1, 5, 5), (3, 3, 3), (4, 4, 4), (5, 6, 6)]


def test_equals_brute_force_with_substitutions(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()][:12]
    items += [(900, "only four words here"), (901, "seven words are in this short item"), (902, None), (903, "")]
    rng = random.Random(2)
    docs = [(r.doc_id, r.text[:900]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()][:60]
    for k, (_, t) in enumerate(items[:12]):
        w = t.split()
        for at in range(3, len(w), 9):  # every ninth word differs
            w[at] = f"changed{rng.randint(0, 99)}"
        docs.append((1000 + k, "before it " + " ".join(w) + " and after it"))
    docs += [(2000, "x y seven words are in this short item z"), (2001, None), (2002, ""), (2001, "seven words")]
    got = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                        spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    want = brute(docs, items)
    assert pairs == want and {(1000 + k, items[k][0]) for k in range(12)} <= pairs and (2000, 901) in pairs


def test_without_the_filter_the_join_decides_alike(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = spark.read.parquet(f"{D}/benchmark.parquet")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(find_overlaps(docs, items)) == key(find_overlaps(docs, items, max_filter=0))


def test_drop_and_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, edge.filter("doc_id = 9").first().text)], "item_id long, text string")
    found = {r.doc_id for r in find_overlaps(edge, items).collect()}
    assert found == {8, 9}
    left = drop_contaminated(edge, items)
    assert left.columns == edge.columns and left.count() == edge.count() - 2
    assert find_overlaps(empty, items).count() == 0
    none = items.limit(0)
    assert find_overlaps(edge, none).count() == 0 and drop_contaminated(edge, none).count() == edge.count()


def test_equals_brute_force_at_several_rates(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(n)))
             for k, n in enumerate([6, 7, 8, 9, 10, 11, 12, 12, 13, 13, 14, 15, 16, 18, 20, 25, 30, 50])]
    docs = []
    for rate in (0.05, 0.1, 0.15, 0.2):
        for _, t in items * 25:
            w = [x if rng.random() >= rate else f"other{rng.randint(0, 10 ** 9)}" for x in t.split()]
            docs.append((len(docs), " ".join(["before", "it", *w, "after", "it"])))
    at = {t.split()[0].split("x")[0]: (i, t) for i, t in items}
    docs.append((10_000, at["w7"][1].replace("w7x8 ", "changed ")))
    got = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                        spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    want = set()
    for d, t in docs:
        k = re.search(r"w(\d+)x", t)
        want |= brute([(d, t)], [items[int(k.group(1))]]) if k else set()
    assert pairs == want and (10_000, 7) in pairs and len(want) > 1000


def test_every_accepted_pattern_of_short_runs_hits_a_mask():
    masks = [int(m, 2) for m in MASKS]
    for n in range(MIN_OVERLAP, 18):
        for k in range(n // 5 + 1):
            for off in itertools.combinations(range(1, n - 1), k):
                equal = np.ones(n, bool)
                equal[list(off)] = False
                if best_run(equal)[1] == n:
                    x = int("".join("01"[int(e)] for e in equal), 2)
                    assert any((x >> s) & m == m for m in masks for s in range(n - m.bit_length() + 1)), off
