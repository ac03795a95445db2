from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hearth.llm.lexical import Searcher, Treap, build_index, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, top=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOW)))
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def run(docs, items, **kw):
    return sorted([tuple(r) for r in ranked_search(docs, items, **kw).select(
        "item_id", "rank", "doc_id", "score").collect()], key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(n)]
    docs += [(n + k, docs[5][1]) for k in range(30)] + [(3, "Ünï w1 W2 é"), (7, None)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20])))) for k in range(25)]
    return docs, items + [(99, None), (98, "nowhere"), (97, "ünï É w1 w1 W1")]


@pytest.mark.parametrize("cells", [1 << 20, 200, 1])
def test_equals_brute_force(spark, cells):
    docs, items = corpus(cells, 150)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert run(d, q, block_cells=cells) == brute(docs, items)


def test_queries_in_chunks(spark):
    docs, items = corpus(1, 60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert run(d, q, chunk_chars=200) == brute(docs, items)


def test_treap_round_trip_and_bounds():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 70, 900))
    term = rng.integers(0, 150, 900).astype(np.uint64)
    keep = np.unique(np.stack([doc, term.astype(np.int64)]), axis=1)
    doc, term = keep[0], keep[1].astype(np.uint64)
    doc = np.unique(doc, return_inverse=True)[1]
    impact = rng.integers(1, 400, len(doc))
    t = Treap.build(doc, term, impact)
    u = Treap.unpacked(t.terms, t.row, t.values, [len(x) for x in t.top], t.packed())
    assert all((a == b).all() for a, b in zip(t.top, u.top, strict=True))
    assert all((a == b).all() for a, b in zip(t.shape, u.shape, strict=True))
    assert t.values[t.top[0][0]] == impact.max() and len(t.top[-1]) == len(doc)
    for _ in range(30):
        q = np.unique(rng.integers(0, 170, 8)).astype(np.uint64)
        w = rng.integers(0, 50, len(q))
        score = np.zeros(doc.max() + 1, np.int64)
        for h, x in zip(q, w, strict=True):
            score[doc[term == h]] += x * impact[term == h]
        want = sorted((-s, d) for d, s in enumerate(score) if s > 0)[:10]
        got = Searcher(u, np.arange(len(score))).best(q, w, 10)
        assert [(-s, d) for s, d in got] == want


def test_edges(edge):
    items = [(1, "the cat sat"), (2, "word19999 of"), (3, "passage3 passage4"), (None, "chat"), (4, "")]
    q = edge.sparkSession.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert run(edge, q) == brute(docs, items)


def test_empty(spark, empty):
    q = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert ranked_search(empty, q).collect() == []
    d = spark.createDataFrame([(1, "the cat")], "doc_id long, text string")
    assert ranked_search(d, q.limit(0)).collect() == []
    assert build_index(d)[1] == 1


def test_blocks_are_handled_one_at_a_time(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from hearth.llm import lexical as module
    docs, items = corpus(7, 150)
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame(items, "item_id long, text string")
    seen, rows = {}, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def kept(df, name, *args):
        seen[name] = (spark.conf.get(rows), stage(df, name, *args))
        return seen[name][1]

    stage, before = module.stage, spark.conf.get(rows)
    monkeypatch.setattr(module, "stage", kept)
    try:
        spark.conf.set(rows, 5)  # a block ends with a batch at the earliest
        assert run(d, q, block_cells=1) == brute(docs, items)
        assert spark.conf.get(rows) == "5"
    finally:
        spark.conf.set(rows, before)
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{seen['treaps'][1]._staged_path}/*.parquet")]
    assert sum(m.num_rows for m in groups) > 20
    assert {m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)} == {1}
    assert seen["ranked"][0] == "1"
