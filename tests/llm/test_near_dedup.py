from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from hearth.llm.components import components
from hearth.llm.near_dedup import (
    THRESHOLD,
    Sampler,
    Weights,
    document_frequencies,
    drop_near_copies,
    near_dedup,
    shingles,
    weighted_jaccard,
)


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def family(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def exact(rows):
    """Weights from the documents of each shingle, counted one by one."""
    per = Counter(v for _, t in rows for v in shingles([t or ""])[2].tolist())
    often = sorted(v for v, c in per.items() if c > 1)
    return Weights(np.array(often, np.uint64), np.array([per[v] for v in often]), len(rows))


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += family(60, 150, 8, 1) + family(30, 60, 3, 2) + ["one two", "one two", "One, two!", "", None]
    rows = list(enumerate(texts))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()


def test_classes_equal_brute_force(corpus):
    rows, df = corpus
    idf = exact(rows)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a)]
    links = []
    for k in range(0, len(pairs), 2000):
        part = pairs[k:k + 2000]
        sim = weighted_jaccard([rows[a][1] or "" for a, _ in part], [rows[b][1] or "" for _, b in part], idf)
        links += [p for p, s in zip(part, sim, strict=True) if s >= THRESHOLD]
    want = union_find([i for i, _ in rows], links)
    got = {r.doc_id: r.class_id for r in near_dedup(df).collect()}
    assert got == want


def test_document_frequencies_are_exact(corpus, monkeypatch):
    from hearth.llm import near_dedup as module
    rows, df = corpus
    want = exact(rows)
    docs = df.fillna({"text": ""})
    got = document_frequencies(docs)
    assert (got.value == want.value).all() and np.allclose(got.own, want.own) and got.rare == want.rare
    per = Counter(v for _, t in rows for v in shingles([t or ""])[2].tolist())
    value = np.array(list(per), np.uint64)
    true = np.log((len(rows) + 1) / (np.array(list(per.values())) + 1)) + 1
    assert np.corrcoef(got.idf(value), true)[0, 1] > 0.999
    monkeypatch.setattr(module, "FREQUENT", 40)  # a larger corpus: only those in 1 of 40 documents have their own
    monkeypatch.setattr(module, "HELD", 1000)
    few = document_frequencies(docs)
    least = -(-len(rows) // 40)
    assert set(few.value.tolist()) == {v for v, c in per.items() if c >= least} and len(few.value)
    assert np.allclose(few.idf(value), np.log((len(rows) + 1) / (np.maximum(list(per.values()), least - 1) + 1)) + 1)


def test_samples_agree_with_the_similarity():
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sampler = Sampler(2000)
    level = rng.integers(0, 12, 300)
    other = np.where(rng.random(300) < 0.2, level + 6, level)
    a, b = np.exp(level * 0.125), np.exp(other * 0.125)
    keep = rng.random(300) < 0.9
    one = sampler.samples(np.zeros(300, np.int64), values, level, 1)[0]
    two = sampler.samples(np.zeros(keep.sum(), np.int64), values[keep], other[keep], 1)[0]
    true = np.minimum(a, b)[keep].sum() / (np.maximum(a, b)[keep].sum() + a[~keep].sum())
    assert abs((one == two).mean() - true) < 0.05


def test_edges(edge, empty):
    r = near_dedup(edge).collect()
    assert len(r) == edge.count()
    cls = {}
    for x in r:
        cls.setdefault(x.class_id, []).append(x)
    ids = {k: sorted((x.doc_id is None, x.doc_id or 0) for x in v) for k, v in cls.items()}
    assert [i for _, i in ids[3]] == [3, 4, 5, 0]  # no words, the null id last
    assert [i for n, i in ids[1]] == [1, 11, 0] and [i for _, i in ids[6]] == [6, 7, 7]
    assert all(sum(x.kept for x in v) == 1 and {x.class_size for x in v} == {len(v)} for v in cls.values())
    kept = drop_near_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len(cls)
    assert near_dedup(empty).count() == 0 and drop_near_copies(empty).count() == 0


def test_components_of_chain_star_and_ring(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2005, 2000)]
    links += [(3000 + i, 3000 + (i + 1) % 30) for i in range(30)]
    rng.shuffle(links)
    got = {r.uid: r.cls for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == union_find({x for e in links for x in e}, links)


def test_the_pair_of_a_bucket_of_two_is_always_verified(spark, monkeypatch):
    from hearth.llm import near_dedup as module
    rows = []
    for i in range(30):
        w = [f"d{i}w{j}" for j in range(300)]
        rows.append((2 * i, " ".join(w)))
        rows.append((2 * i + 1, " ".join([*w[:280], *(f"e{i}w{j}" for j in range(12))])))
    monkeypatch.setattr(module, "SURE", module.THRESHOLD - 1.01)  # no pair has so many equal samples
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in module.near_dedup(df).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def by_pairs(rows):
    """The classes by the similarity of all pairs, with weights counted one by one."""
    pairs = [(a, b) for a in range(len(rows)) for b in range(a)]
    sim = weighted_jaccard([rows[a][1] for a, _ in pairs], [rows[b][1] for _, b in pairs], exact(rows))
    return union_find([i for i, _ in rows], [p for p, s in zip(pairs, sim, strict=True) if s >= THRESHOLD])


def test_every_shingle_weighs_by_its_own_frequency(spark, monkeypatch):
    from hearth.llm import near_dedup as module
    passage = " ".join(f"b{j}" for j in range(24))
    rows = []
    for i in range(10):  # one with and one without a passage that 50 of 60 documents have
        own = " ".join(f"p{i}w{j}" for j in range(60))
        rows += [(2 * i, own), (2 * i + 1, f"{own} {passage}")]
    rows += [(20 + i, " ".join([passage, *(f"o{i}w{j}" for j in range(30))])) for i in range(40)]
    want = by_pairs(rows)
    assert want == {i: i - i % 2 if i < 20 else i for i in range(60)}
    monkeypatch.setattr(module, "FREQUENT", 1)  # as in a large corpus: the table of the frequent ones has none of these
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.class_id for r in module.near_dedup(df).collect()} == want
    for held in (100, 1 << 20):  # many pieces, or one per task
        monkeypatch.setattr(module, "HELD", held)
        assert {r.doc_id: r.class_id for r in module.near_dedup(df).collect()} == want
    assert module.drop_near_copies(df).count() == 50


def test_a_large_group_of_near_copies_stays_together(spark):
    rng = random.Random(6)
    base = [f"w{j}" for j in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # four edits each: 0.81 to the base plain, 0.7 by weights, as 120 documents share the rest
        w = list(base)
        for j in rng.sample(range(10, 190, 10), 4):
            w[j] = f"e{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(120 + i, " ".join(f"o{i}w{j}" for j in range(60))) for i in range(280)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup(df).collect()}
    assert got == {i: (0, 120) if i < 120 else (i, 1) for i in range(400)}


def test_plain_samples_agree_with_the_similarity():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    sampler = Sampler(2000)
    keep = rng.random(300) < 0.8
    one = sampler.plain(np.zeros(300, np.int64), values, 1)[0]
    two = sampler.plain(np.zeros(keep.sum(), np.int64), values[keep], 1)[0]
    assert abs((one == two).mean() - keep.mean()) < 0.04
