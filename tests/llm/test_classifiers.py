from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import quality, toxicity
from hearth.llm.language_id import held_out_by


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out_rows_follow_the_checksum(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"))
    got = {r[0]: r[1] for r in df.select("doc_id", held_out_by("doc_id", 4, 2)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


@pytest.mark.parametrize("query,label,least", [
    (quality.op4_quality, "quality", 0.97), (toxicity.op6_toxicity, "toxic", 0.9)])
def test_held_out_ranking(spark, query, label, least):
    d = "/root/testdata/sf0.1"
    rows = query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r[label] for r in rows]), np.array([r.score for r in rows])
    assert auc(y, s) > least and all(0 <= x <= 1 for x in s)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("module,score", [(quality, quality.score_texts), (toxicity, toxicity.score_toxicity)])
def test_edges(spark, edge, empty, module, score):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (8, 1), (None, 1), (9, None), (10, 7)],
                                   "doc_id long, y int")
    for rows in (labels, labels.filter("y = 1"), labels.limit(0)):
        model = module.fit(edge, rows, F.lit(True), "y")
        got = score(edge, model).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
        same = {r.score for r in got if r.doc_id == 7}
        assert len(same) == 1
    assert score(empty, model).count() == 0
    assert len(module.fit(empty, labels, F.lit(True), "y").judge([])[0] if module is toxicity
               else module.fit(empty, labels, F.lit(True), "y").score([])) == 0


def test_the_offending_sentence_is_located():
    clean = [f"the day number {i} was calm. we went home and slept." for i in range(200)]
    bad = [f"the day number {i} was calm. you are a horrid goblin. we went home." for i in range(60)]
    m = toxicity.Model(clean + bad, [0] * 200 + [1] * 60, [1.0] * 260)
    text = "Nothing here. The fields are wide. A horrid goblin came by. Good night."
    score, worst, a, b = m.judge([text, "all is calm. we slept.", ""])
    assert score[0] > 0.7 > score[1] and score[2] == 0
    assert text[a[0]:b[0]] == "A horrid goblin came by" and 0 < worst[0] <= score[0]


def test_random_index_vectors_repeat():
    h = np.arange(10, dtype=np.uint64)
    assert (quality.index_vectors(h) == quality.index_vectors(h)).all()
    assert np.abs(quality.index_vectors(h)).sum(axis=1).max() <= quality.NONZERO


def test_sample_takes_whole_texts_within_its_bounds(spark):
    from hearth.llm.labelled import labelled_sample
    docs = spark.createDataFrame([(i, "x" * (100 + i)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 3) for i in range(200)], "doc_id long, y int")
    whole = {"x" * (100 + i) for i in range(200)}
    for rows, chars in ((20, 10 ** 6), (1000, 3000), (1000, 10 ** 6)):
        texts, ys, w = labelled_sample(docs, labels, "y", F.lit(True), rows, chars)
        assert set(texts) <= whole and len(texts) == len(set(texts))
        for k, total in ((0, 150), (1, 50)):
            mine = [t for t, y in zip(texts, ys, strict=True) if y == k]
            assert 0 < len(mine) <= rows and sum(map(len, mine)) <= chars
            assert sum(x for x, y in zip(w, ys, strict=True) if y == k) / sum(w) == pytest.approx(total / 200)
    assert len(texts) == 200
    assert labelled_sample(docs, labels, "y", F.lit(True), 5, 10)[0] == []


def test_a_toxic_sentence_late_in_a_long_text_is_learned(spark):
    calm = "the day was calm and the fields were wide. " * 300  # 12,900 characters
    rows = [(i, calm + f"number {i}. " + ("you horrid goblin. " if i % 3 == 0 else "we went home. ")) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, y int")
    model = toxicity.fit(docs, labels, F.lit(True), "y")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[i].score >= 0.7) == (i % 3 == 0) for i in range(90))
    assert all("goblin" in rows[i][1][got[i].worst_start:got[i].worst_end] for i in range(0, 90, 3))


def test_noisy_or_equals_brute_force():
    """Score and worst sentence, sentence by sentence from the model's weights."""
    import re

    from hearth.llm.textvec import points, span_hashes
    clean = [f"day {i} was calm. we went home and slept." for i in range(120)]
    bad = [f"day {i} was calm. you are a horrid goblin! we went home." for i in range(40)]
    m = toxicity.Model(clean + bad, [0] * 120 + [1] * 40, [1.0] * 160)

    def feature(word, salt):
        cps = points(word)
        return int((span_hashes(cps, np.array([0]), np.array([len(cps)]))[0] ^ np.uint64(salt))
                   & np.uint64(toxicity.FEATURES - 1))

    texts = ["A horrid goblin. Calm fields! " * 3, "goblin " * 95, "we slept\n\nyou are horrid", "", "?!", "día é calm."]
    score, worst, a, b = m.judge(texts)
    for i, text in enumerate(texts):
        parts = []
        for piece in re.split(r"[.!?\n]", text):
            words = re.findall(r"[^\W_]+", piece.lower())
            for k in range(0, len(words), toxicity.LONGEST):
                parts.append(words[k:k + toxicity.LONGEST])
        ps = []
        for words in filter(None, parts):
            f = [feature(w, 0) for w in words]
            f += [feature(w[:4], 0x4444) for w in words if len(w) > 4] + [feature(w[:5], 0x5555) for w in words if len(w) > 5]
            ps.append(1 / (1 + np.exp(-(sum(float(m.w[x]) for x in f) + float(m.b)))))
        assert score[i] == pytest.approx(1 - np.prod([1 - p for p in ps]) if ps else 0, abs=1e-6)
        assert worst[i] == pytest.approx(max(ps, default=0), abs=1e-6)


def test_network_equals_brute_force():
    """The two layers and the temperature, neuron by neuron."""
    import math
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "words", "here"], 12)) for _ in range(60)]
    texts += [" ".join(rng.choice(["BUY", "NOW!!!", "$$$", "win"], 12)) for _ in range(60)]
    m = quality.Model(texts, [1] * 60 + [0] * 60, [1.0] * 120)
    w1, b1, w2, b2 = m.layers
    some = [*texts[:3], *texts[-3:], "", "unseen tokens only"]
    x = (m.features(some) - m.mean) / m.scale
    for i, got in enumerate(m.score(some)):
        hidden = [math.tanh(sum(float(x[i, j]) * float(w1[j, k]) for j in range(x.shape[1])) + float(b1[k]))
                  for k in range(w1.shape[1])]
        z = (sum(h * float(v) for h, v in zip(hidden, w2, strict=True)) + float(b2[0])) / float(m.heat)
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
