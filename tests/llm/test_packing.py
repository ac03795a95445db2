from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from hearth.llm.bpe import Bpe
from hearth.llm.packing import END_ID, WIDTH, default_tokenizer, pack, plan_slots


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def test_ids_equal_the_library(library, spark):
    rng = random.Random(3)
    texts = ["", " ", "it's don't 'tis", "<|endoftext|> x", "日本語 x", "½ ² x2", " a b ", "\n\n a\t b", "a\x00b", "''s", "😀 😀"]
    texts += ["".join(rng.choice(" \n\t.a1'é !sÉß") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ours = Bpe(default_tokenizer()).ids(texts)
    assert [x.tolist() for x in ours] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_plan_is_best_fit_and_gapless():
    rng = random.Random(5)
    for _ in range(30):
        counts = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 400)))
        bins = defaultdict(list)
        for length, lo, hi, per, first, offset in plan_slots(counts, 64):
            for rank in range(lo, hi):
                bins[first + (rank - lo) // per].append((offset + (rank - lo) % per * length, length))
        placed = Counter(length for b in bins.values() for _, length in b)
        assert placed == counts and sorted(bins) == list(range(len(bins)))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 64
        rooms = []  # best-fit decreasing, piece by piece
        for length in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 64) - length)
        assert len(bins) == len(rooms)


def check(df, rows, library):
    got = [r.asDict() for r in pack(df, with_ids=True).collect()]
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for b in by_seq.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= WIDTH
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [END_ID])
    for i, lists in want.items():
        pieces = sorted(by_doc[i], key=lambda r: (r["piece"], r["ids"]))
        assert Counter(r["start"] for r in pieces)[0] == len(lists)
        if len(lists) == 1:
            assert [x for r in pieces for x in r["ids"]] == lists[0]
            assert all(r["length"] == WIDTH for r in pieces[1:])
            assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces[:-1]]).tolist()
    return len(by_seq), sum(r["length"] for r in got)


def test_round_trip_on_edges(edge, library):
    check(edge, [(r.doc_id, r.text) for r in edge.collect()], library)


def test_round_trip_on_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    sequences, tokens = check(df, [(r.doc_id, r.text) for r in df.collect()], library)
    assert sequences <= -(-tokens // WIDTH) * 1.03 + 1


def test_empty_table(empty):
    assert pack(empty).count() == 0
