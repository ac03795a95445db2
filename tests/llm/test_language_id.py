from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from hearth.llm.language_id import (
    UNKNOWN,
    CrossParser,
    identify,
    keep_identified,
    normalise,
    op1_language_id,
    sample_text,
)


def phrases(text, reference):
    """Greedy longest matches by substring search; the open last one is not counted."""
    count, at = 0, ""
    for c in text:
        if at + c in reference:
            at += c
        else:
            count += 1
            at = c if c in reference else ""
    return count


def test_parse_equals_substring_search():
    rng = random.Random(1)
    samples = {"a": ["abra cadabra abracadabra", "cab bad"], "b": ["zulu zebra lazuli", "bazul"]}
    p = CrossParser(samples)
    texts = ["".join(rng.choice("abczul dré") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    bits, _ = p.costs(texts)
    refs = [" ".join(normalise(w) for w in samples[k]) for k in p.langs]
    for t, row in zip(texts, bits, strict=True):
        low = normalise(t)
        if not low:
            continue
        trail = low + " " if t.strip() and not t.lower()[-1].isalpha() else low
        for k, ref in enumerate(refs):
            assert round(row[k] / p.bits[k]) in (phrases(low, ref), phrases(trail, ref))


def test_edges(edge):
    rows = identify(edge, sample_text(edge, "doc_id", "text", "lang")).select("row.doc_id", "lang_pred", "score")
    got = {r.doc_id: r for r in rows.collect()}
    for i in (3, 4, 5, 10):
        assert got[i].lang_pred == UNKNOWN and got[i].score == 0
    assert got[1].lang_pred == "en" and got[2].lang_pred == "fr" and got[7].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values()) and rows.count() == edge.count()


def test_no_labels_and_empty_table(edge, empty):
    none = sample_text(edge.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang")
    assert none == {} and {r.lang_pred for r in identify(edge, none).collect()} == {UNKNOWN}
    assert sample_text(empty, "doc_id", "text", "lang") == {} and identify(empty, {}).count() == 0


def test_rejects_only_what_no_language_explains(spark, edge):
    samples = sample_text(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "text", "lang")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = keep_identified(docs, samples)
    assert kept.schema == docs.schema and kept.count() == docs.count()
    odd = spark.createDataFrame([(1, "Это совсем другой язык и алфавит"), (2, "!!! 12"), (3, None)],
                                "doc_id long, text string")
    assert keep_identified(odd, samples).count() == 0
    assert set(keep_identified(edge, samples).columns) == set(edge.columns)


def test_tables_grow_with_the_languages_not_their_scripts():
    rng = random.Random(5)

    def script(k):
        letters = [chr(0x4E00 + 200 * k + i) for i in range(100)]
        return ["".join(rng.choice(letters) for _ in range(5)) + " " for _ in range(400)]
    sizes = [CrossParser({str(k): script(k) for k in range(n)}).table.nbytes for n in (2, 4, 8)]
    assert sizes[1] < 2.2 * sizes[0] and sizes[2] < 2.2 * sizes[1]
    # 20 scripts of 100 letters at full samples: states per character as here
    assert sizes[2] / 8 / 2000 * 30_000 * 20 < 1 << 30
    mixed = {"a": ["abc cab bac"], "g": ["αβγ γαβ"], "x": ["abγ βca"]}
    p = CrossParser(mixed)
    for text in ("abc", "αβγ", "abγ", "cab αβ zzz"):
        bits, _ = p.costs([text + " "])
        for k, row in zip(p.langs, bits[0] / p.bits, strict=True):
            assert round(row) == phrases(text + " ", " ".join(mixed[k])), (text, k)


def test_a_column_of_many_labels_is_bounded(spark):
    rows = [(i, "some labelled text here", f"l{i:04d}" if i % 3 else "en") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sample_text(df, "doc_id", "text", "lang", max_languages=5)
    assert list(got) == ["en", "l0001", "l0002", "l0004", "l0005"]
    assert sum(len(w) for ws in sample_text(df, "doc_id", "text", "lang").values() for w in ws) <= 1_200_000


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = op1_language_id(spark, d).join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_tiny_sample_neither_wins_all_nor_is_lost(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    labelled = [r for r in rows if r.lang and r.text]
    samples = {}
    for r in labelled[::2]:
        samples.setdefault(r.lang, []).append(r.text[:250])
    samples = {k: v[:120] for k, v in samples.items()}
    held = labelled[1::2][:200]
    texts = [r.text[:200] for r in held]
    for word in ("ok", "hola", "adios", "hola amigo", "god morgen"):
        langs = CrossParser(samples | {"xx": [word]}).predict(texts)[0]
        assert langs.count("xx") <= 1, word
    for k in samples:  # one window is enough to learn a language
        langs = CrossParser(samples | {k: samples[k][:1]}).predict(texts)[0]
        assert np.mean([a == r.lang for a, r in zip(langs, held, strict=True)]) > 0.95, k


def test_tiny_sample_does_not_open_the_rejection(spark):
    odd = spark.createDataFrame([(1, "Это совсем другой язык и алфавит, который здесь никто не знает")],
                                "doc_id long, text string")
    assert keep_identified(odd, {"xx": ["ok"]}).count() == 0
    assert keep_identified(odd, {"xx": ["hola amigo"], "en": ["a short line of text"]}).count() == 0


def test_long_text_of_another_language_in_the_same_script_goes(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = sample_text(d, "doc_id", "text", "lang")
    finnish = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki "
               "ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ")
    odd = spark.createDataFrame([(2, finnish * 8), (3, "ciao amico"), (4, "The and of in to.")],
                                "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_identified(odd, samples).collect()) == [3, 4]
    lettered = d.filter("text rlike '\\\\p{L}'")
    assert keep_identified(lettered, samples).count() == lettered.count()
