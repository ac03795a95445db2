from __future__ import annotations

import random

from hearth.llm.line_dedup import MIN_WORDS, dedup_lines, drop_repeated_lines


def brute(rows, least):
    """Every run of lines of at least ``least`` words, against all earlier places."""
    seen, out = {}, {}
    for i, t in rows:
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        body = [lines[k].strip() for k in at]
        gone = set()
        for a in range(len(body)):
            n = 0
            for b in range(a, len(body)):
                n += len(body[b].split())
                if n >= least:
                    if tuple(body[a:b + 1]) in seen:
                        gone.update(range(at[a], at[b] + 1))
                    else:
                        seen[tuple(body[a:b + 1])] = (i, a)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_equals_brute_force_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    got = {r.doc_id: r.text for r in drop_repeated_lines(df).collect()}
    assert got == brute(rows, MIN_WORDS)


def test_equals_brute_force_on_random_lines(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in drop_repeated_lines(df, min_words=8).collect()}
    assert got == brute(rows, 8)


def test_no_line_of_five_words_is_left_twice(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    out = drop_repeated_lines(df)
    lines = [x.strip() for r in out.collect() for x in (r.text or "").split("\n")]
    long = [x for x in lines if len(x.split()) >= MIN_WORDS]
    assert len(long) == len(set(long))
    before = {x.strip() for r in df.collect() for x in (r.text or "").split("\n") if x.strip()}
    assert {x for x in lines if x} >= {x for x in before if len(x.split()) >= MIN_WORDS}  # none is lost


def test_edges(edge, empty):
    out = drop_repeated_lines(edge)
    assert out.schema.simpleString() == edge.schema.simpleString() and out.count() == edge.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].text is None and got[4].text == "" and got[9].text == "" and got[9].n_chars == 0
    assert got[7].text == "" and len(got[6].text) > 100_000 and "passage1" in got[8].text
    spans = {r.doc_id: r.cuts for r in dedup_lines(edge).select("row.doc_id", "cuts").collect()}
    assert spans[9] == "0-1" and spans[8] == ""
    assert drop_repeated_lines(empty).count() == 0


def test_the_texts_are_joined_without_a_sort(spark):
    df = spark.createDataFrame([(i, f"one two three four five {i % 3}\nand a line {i}") for i in range(9)],
                               "doc_id long, text string")
    plan = dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("sorted", "")


def test_lines_are_read_as_python_reads_them():
    from hearth.llm.line_dedup import _Lines
    lines = _Lines([" a  b\u00a0c\n\u3000\n\ta b\r", "", "x\na  b\u00a0c d e f g "], 5)
    assert lines.text.tolist() == [0, 0, 2, 2] and lines.number.tolist() == [0, 2, 0, 1]
    assert [min(n, 5) for n in lines.words.tolist()] == [3, 2, 1, 5]
    assert len(set(lines.hash.tolist())) == 4 and lines.hash[0] == _Lines(["a  b\u00a0c"], 5).hash[0]
