from __future__ import annotations

import re

from pyspark.sql import functions as F

from hearth.llm.secret_scan import _said, scan_secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def said(df):
    return [(r.text, r.b, r.s) for r in df.select(
        "doc_id", _said(F.col("base")).alias("b"), _said(F.col("all_spans")).alias("s"), F.col("text")).collect()]


def with_text(df):
    rows = df.select(F.monotonically_increasing_id().alias("doc_id"), "text", "source").persist()
    return scan_secrets(rows).join(rows.select("doc_id", "text"), "doc_id")


def test_base_spans_equal_brute_force(spark):
    texts = ["secret=token: abcdef1", "token=token=abcdef", "API_KEY : 'x/y.z=12' apikey=short", "😀 password=hunter2é",
             "AKIAAKIA" + "A" * 16, "AKIA" + "B" * 15, "0" * 23 + "g" + "f" * 24, "a" * 100 + "\n" + "PASSWD='abcdef'",
             None, "", "key password" + " " * 50 + "= " + '"abcdefgh"', "tokentoken:secret:password:abcdef", "x" * 200_000]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "source")
    df = spark.createDataFrame([(t, "s") for t in texts], "text string, source string").union(docs)
    got = said(with_text(df))
    assert len(got) == len(texts) + docs.count()
    for text, base, _ in got:
        assert base == base_spans(text), text
    assert sum(bool(b) for _, b, _ in got) >= 8


def test_ownership_separates_copied_from_owned(spark):
    own, shared = "Zx9kQw7LmN3pRt5VbY2cHd8f", "Ab3dEf6hIj9kLm2nOp5qRs8t"
    rows = [(1, f"see {own} here", "a"), (2, f"{own}", "a"), (3, f"{shared}", "a"), (4, f"x {shared}", "b"),
            (5, "token=" + own, None)]
    r = {x.doc_id: x for x in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))
         .withColumn("s", _said(F.col("all_spans"))).collect()}
    assert r[1].s == "owned:4:28" and r[2].s == "owned:0:24"
    assert r[3].s == "" and r[4].s == "" and r[3].n_copied == 1 and r[3].max_repositories == 2
    assert r[5].s == "assign:0:30" and r[5].n_live == 1


def test_edges(edge, empty):
    r = scan_secrets(edge).withColumn("b", _said(F.col("base"))).collect()
    assert len(r) == edge.count()
    assert [x.b for x in r if x.doc_id == 12] == ["assign:0:20,access:22:42,hex:43:75"]
    assert all(x.b == "" for x in r if x.doc_id != 12)
    assert scan_secrets(empty).count() == 0


def test_no_python_in_the_plan(edge):
    plan = scan_secrets(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_text_full_of_matches(spark):
    import time
    n = 100_000
    parts = [f"token={i:08x}Ab{i:014d}Zz {'0123456789abcdef' * 2} " for i in range(n // 2)]
    df = spark.createDataFrame([(1, "".join(parts), "s")], "doc_id long, text string, source string")
    start = time.time()
    r = scan_secrets(df).select("n_assign", "n_hex", F.col("base")[0].alias("a"), F.element_at("base", -1).alias("b")).first()
    assert (r.n_assign, r.n_hex) == (n // 2, n // 2)
    size = len(parts[0])
    assert (r.a.start, r.a.end) == (0, 32) and r.b.end == size * (n // 2) - 1
    assert time.time() - start < 60
