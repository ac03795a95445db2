from __future__ import annotations

import hashlib
import re

from hearth.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for norm, g in groups.items():
        best = min(g)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(None if x[1] else x[2], None if best[1] else best[2], len(g), x == best, sha) for x in g]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in exact_dedup(df).collect()), key=repr)


def test_edges_equal_brute_force(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert result(edge) == brute(rows)


def test_long_common_prefixes_and_hot_group(spark):
    base = "x" * 40_000
    rows = ([(i, base) for i in range(60)] + [(100 + i, base + str(i)) for i in range(20)]
            + [(200 + i, base[:33]) for i in range(5)] + [(300, "é" * 17_000), (301, "é" * 17_000 + " ")])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute(rows)


def test_empty_table(empty):
    df = exact_dedup(empty)
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0
