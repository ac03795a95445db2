from __future__ import annotations

import duckdb
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from hearth.llm import registry
from hearth.llm.staging import stage

D = "/root/testdata/sf0.001"
# DuckDB finds a table it has no view of among the variables: the oracle of
# op12 also reads this one.
benchmark = pq.read_table(f"{D}/benchmark.parquet")


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{D}/documents.parquet")]
    for name, f in P.STAGES:
        docs.append(stage(f(spark, docs[-1], D), name))
    return docs


def test_stages_keep_the_columns_and_take_effect(steps):
    first = steps[0]
    for s in steps[:-1]:
        assert s.columns == first.columns
    ids = [{r[0] for r in s.select("doc_id").distinct().collect()} for s in steps]
    for a, b in zip(ids, ids[1:], strict=False):
        assert b <= a
    assert ids[1] == ids[0] and ids[2] == ids[1]  # all have a language; lines go, rows stay
    assert len(ids[3]) < len(ids[2]) and ids[5] == ids[4]
    assert steps[2].exceptAll(steps[1]).count() > 0


def test_no_benchmark_passage_is_left(spark, steps):
    bench = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    texts = [r.text or "" for r in steps[4].collect()]
    assert not [b for b in bench if any(b in t for t in texts)]


def test_run_equals_the_stages(spark, steps):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda df: sorted(tuple(r) for r in df.select(cols).collect())
    assert key(P.run(spark, D)) == key(steps[5])


def test_oracles_match(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, D)
        cols = sorted(df.columns)
        want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=repr)
        assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == want, name


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
