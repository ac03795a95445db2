"""Driver contract and Spark-vs-DuckDB equality on the smallest scale factor."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from hearth import registry

from .conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["score_id", "zip_code", "score_month", "violation_count",
                          "complaint_count", "avg_school_attendance", "median_sale_price",
                          "pct_sold_below_assessment", "quality_score"]


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return con


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float) and math.isnan(x):
            return "nan"
        return x.isoformat() if hasattr(x, "isoformat") else x
    return sorted((tuple(v(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(registry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(srows, df.columns) == _norm(drows, dcols)
