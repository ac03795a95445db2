"""Derived columns: trigger flag, price per sqft, composite score, percentages."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from hearth.functions import expr as X


def test_sold_below_assessment(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 200.0), (2, 300.0, 200.0), (3, None, 200.0), (4, 100.0, None), (5, 200.0, 200.0)],
        "i int, p double, a double")
    got = [r[0] for r in df.orderBy("i").select(X.sold_below_assessment("p", "a")).collect()]
    assert got == [True, False, False, False, False]


def test_price_per_sqft(spark):
    df = spark.createDataFrame(
        [(1, Decimal("100.01"), 2), (2, Decimal("500.00"), 0), (3, Decimal("500.00"), -5),
         (4, Decimal("500.00"), None), (5, Decimal("10.00"), 3)],
        "i int, p decimal(15,2), s int")
    got = [r[0] for r in df.orderBy("i").select(X.price_per_sqft("p", "s")).collect()]
    # half-up on the exact quotient: 50.005 -> 50.01
    assert got == [Decimal("50.01"), None, None, None, Decimal("3.33")]


def test_quality_score_edges(spark):
    rows = [
        (0, 0, None, "100.00"), (100, 0, None, "50.00"), (101, 0, None, "50.00"),
        (0, 300, None, "70.00"), (0, 301, None, "70.00"), (0, 0, "1", "100.00"),
        (200, 400, "0", "20.00"), (200, 400, "1", "50.00"), (None, None, None, "100.00"),
        (10, 10, "0.5", "100.00"), (90, 250, "0.333", "39.99"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)],
                               "i int, v int, c int, a string")
    got = [r[0] for r in df.orderBy("i").select(
        X.quality_score("v", "c", F.col("a").cast("decimal(5,3)"))).collect()]
    assert got == [Decimal(r[3]) for r in rows]


def test_quality_score_monotone_in_violations(spark):
    df = spark.range(0, 200).select(F.col("id").cast("int").alias("v"))
    vals = [r[0] for r in df.orderBy("v").select(
        X.quality_score("v", F.lit(10), F.lit(0.8))).collect()]
    assert all(a >= b for a, b in zip(vals, vals[1:]))
    assert all(Decimal(0) <= v <= Decimal(100) for v in vals)


def test_pct_change_null_on_zero_start(spark):
    df = spark.createDataFrame([(1, Decimal("0.00"), Decimal("5.00")),
                                (2, Decimal("200.00"), Decimal("150.00"))],
                               "i int, s decimal(15,2), e decimal(15,2)")
    got = [r[0] for r in df.orderBy("i").select(X.pct_change("s", "e", 1)).collect()]
    assert got[0] is None and got[1] == Decimal("-25.0")


def test_month_start(spark):
    assert spark.range(1).select(X.month_start("2024-06-15")).first()[0].isoformat() == "2024-06-01"
