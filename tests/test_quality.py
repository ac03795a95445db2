"""Data-quality checks: inject exactly one violation per rule, expect that row."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from hearth.operators import quality as Q


def test_not_null(spark):
    df = spark.createDataFrame([(1, "A", "NY"), (2, None, "NY"), (3, "C", "CT")],
                               "id int, borough_name string, state string")
    assert [r["id"] for r in Q.not_null(df, ["borough_name", "state"]).collect()] == [2]


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "k int, v string")
    assert [tuple(r) for r in Q.duplicate_keys(df, ["k"]).collect()] == [(2, 2)]
    comp = spark.createDataFrame([("Town", "CT"), ("Town", "NY"), ("Town", "CT")],
                                 "town_name string, state string")
    assert [tuple(r) for r in Q.duplicate_keys(comp, ["town_name", "state"]).collect()] == \
        [("Town", "CT", 2)]


def test_orphans(spark):
    child = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, fk int")
    parent = spark.createDataFrame([(10,), (11,)], "pk int")
    assert [r["id"] for r in Q.orphans(child, "fk", parent, "pk").collect()] == [2]


def test_too_long(spark):
    df = spark.createDataFrame([(1, "A"), (2, "AB")], "id int, violation_class string")
    assert [r["id"] for r in Q.too_long(df, {"violation_class": 1}).collect()] == [2]


def test_decimal_overflow(spark):
    df = spark.createDataFrame([(1, 12.5), (2, 123.45), (3, None), (4, 99.99)], "id int, x double")
    assert [r["id"] for r in Q.decimal_overflow(df, {"x": (4, 2)}).collect()] == [2]


def test_decimal_overflow_computes_a_value_once(spark):
    from hearth.functions import clean as C
    raw = spark.createDataFrame([(1, "$1,234"), (2, "1e20"), (3, None), (4, "x")], "id int, price string")
    typed = raw.select("id", C.clean_price("price").alias("price"), F.col("id").cast("double").alias("n"))
    out = Q.decimal_overflow(typed, {"price": (15, 2), "n": (2, 1)})
    assert out.columns == typed.columns and [tuple(r) for r in out.collect()] == [(2, 1e20, 2.0)]
    parsed = [df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") for df in (typed, out)]
    assert parsed[0] == parsed[1]


def test_defaults(spark):
    df = spark.createDataFrame([("T1", None), ("T2", "NY")], "town_name string, state string")
    got = sorted(map(tuple, Q.apply_defaults(df, {"state": "CT"}).collect()))
    assert got == [("T1", "CT"), ("T2", "NY")]


def test_rejects_counts(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, price int")
    got = dict(map(tuple, Q.rejects(df, {"missing": F.col("price").isNull(),
                                         "low": F.col("price") < 10}).collect()))
    assert got == {"missing": 1, "low": 1}


def test_outliers_are_reported_not_dropped(spark):
    df = spark.createDataFrame([(1, Decimal("100000"), Decimal("6100000")),
                                (2, Decimal("100000"), Decimal("150000"))],
                               "property_id int, low decimal(15,2), high decimal(15,2)")
    out = Q.outliers(df, ["property_id"], "low", "high", 20.0)
    assert [r["property_id"] for r in out.collect()] == [1]
    assert df.count() == 2


def test_star_reports_shape(spark, star_small):
    from hearth.registry_ops import STAR_TABLES
    rep = Q.primary_key_report(star_small, STAR_TABLES)
    assert rep.columns == Q.SUMMARY_COLS
    got = {(r[0], r[1]): r[3] for r in rep.collect()}
    assert got[("property", "duplicate_key")] == 0
    assert got[("borough", "duplicate_unique")] == 0
