"""Operators checked against brute force on small, skewed fixtures."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearth.operators import joins as J
from hearth.operators.dedup import Order, distinct_on, keep_first
from hearth.operators.keys import dense_keys
from hearth.operators.quantile import percentile_cont
from hearth.operators.reshape import first_metrics, melt, month_columns


def _skewed_values(n=3000, seed=7):
    """Groups a..e, group 'a' holds a third of the rows; some NULL values."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = "a" if i % 3 == 0 else rnd.choice("bcde")
        v = None if i % 97 == 0 else round(rnd.uniform(0, 1000), 2)
        if i % 11 == 0 and v is not None:
            v = 500.0  # repeated values
        out.append((i, g, v))
    return out


@pytest.mark.parametrize("q,blocks", [(0.0, None), (0.25, 7), (0.5, None), (0.5, 13),
                                      (0.9, 7), (1.0, 5)])
def test_percentile_cont_matches_numpy(spark, q, blocks):
    data = _skewed_values()
    df = spark.createDataFrame(data, "i int, g string, v double")
    got = {r["g"]: r["p"] for r in percentile_cont(df, ["g"], "v", q, alias="p",
                                                   partitions=blocks).collect()}
    for g in "abcde":
        vals = np.array([v for _, gg, v in data if gg == g and v is not None])
        assert got[g] == pytest.approx(float(np.quantile(vals, q)), abs=1e-9)


def test_percentile_cont_decimal_exact_and_weighted(spark):
    rows = [("x", Decimal("1.00"), 3), ("x", Decimal("2.01"), 1), ("y", Decimal("5.00"), 2),
            ("y", Decimal("6.01"), 2)]
    df = spark.createDataFrame(rows, "g string, v decimal(15,2), w long")
    got = {r["g"]: r["p"] for r in percentile_cont(df, ["g"], "v", 0.5, alias="p", weight="w")
           .collect()}
    # x: 1,1,1,2.01 -> median 1.00; y: 5,5,6.01,6.01 -> 5.505 exactly
    assert got["x"] == Decimal("1.00") and got["y"] == Decimal("5.505")


def test_percentile_cont_equals_builtin(spark):
    df = spark.createDataFrame(_skewed_values(), "i int, g string, v double")
    ours = {r[0]: r[1] for r in percentile_cont(df, ["g"], "v", 0.5, alias="p").collect()}
    theirs = {r[0]: r[1] for r in df.groupBy("g").agg(F.median("v")).collect()}
    assert ours.keys() == theirs.keys()
    for k in ours:
        assert ours[k] == pytest.approx(theirs[k], abs=1e-9)


def test_distinct_on_equals_window(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("pqr"), rnd.choice([None, 1, 2]), rnd.choice([None, 10.0, 20.0, 30.0]), i)
            for i in range(400)]
    df = spark.createDataFrame(data, "a string, b int, price double, id int")
    ours = distinct_on(df, ["a", "b"], [Order("price", desc=True), Order("id")])
    w = Window.partitionBy("a", "b").orderBy(F.col("price").desc_nulls_first(), F.col("id").asc())
    ref = df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(map(tuple, ref.collect()), key=repr)


def test_keep_first(spark):
    df = spark.createDataFrame([("z1", "first", 5), ("z1", "second", 9), ("z2", "only", 1),
                                ("z1", "zeroth", 2)], "k string, v string, o int")
    got = dict(map(tuple, keep_first(df, ["k"], "o").select("k", "v").collect()))
    assert got == {"z1": "zeroth", "z2": "only"}


def test_dense_keys_range_and_window(spark):
    rnd = random.Random(5)
    names = [f"addr{rnd.randint(0, 10**6):07d}" for _ in range(2000)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], "n string, i int")
    for method, blocks in (("range", None), ("range", 9), ("window", None)):
        got = sorted((r["id"], r["n"]) for r in
                     dense_keys(df, ["n"], method=method, partitions=blocks).collect())
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        assert [g[1] for g in got] == sorted(g[1] for g in got)


def test_melt_and_month_columns(spark):
    wide = spark.createDataFrame([("00001", "1.5", None, "3"), ("00002", None, "2", None)],
                                 "zip string, `2019-12-31` string, `2020-01-31` string, `2020-02-29` string")
    months = month_columns(wide.columns, "20", "2020")
    assert months == ["2020-01-31", "2020-02-29"]
    got = sorted(map(tuple, melt(wide, ["zip"], months, "m", "v").collect()))
    assert got == [("00001", "2020-02-29", "3"), ("00002", "2020-01-31", "2")]


def test_melt_then_pivot_is_identity(spark):
    long = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", 2.0), ("b", "m1", 3.0)],
                                 "k string, m string, v double")
    wide = long.groupBy("k").pivot("m", ["m1", "m2"]).agg(F.first("v"))
    back = melt(wide, ["k"], ["m1", "m2"], "m", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_first_metrics(spark):
    rows = [("s1", "att", "0.9", "n1", 3), ("s1", "att", "0.1", "n1b", 7), ("s1", "abs", "0.2", "x", 1),
            ("s2", "abs", "0.3", "n2", 2),           # no primary metric -> dropped
            ("s3", "att", "0.5", "n3", 4)]           # no secondary -> NULL
    df = spark.createDataFrame(rows, "dbn string, metric string, val string, name string, o int")
    got = sorted(map(tuple, first_metrics(df, "dbn", "metric", "val", "o", "att", "abs",
                                          carry=["name"]).collect()))
    assert got == [("s1", "n1", "0.9", "0.2"), ("s3", "n3", "0.5", None)]


def test_fanout_counts_and_resolution(spark):
    feed = spark.createDataFrame([(1, "A", "z"), (2, "A", "z"), (3, "A", "z"), (4, "B", "z"),
                                  (5, None, "z"), (6, None, "z")], "src int, address string, zip string")
    fan = {(r[0], r[1]): (r[2], r[3]) for r in J.fanout_counts(feed, ["address", "zip"]).collect()}
    assert fan[("A", "z")] == (3, 9) and fan[("B", "z")] == (1, 1) and fan[(None, "z")] == (2, 4)
    assert sum(v[1] for v in fan.values()) == 9 + 1 + 4
    props = spark.createDataFrame([(10, "A", "z"), (11, "B", "z"), (12, None, "z")],
                                  "property_id int, address string, zip string")
    strict = J.resolve_keys(feed, props, ["address", "zip"])
    assert sorted(r["src"] for r in strict.collect()) == [1, 2, 3, 4]
    loose = J.resolve_keys(feed, props, ["address", "zip"], null_safe=True)
    assert sorted(r["src"] for r in loose.collect()) == [1, 2, 3, 4, 5, 6]


def test_semi_anti(spark):
    df = spark.createDataFrame([(1, "00001"), (2, "00099"), (3, None)], "i int, zip string")
    dim = spark.createDataFrame([("00001",)], "zip string")
    assert [r["i"] for r in J.semi_known(df, dim, "zip").collect()] == [1]
    assert [r["i"] for r in J.anti_orphans(df, dim, "zip").collect()] == [2]


def test_block_count_follows_input_size(spark):
    from hearth.operators.blocks import block_count
    assert block_count(spark.range(1000)) is None            # AQE sizes small inputs
    big = block_count(spark.range(10 ** 10))                 # ~80 GB by the estimate
    assert big is not None and big > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert block_count(spark.createDataFrame([(1,)], "a int")) is None
