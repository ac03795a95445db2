"""Co-located tables join without a shuffle of facts; sketches of loads merge."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from hearth.operators import quality as Q
from hearth.operators import sketches as K
from hearth.plans import reports as R
from hearth.plans.colocate import colocated_star, read_colocated, write_colocated
from hearth.plans.sketched import append_load, market_by_type


def _folder():
    return tempfile.mkdtemp(prefix="hearth-colocated-")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_need_no_shuffle_of_facts(spark, star_small):
    root = _folder()
    write_colocated(star_small, root, tables=["property", "sales_transaction", "price_history"], buckets=4)
    star = colocated_star(spark, star_small, root)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = star.sales_transaction.join(star.property, "property_id")
        assert "Exchange" not in _plan(joined) and "SortMergeJoin" in _plan(joined)
        for report in (R.avg_price_by_borough, R.price_gain):
            assert "hashpartitioning(property_id" not in _plan(report(star))
            assert "hashpartitioning(property_id" in _plan(report(star_small))
            assert report(star).collect() == report(star_small).collect()
        assert R.price_by_type(star).collect() == R.price_by_type(star_small).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


class _Hot:
    """A property that holds half of the sales."""

    def __init__(self, star):
        st = star.sales_transaction
        self.property = star.property
        self.sales_transaction = st.withColumn("property_id", F.when(
            F.col("transaction_id") % 2 == 0, F.lit(7).cast("long")).otherwise(F.col("property_id")))


def test_a_hot_property_is_not_read_by_one_task(spark, star_small):
    root, hot = _folder(), _Hot(star_small)
    write_colocated(hot, root, tables=["property", "sales_transaction"], buckets=32)
    got = read_colocated(spark, root)["sales_transaction"]
    assert "Bucketed: true" not in _plan(got)
    files = [f for f in os.listdir(os.path.join(root, "sales_transaction")) if f.endswith(".parquet")]
    sizes = spark.read.parquet(os.path.join(root, "sales_transaction")).where("property_id = 7").select(
        F.input_file_name().alias("f")).distinct().count()
    assert sizes == 4 and len(files) > 32
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, hot.sales_transaction.collect()), key=repr)


def test_sketches_of_two_loads_are_those_of_one(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 9_000).alias("k"),
                                    (F.hash("id") % 1000).cast("double").alias("v"))
    halves = [df.where(F.col("v") < 100), df.where(F.col("v") >= 100)]
    loads = [K.sketch(h, ["g"], {"k": "k"}, {"v": "v"}) for h in halves]
    two = K.estimate(K.merge(loads[0].unionByName(loads[1]), ["g"]), ["g"], ["v"]).collect()
    one = {r.g: r for r in K.estimate(K.sketch(df, ["g"], {"k": "k"}, {"v": "v"}), ["g"], ["v"]).collect()}
    assert len(two) == 2
    for r in two:
        assert r.v_n == one[r.g].v_n == 20_000
        for e in (r, one[r.g]):
            assert abs(e.k_distinct - 4500) <= 3 * K.DISTINCT_ERROR * 4500
            below = df.where((F.col("g") == r.g) & (F.col("v") <= e.v_median)).count()
            assert abs(below / 20_000 - 0.5) <= 2 * K.RANK_ERROR
    none = K.estimate(K.sketch(df.withColumn("v", F.lit(None).cast("double")), ["g"], {}, {"v": "v"}), ["g"], ["v"])
    assert [(r.v_n, r.v_median) for r in none.collect()] == [(0, None)] * 2
    assert K.merge(loads[0].limit(0), ["g"]).count() == 0


def test_market_from_the_sketches_of_loads(spark, star_small):
    path = os.path.join(tempfile.mkdtemp(prefix="hearth-sketch-"), "sales")
    assert append_load(star_small, path, "one") and append_load(star_small, path, "one") is None
    exact = {r.property_type: r for r in R.price_by_type(star_small).collect()}
    got = market_by_type(spark, path).collect()
    assert {r.property_type: r.num_sales for r in got} == {k: r.num_sales for k, r in exact.items()}
    for r in got:
        assert abs(r.median_price - exact[r.property_type].median_price) <= 0.1 * r.median_price


def test_all_keys_of_a_table_in_one_read(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "c", None), (None, "c", None), (None, "c", "y")],
                               "id int, town string, state string")
    rep = Q.key_report(df.repartition(3), "t", [
        ("duplicate_key", ["id"], True), ("duplicate_unique", ["town", "state"], True),
        ("duplicate_unique", ["town"], False)])
    assert _plan(rep).count("Scan ExistingRDD") == 1
    assert sorted(tuple(r)[1:] for r in rep.collect()) == [
        ("duplicate_key", "id", 1), ("duplicate_unique", "town", 1), ("duplicate_unique", "town,state", 0),
        ("null_key", "id", 2), ("null_key", "town,state", 2)]
    assert [r.violations for r in Q.key_report(df.limit(0), "t", [("duplicate_key", ["id"], True)]).collect()] == [0, 0]
