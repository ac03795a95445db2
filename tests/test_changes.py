"""Later loads: stable keys, applied changes, batches that are appended once, file sizes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from hearth.functions import expr as X
from hearth.operators import quality as Q
from hearth.operators.changes import apply_changes, stable_keys
from hearth.operators.keys import dense_keys
from hearth.sinks import append_batch, read_batches, write_sized


def test_keys_survive_two_more_loads(spark):
    def load(rows):
        return spark.createDataFrame(rows, "address string, zip string")
    one = [("b", "1"), ("a", "1"), ("c", None)]
    numbered = dense_keys(load(one), ["zip", "address"], key="pid").collect()
    first = spark.createDataFrame(numbered, "pid long, address string, zip string")
    ids = {(r.address, r.zip): r.pid for r in first.collect()}
    second = stable_keys(load([*one[1:], ("z", None), ("0", "0")]), first, ["zip", "address"], "pid")
    got = {(r.address, r.zip): r.pid for r in second.collect()}
    assert got[("a", "1")] == ids[("a", "1")] and got[("c", None)] == ids[("c", None)]
    assert (got[("z", None)], got[("0", "0")]) == (4, 5)
    third = stable_keys(load([("z", None), ("y", "9")]), second, ["zip", "address"], "pid")
    assert {(r.address, r.pid) for r in third.collect()} == {("z", 4), ("y", 6)}
    assert stable_keys(load([("q", "1")]), first.limit(0), ["zip", "address"], "pid").first().pid == 1


def test_changes_insert_update_and_flag(spark):
    base = spark.createDataFrame([(1, 100.0, 120.0, True), (2, 50.0, None, False), (3, 9.0, 1.0, False)],
                                 "id long, price double, assessed double, below boolean")
    ch = spark.createDataFrame(
        [(1, 2, 90.0, 80.0), (1, 1, 1.0, 200.0), (2, 1, None, 60.0), (4, 1, 10.0, 20.0), (4, 1, 11.0, None)],
        "id long, v int, price double, assessed double")
    out = apply_changes(base, ch, ["id"], ["v"], {"below": X.sold_below_assessment("price", "assessed")})
    assert out.columns == base.columns
    assert sorted(map(tuple, out.collect())) == [
        (1, 90.0, 80.0, False), (2, 50.0, 60.0, True), (3, 9.0, 1.0, False), (4, 11.0, 20.0, True)]
    again = apply_changes(out, ch, ["id"], ["v"], {"below": X.sold_below_assessment("price", "assessed")})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))  # a retry changes nothing
    assert apply_changes(base, ch.limit(0), ["id"], ["v"]).count() == 3


def test_a_batch_is_appended_once(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="hearth-batch-"), "t")
    df = spark.range(10).toDF("a")
    assert append_batch(df, path, "2025/01") == 10
    assert append_batch(df, path, "2025/01") is None
    assert append_batch(df.select("a", F.lit("x").alias("b")), path, "2025/02") == 10
    df.write.parquet(os.path.join(path, "batch-broken-off"))  # written, never committed
    got = read_batches(spark, path)
    assert got.count() == 20 and got.where("b is null").count() == 10


def test_files_of_a_set_size(spark):
    root = tempfile.mkdtemp(prefix="hearth-sized-")
    df = spark.range(0, 40_000, 1, 40).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert write_sized(df, f"{root}/few", 400_000) == 40_000
    files = [os.path.getsize(f"{root}/few/{f}") for f in os.listdir(f"{root}/few") if f.endswith(".parquet")]
    assert 4 <= len(files) <= 9 and min(files) > 150_000
    assert write_sized(df.coalesce(1), f"{root}/more", 400_000) == 40_000
    files = [os.path.getsize(f"{root}/more/{f}") for f in os.listdir(f"{root}/more") if f.endswith(".parquet")]
    assert len(files) > 4 and max(files) < 800_000
    for name in ("few", "more"):
        assert spark.read.parquet(f"{root}/{name}").agg(F.count_distinct("id")).first()[0] == 40_000
    assert sorted(os.listdir(root)) == ["few", "more"]


class _Star:
    pass


def test_foreign_keys_of_one_parent_in_one_shuffle(spark):
    s = _Star()
    s.p = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    s.a = spark.createDataFrame([(1,), (3,), (3,), (None,)], "pk long")
    s.b = spark.createDataFrame([(2,), (4,)], "pk int")
    keys = [("a", "pk", "p", "k"), ("b", "pk", "p", "k"), ("c", "pk", "p", "k")]
    out = Q.foreign_key_report(s, ["a", "b", "p"], keys)
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(k") == 1
    assert {(r.table_name, r.check_name, r.column_name, r.violations) for r in out.collect()} == {
        ("a", "fk->p", "pk", 2), ("b", "fk->p", "pk", 1)}
