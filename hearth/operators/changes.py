"""Changes to published tables: keys that survive a load, rows that are updated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.operators.blocks import stage
from hearth.operators.keys import dense_keys


def stable_keys(df: DataFrame, published: DataFrame, natural: list[str], key: str = "id") -> DataFrame:
    """``df`` (one row per natural key) with ``key``: the published one where
    the natural key has it, else numbered on after the largest published key in
    the order of the natural key. NULL parts of a natural key equal each other.

    Only the natural keys and ids of the published table are shuffled. The
    result is written once, so that a retried task cannot number rows anew.
    """
    old = published.select(*[F.col(c).alias(f"_o_{c}") for c in natural], F.col(key).alias("_old"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in natural])
    rows = stage(df.join(old, same, "left").select(F.col("_old").cast("long").alias(key), *df.columns), "known_keys")
    start = (published.agg(F.max(key)).first()[0] or 0) + 1
    new = dense_keys(rows.where(F.col(key).isNull()).drop(key), natural, key=key, start=start)
    return stage(rows.where(F.col(key).isNotNull()).unionByName(new), "stable_keys")


def apply_changes(base: DataFrame, changes: DataFrame, key: list[str], version: list[str],
                  derive: dict[str, Column] | None = None) -> DataFrame:
    """The table after inserts and updates: per ``key`` the newest row of
    ``base`` and ``changes``, in the columns of ``base``.

    ``version`` orders the changes of a key (ties: the larger row, column by
    column); a base row is older than any change. A column that ``changes``
    lacks, or leaves NULL, keeps its newest value that is not NULL, as an UPDATE
    of the other columns would. ``derive`` are columns computed anew from the
    resulting row, as a trigger on insert and update does.

    One aggregation, combined in the map tasks: a key with many changes costs
    one row per task.
    """
    derive = derive or {}
    cols = [c for c in base.columns if c not in key]
    kept = [c for c in cols if c not in derive]
    none = lambda c: F.lit(None).cast(changes.schema[c].dataType)
    order = F.struct("_new", *[f"_v{i}" for i in range(len(version))])
    old = base.select(*key, *kept, F.lit(0).alias("_new"), *[none(v).alias(f"_v{i}") for i, v in enumerate(version)])
    new = changes.select(*key, *[c for c in kept if c in changes.columns], F.lit(1).alias("_new"),
                         *[F.col(v).alias(f"_v{i}") for i, v in enumerate(version)])
    rows = old.unionByName(new, allowMissingColumns=True)
    newest = rows.groupBy(*key).agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in kept])
    return newest.select(*[derive[c].alias(c) if c in derive else F.col(c) for c in base.columns])
