"""Data-quality jobs: the DDL's constraints checked as distributed queries.

A database rejects a bad row on insert; a lake accepts it. Each check here
returns the violating rows, computed with aggregations and anti joins —
nothing is collected. The ``*_report`` functions turn the checks over a whole
star into rows of (table, check, column, violations).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth import schemas as S
from hearth.operators.partitioning import keep_valid

SUMMARY_COLS = ["table_name", "check_name", "column_name", "violations"]


def not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """V1: rows with a NULL in any NOT NULL column."""
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.where(cond)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """V2/V3/V8: key values held by more than one row, with their row count."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") > 1))


def orphans(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """V4: child rows whose non-NULL foreign key has no parent row."""
    p = parent.select(F.col(parent_col).alias("_pk"))
    return (child.where(F.col(col).isNotNull())
            .join(p, F.col(col) == F.col("_pk"), "left_anti"))


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """V5: rows with a string longer than its VARCHAR/CHAR limit."""
    cond = reduce(lambda a, b: a | b,
                  [F.length(F.col(c)) > n for c, n in limits.items()])
    return df.where(cond)


def decimal_overflow(df: DataFrame, specs: dict[str, tuple[int, int]]) -> DataFrame:
    """V6: rows with a number that does not fit its NUMERIC(p, s). Numbers that
    ``df`` computes are computed once a row, not in each part of the test."""
    cond = reduce(lambda a, b: a | b,
                  [F.col(c).isNotNull() & F.col(c).try_cast(f"decimal({p},{s})").isNull()
                   for c, (p, s) in specs.items()])
    return keep_valid(df, cond)


def apply_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """V7: fill a column's DDL default where it is NULL."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c)
                       if c in defaults else F.col(c) for c in df.columns])


def rejects(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """V10: quarantine counts — rows failing each named condition.

    ``reasons`` maps a reason to a Column that is TRUE for a rejected row.
    Returns (reason, rows); one pass with conditional counts.
    """
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(r)
                      for r, c in reasons.items()])
    stack = ", ".join(f"'{r}', `{r}`" for r in reasons)
    return counts.selectExpr(f"stack({len(reasons)}, {stack}) as (reason, rows)")


def outliers(df: DataFrame, key: list[str], low: str, high: str, ratio: float) -> DataFrame:
    """V9: groups whose high/low ratio exceeds ``ratio`` — reported, never dropped."""
    return df.where(F.col(high) > F.col(low) * F.lit(ratio)).select(*key, low, high)


# ---- whole-star reports --------------------------------------------------
# Each report reads a table once: all column checks of a table are
# conditional counts of one aggregation, unpivoted into rows afterwards.
def _count(df: DataFrame, table: str, check: str, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("long").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(check).alias("check_name"),
        F.lit(column).alias("column_name"), "violations")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _counts_one_pass(df: DataFrame, table: str,
                     checks: list[tuple[str, str, Column]]) -> DataFrame:
    """One aggregation over ``df``: (table, check, column, rows where cond)."""
    aggs = [F.count_if(F.coalesce(cond, F.lit(False))).cast("long").alias(f"c{i}")
            for i, (_, _, cond) in enumerate(checks)]
    stack = ", ".join(f"'{chk}', '{col}', c{i}" for i, (chk, col, _) in enumerate(checks))
    return (df.agg(*aggs)
            .selectExpr(f"stack({len(checks)}, {stack}) as (check_name, column_name, violations)")
            .select(F.lit(table).alias("table_name"), "check_name", "column_name", "violations"))


def key_report(df: DataFrame, table: str, keys: list[tuple[str, list[str], bool]]) -> DataFrame:
    """Duplicate values of several keys of a table, ``(check, key, with_nulls)``,
    and with ``with_nulls`` the rows with a NULL key part.

    One scan and one shuffle for all keys: a row is expanded into one row per
    key (grouping sets), and the expanded rows are counted in the map tasks
    first, so a key value that a third of the rows hold is a row per task.
    """
    cols = list(dict.fromkeys(c for _, key, _ in keys for c in key))
    sets = list(dict.fromkeys(tuple(key) for _, key, _ in keys))
    rows = df.select(*cols)
    counted = F.count(F.lit(1)).alias("_n")
    per_key = (rows.groupBy(*cols).agg(counted, F.lit(0).cast("long").alias("_set")) if len(sets) == 1 else
               rows.groupingSets([[F.col(c) for c in key] for key in sets], *cols)
               .agg(counted, F.grouping_id().cast("long").alias("_set")))
    aggs, said = [], []
    for check, key, with_nulls in keys:
        mine = F.col("_set") == (0 if len(sets) == 1 else
                                 sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in key))
        any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        aggs.append(F.count_if(mine & ~any_null & (F.col("_n") > 1)))
        said.append((check, ",".join(key)))
        if with_nulls:
            aggs.append(F.coalesce(F.sum(F.when(mine & any_null, F.col("_n"))), F.lit(0)))
            said.append(("null_key", ",".join(key)))
    stack = ", ".join(f"'{check}', '{key}', c{i}" for i, (check, key) in enumerate(said))
    return (per_key.agg(*[a.cast("long").alias(f"c{i}") for i, a in enumerate(aggs)])
            .selectExpr(f"stack({len(said)}, {stack}) as (check_name, column_name, violations)")
            .select(F.lit(table).alias("table_name"), "check_name", "column_name", "violations"))


def primary_key_report(star, tables: list[str]) -> DataFrame:
    """Duplicate and NULL key values per table (PRIMARY KEY = unique + not null)
    and duplicates of its other unique keys; each table is read once."""
    return _union([key_report(getattr(star, t), t, [
        ("duplicate_key", S.PRIMARY_KEYS[t], True),
        *[("duplicate_unique", uk, False) for uk in S.UNIQUE_KEYS.get(t, [])]]) for t in tables])


def not_null_report(star, tables: list[str]) -> DataFrame:
    parts = [_counts_one_pass(getattr(star, t), t,
                              [("not_null", c, F.col(c).isNull()) for c in S.NOT_NULL[t]])
             for t in tables if S.NOT_NULL.get(t)]
    return _union(parts)


def foreign_key_report(star, tables: list[str], keys: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Rows without a parent per foreign key.

    All keys that refer to one parent are checked in one shuffle: its keys and
    those of its children are one tagged table, counted per key and tag. That
    is combined in the map tasks, so a key that a third of the rows hold is a
    row per task.
    """
    parents: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for child, col, parent, pcol in keys or S.FOREIGN_KEYS:
        if child in tables and parent in tables:
            parents.setdefault((parent, pcol), []).append((child, col))
    return _union([_parent_report(star, p, pcol, children) for (p, pcol), children in parents.items()])


def _parent_report(star, parent: str, pcol: str, children: list[tuple[str, str]]) -> DataFrame:
    """Per child the rows whose key the parent lacks. The tag of the parent is -1."""
    mine = getattr(star, parent).select(F.col(pcol).alias("k"), F.lit(-1).alias("tag"))
    parts = [mine] + [getattr(star, c).select(F.col(col).cast(mine.schema["k"].dataType).alias("k"),
                                              F.lit(i).alias("tag")) for i, (c, col) in enumerate(children)]
    counts = [F.count_if(F.col("tag") == i).alias(f"c{i}") for i in range(len(children))]
    per_key = _union(parts).where(F.col("k").isNotNull()).groupBy("k").agg(F.min("tag").alias("first"), *counts)
    total = per_key.where(F.col("first") >= 0).agg(
        *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).cast("long").alias(f"c{i}") for i in range(len(children))])
    stack = ", ".join(f"'{c}', '{col}', c{i}" for i, (c, col) in enumerate(children))
    return total.selectExpr(f"stack({len(children)}, {stack}) as (table_name, column_name, violations)").select(
        "table_name", F.lit(f"fk->{parent}").alias("check_name"), "column_name", "violations")


def length_report(star, tables: list[str]) -> DataFrame:
    parts = []
    for t in tables:
        df = getattr(star, t)
        checks = [(f"length>{n}", c, F.length(F.col(c)) > n)
                  for c, n in S.MAX_LENGTH.get(t, {}).items() if c in df.columns]
        if checks:
            parts.append(_counts_one_pass(df, t, checks))
    return _union(parts)
