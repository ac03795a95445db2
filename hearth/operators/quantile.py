"""Exact ``PERCENTILE_CONT`` per group without holding a group in one task.

Spark's built-in ``percentile``/``median`` keep every distinct value of a
group in one aggregation buffer; a group holding a third of 100 TB would not
fit. Here:

1. values are counted per (group, value) — partial aggregation collapses
   repeats on the map side;
2. the counted values are cut into range blocks (see ``blocks``), and the
   blocks' totals (one row per group and block) say which one or two blocks of
   a group hold the ranks ``floor(q(n-1))`` and ``ceil(q(n-1))``;
3. only those blocks are ranked, and their two values interpolated. The rest
   of a group is never exchanged on the group.

Decimal input stays decimal, so the result is exact.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.operators.blocks import BLOCK, range_blocks


def value_counts(df: DataFrame, group: list[str], value: str,
                 weight: str | None = None) -> DataFrame:
    """(group, value, _w): NULL values dropped, as aggregates do."""
    w = F.col(weight) if weight else F.lit(1)
    return (df.where(F.col(value).isNotNull())
            .groupBy(*group, value).agg(F.sum(w).cast("long").alias("_w")))


def percentile_cont(df: DataFrame, group: list[str], value: str, q: float = 0.5,
                    alias: str = "percentile", weight: str | None = None,
                    partitions: int | None = None) -> DataFrame:
    """One row per group with a non-NULL value: (group..., alias)."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    vc = value_counts(df, group, value, weight)
    blocks = range_blocks(vc, [*group, value], partitions)
    # One row per (group, block): its weight and that of the blocks before.
    per = blocks.groupBy(*group, BLOCK).agg(F.sum("_w").alias("_bw"))
    upto = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    qd = F.lit(str(Decimal(str(q)))).cast("decimal(20,18)")
    pos = qd * (F.col("_n") - 1).cast("decimal(20,0)")
    spans = (per.withColumn("_end", F.sum("_bw").over(upto))
             .withColumn("_n", F.sum("_bw").over(Window.partitionBy(*group)))
             .select(*group, BLOCK, (F.col("_end") - F.col("_bw")).alias("_off"), "_end",
                     F.floor(pos).cast("long").alias("_k1"), F.ceil(pos).cast("long").alias("_k2"),
                     (pos - F.floor(pos)).alias("_frac")))

    def inside(k: str, lo: str, hi: str) -> Column:
        return (F.col(lo) <= F.col(k)) & (F.col(k) < F.col(hi))

    # At most two blocks of a group hold the wanted ranks; only they are ranked.
    wanted = spans.where(inside("_k1", "_off", "_end") | inside("_k2", "_off", "_end")).drop("_end")
    local = Window.partitionBy(*group, BLOCK).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (blocks.join(wanted, [*group, BLOCK])
              .withColumn("_hi", F.col("_off") + F.sum("_w").over(local))
              .withColumn("_lo", F.col("_hi") - F.col("_w")))
    hit = (ranked.where(inside("_k1", "_lo", "_hi") | inside("_k2", "_lo", "_hi"))
           .groupBy(*group)
           .agg(F.max(F.when(inside("_k1", "_lo", "_hi"), F.col(value))).alias("_v1"),
                F.max(F.when(inside("_k2", "_lo", "_hi"), F.col(value))).alias("_v2"),
                F.first("_frac").alias("_frac")))
    interp = F.col("_v1") + (F.col("_v2") - F.col("_v1")) * F.col("_frac")
    vtype = dict(df.dtypes)[value]
    if vtype.startswith("decimal"):
        out = interp.cast("decimal(38,12)")
    else:
        out = interp.cast("double")
    return hit.select(*group, out.alias(alias))
