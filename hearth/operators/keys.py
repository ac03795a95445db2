"""Surrogate keys (the DDL's SERIAL columns) assigned in the cluster.

``dense_keys`` numbers rows 1..n in the order of a natural key. Large
tables use range blocks: rank within a block, shift by the size of earlier
blocks — no window over the whole table. ``method="window"`` is for
dimensions whose size is bounded by the domain (zips, towns), where one
ordered window is the cheaper plan.

Keys must be assigned once and the result reused (write it, or checkpoint);
never re-derive ids with ``monotonically_increasing_id`` on both sides of a
join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.operators.blocks import BLOCK, block_offsets, range_blocks


def dense_keys(df: DataFrame, order: list[str], key: str = "id",
               method: str = "range", start: int = 1,
               partitions: int | None = None) -> DataFrame:
    """``df`` with ``key`` = start + position in ``order`` (ties: arbitrary)."""
    if method == "window":
        w = Window.orderBy(*order)
        return df.select((F.row_number().over(w) + (start - 1)).cast("long").alias(key), *df.columns)
    if method != "range":
        raise ValueError(method)
    blocks = range_blocks(df, list(order), partitions)
    offs = block_offsets(blocks.withColumn("_g", F.lit(0)), ["_g"], F.lit(1)).drop("_g")
    local = Window.partitionBy(BLOCK).orderBy(*order)
    return (blocks.withColumn("_r", F.row_number().over(local))
            .join(offs, BLOCK)
            .select((F.col("_off") + F.col("_r") + (start - 1)).cast("long").alias(key),
                    *df.columns))
