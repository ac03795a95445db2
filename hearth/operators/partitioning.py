"""Partition-count helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small_input(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin spread before CPU-heavy row work when the input is too few splits.

    A large input already arrives as thousands of file splits and is left
    untouched (no shuffle). A small input stored as one file/row group would
    otherwise run every following narrow stage in one task. Whether it is
    small is read from the scan's size in the optimizer's statistics: no job
    runs and no plan is executed.
    """
    spark = df.sparkSession
    try:
        target = min_partitions or spark.sparkContext.defaultParallelism
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    except Exception:  # no JVM plan handle (e.g. a remote session): leave as is
        return df
    return df if scanned >= target * int(split) else df.repartition(target)


def keep_valid(df: DataFrame, ok) -> DataFrame:
    """Rows of ``df`` for which ``ok`` holds, tested on ``df``'s own columns.

    ``df.where(ok)`` lets the optimizer push the predicate below the
    projection that computed those columns, re-inlining every cleaner into
    the filter (each regex/date parse then runs twice per row) and past a
    round-robin spread into the scan task. Emitting the row through a
    generator (``inline`` of a zero- or one-element array) keeps the test on
    the computed values: each cleaner runs once, after the spread.
    """
    from pyspark.sql import functions as F
    cols = [F.col(c) for c in df.columns]
    return df.select(F.inline(F.when(ok, F.array(F.struct(*cols)))
                              .otherwise(F.array())))
