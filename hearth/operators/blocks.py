"""Range blocks: the shared basis of distributed ranking.

Ranking a table (dense keys, exact quantiles) needs the position of each row
in a global order. A window ordered over a whole group would put that group
into one task, so instead the rows are range-partitioned on the order; each
range partition becomes a *block* of bounded size, ranked locally, and
shifted by the total of the blocks before it (a table of one row per block).
A hot group simply spans many blocks.

The block id is taken from the partition index right after the range
shuffle, and the tagged rows are written as Parquet under the shared
checkpoint folder (``spark.checkpoint.dir``) and read back before use, so a
recomputed task can never see a different split and the lineage is cut.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import scratch_path

BLOCK = "_blk"
# Target bytes per block when the input is too large for the configured
# shuffle partition count (a block is ranked by one task).
BLOCK_TARGET_BYTES = 128 * 1024 * 1024
# In-memory bytes of a row per byte of a compressed columnar scan.
EXPANSION = 4


def block_count(df: DataFrame, target_bytes: int = BLOCK_TARGET_BYTES) -> int | None:
    """Blocks needed for ``df`` from the optimizer's size estimate (no job).

    None when ``spark.sql.shuffle.partitions`` blocks already fit the target:
    AQE then merges adjacent small ranges. AQE never splits a range, so a
    large input gets an explicit count of ``size / target`` blocks.
    """
    spark = df.sparkSession
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        est = int(str(plan.stats().sizeInBytes()))
        leaves = plan.collectLeaves()
        scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes()))
                      for i in range(leaves.size()))
    except Exception:  # no JVM plan handle (remote session)
        return None
    # Without CBO a join is estimated as the product of its sides; the rows
    # ranked here (value counts, key sets) never exceed what was scanned.
    est = min(est, scanned * EXPANSION)
    if est >= 2 ** 62:  # no statistics (the default estimate is Long.MaxValue)
        return None
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    need = -(-est // target_bytes)
    return int(need) if need > base else None


def range_blocks(df: DataFrame, order: list[Column | str],
                 partitions: int | None = None) -> DataFrame:
    """``df`` plus a ``_blk`` column; blocks are contiguous in ``order``.

    Without ``partitions`` the count comes from ``block_count``: a small
    input is left to AQE, which merges adjacent ranges up to the advisory
    partition size (merged blocks stay contiguous); a large one gets
    ``size / 128 MB`` blocks. Either way a block, and so a ranking task, is
    bounded in bytes however many rows one group holds.
    """
    n = partitions or block_count(df)
    ranged = df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)
    tagged = ranged.withColumn(BLOCK, F.spark_partition_id())
    return stage(tagged, "blocks")


_SCOPE: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging_scope(spark):
    """Own the folders staged inside: they are deleted at the end, also after
    a failure. Folders staged outside the scope, or in another, are not touched.

    Plans built inside read those folders, so write their results inside too.
    """
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: later branches reuse the rows instead of recomputing them,
    and the lineage is cut (a lost executor re-reads, it does not re-derive).
    The folder belongs to the enclosing ``staging_scope``; without one it
    stays until the cluster cleans its checkpoint folder."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    paths = _SCOPE.get()
    if paths is not None:
        paths.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def block_offsets(blocks: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """Per (group, block): the summed weight of earlier blocks of the group.

    The input to the window is one row per (group, block), so its size is
    bounded by groups + blocks, not by the data.
    """
    per = blocks.groupBy(*group, BLOCK).agg(F.sum(weight).alias("_bw"))
    w = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, -1)
    return per.select(*group, BLOCK,
                      F.coalesce(F.sum("_bw").over(w), F.lit(0)).cast("long").alias("_off"))
