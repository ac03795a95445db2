"""Intermediate tables in the cluster's shared folder, and row keys."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import scratch_path

BATCH_ROWS = 1000


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back;
    ``options`` are the writer's.

    Later steps reuse the rows instead of deriving them again, the lineage is
    cut, and a lost executor costs a re-read only. The folder must outlive
    every plan that reads the returned frame, so it is left for the cluster's
    clean-up of that folder; ``unstage`` removes it earlier.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**(options or {})).mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no plan needs any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free(*tables: DataFrame) -> None:
    """Delete staged tables that no plan needs any more, and let Spark's
    cleaner see that the shuffles behind them are unused: it learns so from
    the driver's garbage collection, which on its own may come much later."""
    for df in tables:
        unstage(df)
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the data: sorted and merged at
    every size, so a plan tried on little data is the plan at scale. A skewed
    key is split by the adaptive join if both sides are plain staged tables."""
    return left.join(right.hint("merge"), on, how)


def hashed(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """A join of a table of whole texts with one that has a small row for each
    of some keys: both are shuffled at every size, and a partition of the small
    rows is held as a hash table, so the texts need no sort. A partition is the
    less the more shuffle partitions there are."""
    return left.join(right.hint("shuffle_hash"), on, how)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def library_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it,
    for sessions that were started elsewhere and did not ship it, and hand
    them batches of at most ``BATCH_ROWS`` rows, as rows are whole texts."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), home])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str):
    """The column as a string, null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
