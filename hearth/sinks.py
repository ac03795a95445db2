"""Sinks: Parquet writes with an all-or-nothing publish.

The reference truncates every table, commits, then appends table by table;
a failure half way leaves a half-loaded model. Here a load writes all
tables into a fresh run folder and then moves one small pointer file
(``_CURRENT``) to it. Readers resolve the pointer, so they see either the old
or the new model, never a mix. Re-running a failed load just writes a new
run folder. Row counts are gathered with ``observe`` during the write, so no
second pass is needed.
"""

from __future__ import annotations

import datetime as _dt
import os
import urllib.parse
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p, jvm


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None,
                max_records_per_file: int | None = None,
                count: bool = True) -> int | None:
    """Write one table as Parquet; return its row count (observed in the write)."""
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}") if count else None
    out = df.observe(obs, F.count(F.lit(1)).alias("rows")) if obs else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)
    return int(obs.get["rows"]) if obs else None


def append_table(df: DataFrame, path: str, **kw) -> int | None:
    """Append rows to an existing table folder (columns matched by name). A
    retry appends them again; ``append_batch`` does not."""
    return write_table(df, path, mode="append", **kw)


MANIFEST = "_batches"


def append_batch(df: DataFrame, path: str, batch: str, **kw) -> int | None:
    """Append ``df`` as the batch of that name, once: a batch that is already
    in the table is left as it is, whoever appends it again.

    The rows go to a folder of their own; then one small file ``_batches/<name>``
    with that folder's name is created, which only one writer can do. Readers
    (``read_batches``) go by these files, so a write that broke off, or that
    came second, is never read. Returns the rows written, None for a batch that
    was there.
    """
    spark = df.sparkSession
    fs, _, jvm = _fs(spark, path)
    mark = jvm.org.apache.hadoop.fs.Path(os.path.join(path, MANIFEST, urllib.parse.quote(batch, safe="")))
    if fs.exists(mark):
        return None
    folder = f"batch-{uuid.uuid4().hex}"
    rows = write_table(df, os.path.join(path, folder), **kw)
    try:
        stream = fs.create(mark, False)  # fails if it exists
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getSimpleName():
            raise
        fs.delete(jvm.org.apache.hadoop.fs.Path(os.path.join(path, folder)), True)
        return None
    stream.write(bytearray(folder.encode()))
    stream.close()
    return rows


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches of a table written by ``append_batch``."""
    names = [r["value"] for r in spark.read.text(os.path.join(path, MANIFEST)).collect()]
    return spark.read.option("mergeSchema", "true").parquet(*[os.path.join(path, n) for n in sorted(names)])


def write_sized(df: DataFrame, path: str, target_bytes: int = 256 << 20, **kw) -> int | None:
    """Write a table in files of about ``target_bytes`` as they are on disk.

    What a row takes in Parquet is known once it is written, so the table is
    written as its tasks come, measured, and written again only if its files
    are too small or too large: then as many equal files as its bytes call for.
    """
    spark = df.sparkSession
    rows = write_table(df, path, **kw)
    fs, p, jvm = _fs(spark, path)
    size = fs.getContentSummary(p)
    wanted = max(1, -(-size.getLength() // target_bytes))
    files = sum(1 for f in spark.read.parquet(path).inputFiles())
    if wanted <= files * 2 and files <= wanted * 2:
        return rows
    again = f"{path.rstrip('/')}.sized-{uuid.uuid4().hex[:8]}"
    table = spark.read.parquet(path)
    # Fewer files need no shuffle; more do.
    table = table.coalesce(wanted) if wanted < files else table.repartition(wanted)
    kw.pop("count", None)
    write_table(table, again, count=False, **kw)
    fs.delete(p, True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(again), p):
        raise OSError(f"could not replace {path}")
    return rows


def new_run(root: str) -> str:
    """A fresh, unpublished run folder under ``root``."""
    run = f"run-{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    return os.path.join(root, run)


def write_run(run_dir: str, tables: dict[str, DataFrame],
              partition_by: dict[str, list[str]] | None = None) -> dict[str, int | None]:
    """Write tables into an unpublished run folder, in files of a set size;
    returns row counts. (A partitioned table has a file per task and value.)"""
    parts = partition_by or {}
    return {name: write_table(df, os.path.join(run_dir, name), partition_by=parts[name]) if name in parts
            else write_sized(df, os.path.join(run_dir, name))
            for name, df in tables.items()}


def switch_to(spark: SparkSession, run_dir: str) -> None:
    """Publish a fully written run folder (one pointer file is replaced)."""
    root, run = os.path.split(run_dir.rstrip("/"))
    _write_pointer(spark, root, run)


def publish_star(spark: SparkSession, root: str, tables: dict[str, DataFrame],
                 partition_by: dict[str, list[str]] | None = None) -> dict[str, int | None]:
    """Write all tables into ``root/run-<id>/`` then point ``root/_CURRENT`` at it."""
    run_dir = new_run(root)
    counts = write_run(run_dir, tables, partition_by)
    switch_to(spark, run_dir)
    return counts


def _write_pointer(spark: SparkSession, root: str, run: str) -> None:
    """Write the run name to a temp file, then rename it over ``_CURRENT``.

    ``FileContext.rename`` with OVERWRITE replaces the pointer in one step on
    file systems that support it (HDFS); elsewhere it falls back to delete +
    rename of a tiny file.
    """
    fs, _, jvm = _fs(spark, root)
    Path = jvm.org.apache.hadoop.fs.Path
    tmp = Path(os.path.join(root, f".{POINTER}.{uuid.uuid4().hex}"))
    dst = Path(os.path.join(root, POINTER))
    stream = fs.create(tmp, True)
    stream.write(bytearray(run.encode("utf-8")))
    stream.close()
    try:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), conf)
        opts = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        fc.rename(tmp, dst, opts)
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getSimpleName().startswith("Unsupported"):
            raise  # the old pointer stays in place
        fs.delete(dst, False)
        if not fs.rename(tmp, dst):
            raise OSError(f"could not publish {run} under {root}")


def current_run(spark: SparkSession, root: str) -> str:
    """Folder of the published model under ``root``."""
    fs, _, jvm = _fs(spark, root)
    p = jvm.org.apache.hadoop.fs.Path(os.path.join(root, POINTER))
    stream = fs.open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    name = reader.readLine().strip()
    reader.close()
    return os.path.join(root, name)
