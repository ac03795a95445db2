"""Raw file sources: CSV with header (every column STRING), landed JSON.

* The schema is given, never inferred: each column is a STRING and typing is
  left to the cleaners, so a bad cell cannot fail a scan or change a type.
* Headers can be normalised (strip, lower, blanks/dashes -> ``_``); it is a
  metadata-only rename.
* A source given by a glob keeps *every* match (``pathGlobFilter`` narrows
  the names); the file each row came from stays in ``_source_file`` when
  asked, so the choice of inputs stays visible.
* Reader missing-value tokens (``NA``, ``null``, ...) become NULL right
  after the scan, as the reference's reader did by default.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.functions.clean import MISSING_TOKENS, normalize_header, null_tokens
from hearth.operators.blocks import stage
from hearth.operators.dedup import with_ordinal
from hearth.sources import csvsplit


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
             glob: str | None = None, normalize: bool = False,
             multiline: bool = True, missing: list[str] | None = MISSING_TOKENS,
             ordinal: str | None = "_ord", source_file: bool = False,
             corrupt: str | None = None) -> DataFrame:
    """Read CSV files with header, all columns as STRING.

    Every file is read by its own header, so files of one glob may order
    their columns differently; a column that a file lacks is NULL for its
    rows. The headers are read by the tasks, in one job for all files.
    ``columns`` selects (and orders) the columns to keep after header
    normalisation. ``ordinal`` adds the ingest position used by keep-first
    dedup. Quoted line breaks belong to the record (``multiline``); files are
    split between tasks in either case (``hearth.sources.csvsplit``), files
    known to have no such breaks are spared the pass that cuts records.
    ``corrupt`` names a column that keeps the text of a malformed record (too
    few or too many fields), which is NULL for good ones.
    """
    headers, inside = csvsplit.inventory(spark, path, glob)
    if not headers:
        raise FileNotFoundError(f"no file matches {glob or '*'} in {path}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers.items():
        groups.setdefault(tuple(names), []).append(file)
    rows = None
    if multiline:
        rows = csvsplit.records(spark, path, glob, inside)
        if len(groups) > 1:
            rows = stage(rows, "csv_records")  # cut once for all headers
    parts = []
    for names, files in groups.items():
        if rows is not None:
            mine = rows.filter(F.col("file").isin(files)) if len(groups) > 1 else rows
            df = csvsplit.parsed(mine, list(names), corrupt)
            if ordinal:
                df = df.withColumn(ordinal, F.col("_at"))
            if source_file:
                df = df.withColumn("_source_file", F.col("_at.file"))
            df = df.drop("_at")
        else:
            df = _plain_csv(spark, files, names, ordinal, source_file, corrupt)
        extra = [c for c in (ordinal, "_source_file" if source_file else None, corrupt) if c]
        if normalize:
            df = df.toDF(*[normalize_header(c) if c in names else c for c in df.columns])
        parts.append(_selected(df, columns, extra, missing))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _plain_csv(spark: SparkSession, files: list[str], names: tuple[str, ...], ordinal: str | None,
               source_file: bool, corrupt: str | None) -> DataFrame:
    """Spark's own reader, a record per line."""
    fields = [T.StructField(n, T.StringType(), True) for n in (*names, corrupt) if n]
    r = (spark.read.schema(T.StructType(fields)).option("header", "true").option("escape", '"')
         .option("mode", "PERMISSIVE"))
    if corrupt:
        r = r.option("columnNameOfCorruptRecord", corrupt)
    df = r.csv(files)
    if ordinal:
        df = with_ordinal(df, ordinal)
    return df.withColumn("_source_file", F.col("_metadata.file_path")) if source_file else df


def _selected(df: DataFrame, columns: list[str] | None, extra: list[str],
              missing: list[str] | None) -> DataFrame:
    if columns is not None:
        have = set(df.columns)
        df = df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c)
                         for c in columns], *extra)
    if missing:
        df = df.select(*[null_tokens(c, missing).alias(c) if c not in extra else F.col(c)
                         for c in df.columns])
    return df


def json_records(lines: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """Records of JSON text lines: one object per line, bare or as the open-data
    portals export an array (``[{..}`` / ``,{..}`` / ``{..},`` / ``]``), so a
    large export still splits by line. Lines without an object are dropped;
    other columns of ``lines`` are kept."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    body = F.regexp_replace(F.regexp_replace(F.col(value), r"^\s*\[?\s*,?\s*(?=\{)", ""),
                            r"(?<=\})\s*,?\s*\]?\s*$", "")
    keep = [c for c in lines.columns if c != value]
    return (lines.withColumn("_body", body).where(F.col("_body").startswith("{"))
            .select(*keep, F.from_json("_body", schema).alias("_rec"))
            .select(*[F.col("_rec")[c].alias(c) for c in columns], *keep))


def read_json(spark: SparkSession, path: str, columns: list[str],
              ordinal: str | None = "_ord", document: bool = False) -> DataFrame:
    """Landed JSON exports, fields as STRING: one object per line, alone or in
    an array laid out by line. ``document`` reads files whose objects span
    several lines (one task per file)."""
    if document:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
        df = spark.read.schema(schema).option("multiLine", "true").json(path)
        return with_ordinal(df, ordinal) if ordinal else df
    lines = spark.read.text(path)
    return json_records(with_ordinal(lines, ordinal) if ordinal else lines, columns)


def read_star(spark: SparkSession, root: str, tables: list[str] | None = None) -> "StarTables":
    """The star model as written by ``hearth.sinks.publish_star``."""
    return StarTables(spark, root, tables)


class StarTables:
    """Attribute access to star tables stored as Parquet under one root."""

    def __init__(self, spark: SparkSession, root: str, tables: list[str] | None = None):
        self._spark, self._root = spark, root
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        p = os.path.join(self._root, name)
        return self._spark.read.parquet(p)
