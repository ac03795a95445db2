"""Quoted CSV read by many tasks per file.

A line break inside quotes does not end a record, so a reader that starts in
the middle of a file cannot tell from its own bytes where records begin; Spark
therefore reads a ``multiLine`` file in one task. Whether a place is inside
quotes is the parity of the quotes before it, and parities add up:

1. One pass over the lines gives each split its number of quotes (odd or even)
   and each file its header record. That is a row per split.
2. A prefix sum over the splits of a file tells for every split whether it
   begins inside quotes.
3. A second pass cuts each split into records. A record that crosses the end
   of a split comes as pieces, at most two per split, which are put together
   by a window over the pieces alone.

The records are then parsed by ``from_csv``. Doubled quotes count twice, which
leaves the parity as it is. No text is shuffled but the pieces.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.session import library_on_workers



def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    library_on_workers(spark)
    r = spark.read.option("lineSep", "\n")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                F.col("_metadata.file_block_start").alias("start"))


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array, np.ndarray]]:
    """The lines of a batch per split, with their number of quotes."""
    file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = file.indices.to_numpy()
    edge = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    quotes = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(code)], strict=True):
        if b > a:
            yield (file.dictionary[code[a]].as_py(), int(start[a])), batch.column("value").slice(a, b - a), quotes[a:b]


def splits(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A row per split: ``file, start, odd`` (number of quotes) and, for the
    split that begins a file, the ``header`` record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}  # place: quotes, header lines, header still open
        for batch in batches:
            for place, lines, quotes in _by_split(batch):
                at = seen.setdefault(place, [0, [], place[1] == 0])
                if at[2]:
                    closed = np.flatnonzero((at[0] + np.cumsum(quotes)) % 2 == 0)
                    n = int(closed[0]) + 1 if len(closed) else len(quotes)
                    at[1] += lines.slice(0, n).to_pylist()
                    at[2] = not len(closed)
                at[0] += int(quotes.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in seen], pa.string()), pa.array([at for _, at in seen], pa.int64()),
             pa.array([v[0] % 2 for v in seen.values()], pa.int32()),
             pa.array(["\n".join(v[1]) if at == 0 else None for (_, at), v in seen.items()], pa.string())],
            names=["file", "start", "odd", "header"])

    return _lines(spark, path, glob).mapInArrow(run, "file string, start long, odd int, header string")


def inventory(spark: SparkSession, path: str, glob: str | None = None) -> tuple[dict[str, list[str]], set]:
    """The column names of each file, and the splits that begin inside quotes."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = (splits(spark, path, glob)
            .withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
            .filter(F.col("inside") | F.col("header").isNotNull()).collect())
    return ({r["file"]: column_names(r["header"]) for r in sorted(rows) if r["header"] is not None},
            {(r["file"], r["start"]) for r in rows if r["inside"]})


def column_names(header: str) -> list[str]:
    """The names in a header record; empty and repeated ones are made up as
    Spark's own reader does."""
    names = next(csv.reader(io.StringIO(header.removeprefix("\ufeff").rstrip("\r\n"), newline="")), [])
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


_WHOLE, _HEAD, _TAIL = 0, 1, 2


def records(spark: SparkSession, path: str, glob: str | None, inside: set) -> DataFrame:
    """``file, start, pos, record``: the records of the files without headers
    and blank ones, each at the split and line it begins in. ``inside``: the
    splits that begin inside quotes."""
    opened = spark.sparkContext.broadcast(frozenset(inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, quoted, line, held, kind = None, False, 0, [], _WHOLE
        rows: list[tuple] = []

        def close(piece: int) -> None:
            text = "\n".join(held)
            if piece == _WHOLE or piece == _HEAD and not quoted:
                text = text.removesuffix("\r")
            if piece != _WHOLE or text and (place[1] or line > len(held)):  # not blank, not the header
                rows.append((*place, line - len(held), text, piece))
            held.clear()

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             names=["file", "start", "pos", "record", "piece"])
            rows.clear()
            return out

        for batch in batches:
            for here, lines, quotes in _by_split(batch):
                if here != place:
                    if held:
                        close(_HEAD if kind == _HEAD else _TAIL)
                    place, line, quoted = here, 0, here in opened.value
                    kind = _HEAD if quoted else _WHOLE
                for text, odd in zip(lines.to_pylist(), (quotes % 2 == 1).tolist(), strict=True):
                    held.append(text)
                    line += 1
                    quoted ^= odd
                    if not quoted:
                        close(kind)
                        kind = _WHOLE
            yield flush()
        if held:
            close(_HEAD if kind == _HEAD else _TAIL)
        yield flush()

    parts = _lines(spark, path, glob).mapInArrow(run, "file string, start long, pos long, record string, piece int")
    if not inside:
        return parts.select("file", "start", "pos", "record")
    # A tail begins a record; the heads after it, up to the next tail, go on with it.
    order = Window.partitionBy("file").orderBy("start", "piece").rowsBetween(Window.unboundedPreceding, 0)
    whole = parts.filter(F.col("piece") == _WHOLE).select("file", "start", "pos", "record")
    pieces = parts.filter(F.col("piece") != _WHOLE).withColumn(
        "n", F.count_if(F.col("piece") == _TAIL).over(order))
    joined = pieces.groupBy("file", "n").agg(
        F.array_sort(F.collect_list(F.struct("start", "piece", "pos", "record"))).alias("p"))
    return whole.unionByName(joined.select(
        "file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["pos"].alias("pos"),
        F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))


def parsed(rows: DataFrame, names: list[str], corrupt: str | None = None) -> DataFrame:
    """The fields of ``record`` as STRING columns; ``file, start, pos`` stay."""
    quote = lambda n: "`" + n.replace("`", "``") + "`"
    fields = [*names, corrupt] if corrupt else names
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    if corrupt:
        options["columnNameOfCorruptRecord"] = corrupt
    rec = F.from_csv("record", ", ".join(f"{quote(n)} string" for n in fields), options)
    at = F.struct("file", "start", "pos").alias("_at")
    return rows.select(at, rec.alias("_rec")).select("_at", *[F.col("_rec")[n].alias(n) for n in fields])
