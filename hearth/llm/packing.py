"""Operator 9: best-fit packing planned on the length histogram.

1. One pass turns each document into ids plus the end id and cuts one longer
   than ``width`` into pieces of ``width`` (the first takes the remainder).
   Each task numbers its own pieces of each length. The pieces, without their
   ids unless asked for, are written once to the shared folder, which fixes
   these numbers for good.
2. The histogram of lengths (at most ``width`` rows) goes to the driver, and
   best-fit decreasing runs over its counts: bins are classes (remaining room,
   run of sequence numbers), so the work depends on the number of distinct
   lengths, not of documents. The plan says, for runs of ranks within a length,
   which sequences and offsets they take.
3. A piece's rank within its length is its number in its task plus the pieces
   of that length in earlier tasks (one row per task and length). It takes its
   slot by joining the plan on length and rank.

No step needs all pieces of one length in one task, so a length that a third
of all rows share is no hot spot.

Result: one row per piece with ``doc_id, piece, start, length, ids_crc32,
sequence_id, offset``. Cases: a null or empty text is the end id alone; a very
long text gives many pieces; a repeated row, or rows without an id, give
pieces each; which of several pieces of equal length takes which slot is
arbitrary; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.llm.staging import stage, table, text_of

WIDTH, END_ID = 1024, 2
PLAN_COLUMNS = "length long, rank_from long, rank_to long, per_bin long, first_sequence long, first_offset long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def plan_slots(counts: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts per length.

    Rows ``(length, rank_from, rank_to, per_bin, first_sequence,
    first_offset)``: the pieces with these ranks fill consecutive sequences,
    ``per_bin`` to each, from that offset on.
    """
    room: list[list[list[int]]] = [[] for _ in range(width + 1)]  # remaining -> [first, bins]
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = next((x for x in range(length, width) if room[x]), width)
            per = r // length
            if r == width:
                bins = max(1, left // per)
                first, have = sequences, bins
                sequences += bins
            else:
                first, have = room[r].pop()
                bins = min(have, max(1, left // per))
                if bins < have:
                    room[r].append([first + bins, have - bins])
            per = min(per, left)
            rows.append((length, rank, rank + per * bins, per, first, width - r))
            rank += per * bins
            left -= per * bins
            room[r - per * length].append([first, bins])
    return rows


def pieces_of(df: DataFrame, id_col: str, text_col: str, tokenizer: str, width: int, end_id: int,
              with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``piece, start, length, ids_crc32, nth``
    (its number among the task's pieces of that length) and ``task``."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ids_field = ", ids array<long>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.bpe import Bpe
        from hearth.llm.textvec import groups
        bpe = _loaded(Bpe, tokenizer)
        seen = np.zeros(width + 1, np.int64)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for first, group in groups(texts):
                at, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
                for i, ids in enumerate(bpe.ids(group)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    cut = len(ids) % width if len(ids) > width else len(ids)
                    edges = [0, *range(cut, len(ids) + 1, width)] if cut else list(range(0, len(ids) + 1, width))
                    for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        at.append(first + i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        nth.append(seen[b - a])
                        seen[b - a] += 1
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int64))
                cols = [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                        *[pa.array(np.asarray(c, np.int64)) for c in (start, length, crc, nth)]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = rows.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, "
                               f"ids_crc32 long, nth long{ids_field}")
    return out.withColumn("task", F.spark_partition_id())


_BPE: dict = {}


def _loaded(kind, path: str):
    """One tokenizer per worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _BPE:
        _BPE[path] = kind(path)
    return _BPE[path]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         width: int = WIDTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All documents packed into sequences of at most ``width`` ids; with
    ``with_ids`` each piece also carries its ids."""
    spark = df.sparkSession
    pieces = stage(pieces_of(df, id_col, text_col, tokenizer or default_tokenizer(), width, end_id, with_ids),
                   "pieces")
    per_task = stage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_slots(counts, width), PLAN_COLUMNS)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    # The plan has a few rows per length, whatever the number of documents.
    slot = F.broadcast(plan.withColumnRenamed("length", "of_length"))
    i = F.col("rank") - F.col("rank_from")
    q = (i - i % F.col("per_bin")) / F.col("per_bin")
    return ranked.join(slot, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank_from"))
                       & (F.col("rank") < F.col("rank_to"))).select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + q.cast("long")).alias("sequence_id"),
        (F.col("first_offset") + (i % F.col("per_bin")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
