"""Operator 10: line dedup by winnowing over line hashes.

A run is a stretch of consecutive lines (blank lines are passed over). A line
is deleted when it lies in a run of at least ``MIN_WORDS`` words that occurs
identically at an earlier place; places are ordered by document id, then line.
So of every repeated passage of that size the first occurrence stays, a single
line of ``MIN_WORDS`` words included; shorter lines go only within such a run.

Windows are the shortest stretches of ``MIN_WORDS`` words from each line on
and up to each line. Every run of that size contains a whole window, so the
line with the smallest hash of each window (its fingerprint) is selected in
both places: the winnowing guarantee, counted in words instead of lines.

1. One pass emits a row per selected line: its hash and the windows it stands
   for, as positions and 128-bit content hashes. No text leaves the scan.
2. Fingerprints that are selected at one place only are dropped with their
   windows; that is nearly all of the corpus.
3. The windows of the others are joined on their content with the first place
   of that content. Forward and backward windows together cover the whole
   repeated run on both sides of the fingerprint, however far it goes.
4. Each document takes its list of windows and drops their lines.

``line_passages`` then takes the passages that begin or end inside lines from
what is left, with matches extended word by word; the query applies both.

A line that a third of the documents share is counted in the map tasks and is
a skewed key in two joins of staged tables, which the adaptive join splits.

Result: per input row the text without its repeated runs, the number of lines,
of lines removed, and the removed stretches. Cases: a null text stays null, an
empty one empty; a very long text is one row's arrays in its task; a document
whose lines all repeat becomes empty; rows that share id and text are the same
place and are treated alike; rows without an id come first and are treated by
their text; an empty table gives an empty result; columns that are passed
through keep their values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from hearth.llm.staging import hashed, merged, stage, table, text_of

MIN_WORDS = 5
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the positions of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, line in enumerate(lines) if line and not line.isspace()]


class _Lines:
    """Hashes, word counts and positions of the lines of a group of texts. The
    counts are exact up to ``min_words``, which is all that windows ask."""

    def __init__(self, texts: list[str], min_words: int):
        from hearth.llm.textvec import text_hashes
        body, words, text, number = [], [], [], []
        for i, t in enumerate(texts):
            for k, line in enumerate(t.split("\n")):
                n = len(line.split(None, min_words))
                if n:
                    body.append(line.strip())
                    words.append(n)
                    text.append(i)
                    number.append(k)
        self.hash = text_hashes(body)
        self.words, self.text, self.number = (np.array(x, np.int64) for x in (words, text, number))


def _rolling(h: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """A hash of the sequence ``h[start:stop]`` for each pair."""
    from hearth.llm.textvec import mix
    n = len(h)
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    total = np.append(np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(up)))
    return mix((total[stop] - total[start]) * np.multiply.accumulate(down)[start]
               + (stop - start).astype(np.uint64))


def _lowest(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Position of the smallest of ``h[start:stop]`` (the last one on ties)."""
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((-np.arange(len(h)), h))] = np.arange(len(h))
    level = [rank]
    while len(level[-1]) > (1 << (len(level) - 1)):
        step = 1 << (len(level) - 1)
        level.append(np.minimum(level[-1][:-step], level[-1][step:]))
    k = np.frexp(stop - start)[1] - 1
    best = np.empty(len(start), np.int64)
    for d in np.unique(k):
        at = k == d
        best[at] = np.minimum(level[d][start[at]], level[d][stop[at] - (1 << d)])
    back = np.empty(len(h), np.int64)
    back[rank] = np.arange(len(h))
    return back[best]


def windows(lines: _Lines, min_words: int):
    """Of each window: (start, stop) in the group's lines, and its fingerprint."""
    n = len(lines.hash)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    total = np.concatenate([[0], np.cumsum(lines.words)])
    first = np.searchsorted(lines.text, lines.text)
    last = np.searchsorted(lines.text, lines.text, side="right")
    here = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + min_words)  # smallest stop with enough words
    ok = stop <= last
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    ok_back = (total[1:] >= min_words) & (start >= first)
    key = np.concatenate([here[ok] * (n + 1) + stop[ok], start[ok_back] * (n + 1) + here[ok_back] + 1])
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    a, b = key // (n + 1), key % (n + 1)
    return a, b, _lowest(lines.hash, a, b)


def _fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        for batch in batches:
            for first, group in groups(batch.column("text").to_pylist()):
                lines = _Lines(group, min_words)
                a, b, low = windows(lines, min_words)
                if not len(a):
                    continue
                order = np.argsort(low, kind="stable")
                a, b, low = a[order], b[order], low[order]
                head = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
                cut = pa.array(np.append(head, len(low)).astype(np.int32))
                row = pa.array(first + lines.text[low[head]])
                values = [lines.number[a].astype(np.int32), (lines.number[b - 1] + 1).astype(np.int32),
                          *[_rolling(lines.hash, a, b, base).view(np.int64) for base in _BASES]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("th").take(row),
                     pa.array(lines.hash[low[head]].view(np.int64)),
                     *[pa.ListArray.from_arrays(cut, pa.array(v)) for v in values]],
                    names=["id", "th", "print", "start", "stop", "c1", "c2"])

    return docs.select("id", "th", "text").mapInArrow(
        run, f"id {kind}, th long, print long, start array<int>, stop array<int>, c1 array<long>, c2 array<long>")


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``id, th, cuts``: per document (id and text hash) the line stretches
    ``(start, stop)`` that repeat an earlier place."""
    text = text_of(text_col)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = stage(_fingerprints(docs, min_words), "prints")
    shared = stage(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").select("print"), "shared")
    spans = stage(merged(prints, shared, "print").select(
        "id", "th", F.explode(F.arrays_zip("start", "stop", "c1", "c2")).alias("w"))
        .select("id", "th", "w.start", "w.stop", "w.c1", "w.c2"), "spans")
    place = F.struct("id", "th", "start")
    firsts = stage(spans.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").select("c1", "c2", "first"), "firsts")
    later = merged(spans, firsts, ["c1", "c2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))


def filled(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each list of ``(start, stop)`` that is not null or empty: where it
    is, and its starts and stops."""
    cut = lists.offsets.to_numpy()
    start, stop = (lists.values.field(c).to_numpy() for c in ("start", "stop"))
    for i in np.flatnonzero((cut[1:] > cut[:-1]) & lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
        yield i, start[cut[i]:cut[i + 1]], stop[cut[i]:cut[i + 1]]


def stretches(gone: np.ndarray) -> list[tuple[int, int]]:
    """The runs of True, as (start, stop)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (the other columns as a struct), the ``text`` without the repeated
    runs, ``lines``, ``removed`` and ``cuts`` (the removed stretches
    ``from-to``, comma-joined)."""
    found = stage(repeated_runs(df, id_col, text_col, min_words), "cuts").select(
        F.col("id").alias("cid"), F.col("th").alias("cth"), "cuts")
    docs = df.select(F.struct(*[F.col(c) for c in df.columns if c != text_col]).alias("row"),
                     F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"),
                     F.col(text_col).cast("string").alias("text"))
    rows = (hashed(docs, found, F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")), "left")
            .select("row", "text", "cuts"))
    schema = StructType([rows.schema["row"], rows.schema["text"]]).add("lines", LongType()).add(
        "removed", LongType()).add("cuts", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            count, removed, said = [t.count("\n") + 1 if t else 0 for t in texts], [0] * len(texts), [""] * len(texts)
            for i, starts, stops in filled(batch.column("cuts")):
                lines = texts[i].split("\n")
                drop = np.bincount(starts, minlength=len(lines) + 1) - np.bincount(stops, minlength=len(lines) + 1)
                edges = stretches(np.cumsum(drop)[:-1] > 0)
                kept, at = [], 0
                for a, b in edges:
                    kept += lines[at:a]
                    removed[i] += b - a
                    at = b
                texts[i] = "\n".join(kept + lines[at:])
                said[i] = ",".join(f"{a}-{b}" for a, b in edges)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(count, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(said, pa.string())],
                names=["row", "text", "lines", "removed", "cuts"])

    return rows.mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        chars_col: str = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its texts rewritten, and their lengths if it has them."""
    row, changed = F.col("row"), F.col("removed") > 0

    def out(c: str):
        if c == text_col:
            return F.col("text").alias(c)
        if c == chars_col:
            return F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(
                row.getField(c)).alias(c)
        return row.getField(c).alias(c)

    return dedup_lines(docs, id_col, text_col, min_words).select(*[out(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearth.llm.line_passages import drop_passages
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = stage(dedup_lines(docs).select("row.doc_id", "text", F.col("lines").alias("n_lines"),
                                           F.col("removed").alias("n_removed"), F.col("cuts").alias("removed")), "lines")
    return drop_passages(lines).select("row.doc_id", "text", "row.n_lines", "row.n_removed", "row.removed",
                                       "words_removed", "passages")
