"""Operator 10, second step: repeated passages that begin or end inside lines.

A sentence here is a stretch of words up to a full stop, an exclamation or a
question mark before white space, or to the end of the line; a window is a
shortest run of whole sentences of at least ``MIN_WORDS`` words, from each
sentence on and up to each sentence. Windows are compared word by word, so it
does not matter which of their sentences stand on one line.

1. Winnowing: the longest sentence of a window (of equal ones that with the
   smallest hash) is its fingerprint, the same wherever the window occurs. One
   pass emits each document's fingerprints; those found once are dropped, and
   with them nearly all documents.
2. A second pass over the documents that are left emits the windows of the
   fingerprints that remain: position, 128-bit content hash, and the words of
   the sentence before and of the one after.
3. Windows are joined on their content with its first place (document id, then
   position). Every match is extended word by word to the left and to the
   right, as far as the neighbouring sentences of both places agree.
4. Each document drops the words under its extended matches; a line that loses
   all its words goes, and the parts of a line that stay are joined by a blank.

Windows of equal content meet one first place, so nothing grows with the number
of pairs; a content that a third of the documents share is a skewed key in
joins of staged tables. A match carries the two neighbouring sentences only
from the scan to the join, where they become two numbers.

Result: per input row its ``text`` without the passages, ``words_removed`` and
the removed stretches of words (``passages``, ``from-to``, comma-joined). Cases: a null text stays null, an empty one empty; a very long
text is one row's arrays in its task; rows that share id and text are one place
and treated alike; rows without an id come first; a document all of whose words
repeat becomes empty; an empty table gives an empty result; columns that are
passed through keep their values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from hearth.llm.line_dedup import _BASES, _rolling, filled, stretches, windows
from hearth.llm.staging import free, hashed, merged, stage, text_of

MIN_WORDS = 13
_MARKS = 1 << 20
# What a text has where its words are not parted by one blank or line break each.
_UNEVEN = ["  ", " \n", "\n ", *[chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]]


class _Sentences:
    """The sentences of a group of texts as runs of the group's words: sentence
    ``i`` is ``first[i]:first[i + 1]``, in text ``text[i]``."""

    def __init__(self, texts: list[str]):
        from hearth.llm.textvec import text_hashes
        said, cut = [], [0]
        for t in texts:
            # Between words one blank, between sentences a line break.
            t = t.strip(" ")
            if any(x in t for x in _UNEVEN):
                t = "\n".join([" ".join(line.split()) for line in t.split("\n")])
            for mark in ".!?":
                t = t.replace(mark + " ", mark + "\n")
            said += filter(None, t.split("\n"))
            cut.append(len(said))
        self.words = np.array([x.count(" ") for x in said], np.int64) + 1
        self.first = np.concatenate([[0], np.cumsum(self.words)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(cut))
        self.of_text = self.first[cut]  # first word of each text
        self.whole = text_hashes(said)
        # What windows() takes the smallest of: the longest sentence, then the smallest hash.
        short = np.uint64(0xFFFF) - np.minimum(self.words, 0xFFFF).astype(np.uint64)
        self.hash = short << np.uint64(48) | self.whole >> np.uint64(16)


def _prints(docs: DataFrame, min_words: int) -> DataFrame:
    """Per document with a window: the distinct fingerprints."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        for batch in batches:
            for first, group in groups(batch.column("text").to_pylist()):
                s = _Sentences(group)
                low = np.unique(windows(s, min_words)[2])
                if not len(low):
                    continue
                text = s.text[low]
                head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                rows = pa.array(first + text[head])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("th").take(rows), pa.ListArray.from_arrays(
                        pa.array(np.append(head, len(low)).astype(np.int32)), pa.array(s.whole[low].view(np.int64)))],
                    names=["id", "th", "prints"])

    return docs.select("id", "th", "text").mapInArrow(run, f"id {kind}, th long, prints array<long>")


def _lists(start: np.ndarray, stop: np.ndarray, word: np.ndarray, back: bool) -> pa.Array:
    """The words of each range as a list, the last one first if ``back``."""
    size = stop - start
    cut = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(cut[-1]) - np.repeat(cut[:-1], size)
    at = np.repeat(stop - 1, size) - step if back else np.repeat(start, size) + step
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(word[at]))


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    """The windows of the fingerprints ``prints`` of each document, and the
    words around them (32-bit hashes, the nearest first)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups, text_hashes
        for batch in batches:
            for first, group in groups(batch.column("text").to_pylist()):
                s = _Sentences(group)
                a, b, low = windows(s, min_words)
                wanted = batch.column("prints").slice(first, len(group)).flatten().to_numpy(zero_copy_only=False)
                # That a text also answers to a fingerprint of its neighbours changes no result.
                here = np.isin(s.whole[low], wanted.view(np.uint64))
                a, b = a[here], b[here]
                if not len(a):
                    continue
                text = s.text[a]
                zero = s.of_text[text]
                lo, hi = s.first[a], s.first[b]
                before = np.where(lo > zero, s.first[np.maximum(a - 1, 0)], lo)
                last = len(s.first) - 1
                after = np.where(hi < s.of_text[text + 1], s.first[np.minimum(b + 1, last)], hi)
                word = text_hashes([w for t in group for w in t.split()])
                word = (word >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rows = pa.array(first + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("th").take(rows),
                     pa.array((lo - zero).astype(np.int32)), pa.array((hi - zero).astype(np.int32)),
                     *[pa.array(_rolling(s.whole, a, b, base).view(np.int64)) for base in _BASES],
                     _lists(before, lo, word, True), _lists(hi, after, word, False)],
                    names=["id", "th", "start", "stop", "c1", "c2", "left", "right"])

    return docs.select("id", "th", "text", "prints").mapInArrow(
        run, f"id {kind}, th long, start int, stop int, c1 long, c2 long, left array<int>, right array<int>")


def _common(a: str, b: str) -> Column:
    """How many first elements of two lists are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    at = F.array_position(same, False)
    # Nearly always all are equal or already the first ones differ.
    return (F.when(F.col(a) == F.col(b), F.size(a)).when(n == 0, 0)
            .when(F.get(F.col(a), F.lit(0)) != F.get(F.col(b), F.lit(0)), 0)
            .when(at == 0, n).otherwise((at - 1).cast("int")))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS) -> DataFrame:
    """``id, th, hits``: per document (id and text hash) the stretches of words
    ``(start, stop)`` that repeat an earlier place."""
    text = text_of(text_col)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = stage(_prints(docs, min_words), "prints")
    each = prints.select("id", "th", F.explode("prints").alias("print"))
    shared = stage(each.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print"), "shared")
    known = stage(merged(each, shared, "print").groupBy("id", "th").agg(F.collect_set("print").alias("prints")), "known")
    free(prints, shared)
    # A table of at most 2^20 hash values lets most other documents go before
    # the texts are shuffled.
    mark = F.pmod(F.col("th"), F.lit(_MARKS))
    some = docs.join(F.broadcast(known.select(mark.alias("mark")).distinct()), mark == F.col("mark"), "left_semi")
    known = known.withColumnsRenamed({"id": "kid", "th": "kth"})
    here = F.col("id").eqNullSafe(F.col("kid")) & (F.col("th") == F.col("kth"))
    spans = stage(_spans(merged(some, known, here), min_words), "spans")
    place = F.struct("id", "th", "start", "stop")
    firsts = stage(spans.groupBy("c1", "c2").agg(
        F.min(F.struct("id", "th", "start", "stop", "left", "right")).alias("f"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("c1", "c2", F.struct("f.id", "f.th", "f.start", "f.stop").alias("source"),
                                F.col("f.left").alias("l"), F.col("f.right").alias("r")), "firsts")
    hits = stage(merged(spans, firsts, ["c1", "c2"]).filter(~place.eqNullSafe(F.col("source"))).select(
        "id", "th", (F.col("start") - _common("left", "l")).alias("start"),
        (F.col("stop") + _common("right", "r")).alias("stop")), "hits")
    free(known, spans, firsts)
    return hits.groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("hits"))


def without(text: str, start: np.ndarray, stop: np.ndarray) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without the words of the given stretches, how many went, and where."""
    lines = text.split("\n")
    words = [x.split() for x in lines]
    n = sum(map(len, words))
    gone = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1))[:-1] > 0
    edges = stretches(gone)
    out, at, k = [], 0, 0  # edges[k] is the first one that ends after the line's first word
    for line, ws in zip(lines, words, strict=True):
        end = at + len(ws)
        while k < len(edges) and edges[k][1] <= at:
            k += 1
        if not ws or k == len(edges) or edges[k][0] >= end:
            out.append(line)
        else:
            kept = list(compress(ws, ~gone[at:end]))
            if kept:
                out.append(" ".join(kept))
        at = end
    return "\n".join(out), int(gone.sum()), edges


def drop_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (the other columns as a struct), the ``text`` without the repeated
    passages, ``words_removed`` and ``passages``."""
    found = stage(repeated_passages(df, id_col, text_col, min_words), "passages").select(
        F.col("id").alias("hid"), F.col("th").alias("hth"), "hits")
    docs = df.select(F.struct(*[F.col(c) for c in df.columns if c != text_col]).alias("row"),
                     F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"),
                     F.col(text_col).cast("string").alias("text"))
    rows = (hashed(docs, found, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left")
            .select("row", "text", "hits"))
    schema = StructType([rows.schema["row"], rows.schema["text"]]).add("words_removed", LongType()).add(
        "passages", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts = batch.num_rows, batch.column("text").to_pylist()
            removed, said = np.zeros(n, np.int64), [""] * n
            for i, start, stop in filled(batch.column("hits")):
                texts[i], removed[i], cuts = without(texts[i], start, stop)
                said[i] = ",".join(f"{a}-{b}" for a, b in cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(removed), pa.array(said, pa.string())],
                names=["row", "text", "words_removed", "passages"])

    return rows.mapInArrow(run, schema)
