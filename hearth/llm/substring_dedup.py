"""Operator 11: substring dedup by seeds that are extended both ways.

A passage of ``LENGTH`` words or more that also stands in a document with a
smaller id is removed; words are cut at white space and compared unchanged.

1. Seeds. Of every window of ``LENGTH`` words the run of ``SEED`` words with
   the smallest hash is its anchor (winnowing): equal windows have equal
   anchors, and a document has one anchor for about four words. One pass
   writes each document's anchors.
2. Whole copies. Documents of equal word sequence are one class; all but the
   ones with the smallest id are removed outright.
3. Join. Anchors found at one place only are dropped: that is nearly all.
4. Extend. Around every remaining seed the match is extended to the left and
   to the right as far as the seed is the anchor: its stretch. Occurrences with
   equal stretches are one group, and the first document of a group is the
   source of the others, so each occurrence meets one partner, never all of
   them. Where the occurrences of a seed have different stretches, as at the
   ends of a passage, the occurrences without a source are extended in single
   steps: over all windows in which the seed is the anchor. The first document
   that holds a window never has an earlier source for its stretch, so no
   window misses it.
5. Maximal repeats. In each document the extended matches that continue one
   another in the same source, word by word, are one repeat ``(start, stop,
   source, source_start)``, which cannot be extended any further; the words
   under the repeats go.

A seed that many documents share is counted in the map tasks and is a skewed
key in joins of staged tables, which the adaptive join splits.

Result: per input row the kept text (words joined by one blank), ``n_words``,
``n_removed``, the removed stretches and the repeats. Cases: a null text counts as empty; a text of
fewer words than ``LENGTH`` loses nothing; a very long text is one row's arrays
in its task; rows of equal id are one document and never remove from each
other; a row without an id is neither source nor loses words; a repeat that
several documents hold is charged to the smallest id, there to the first place;
an empty table gives an empty result; other columns are passed through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from hearth.llm.staging import free, merged, stage, table, text_of

LENGTH = 13
SEED = 7
_SALT = np.uint64(0xD1B54A32D192ED03)


class _Text:
    """The words of a group of texts: ``hash``, code points ``start`` to
    ``end`` of the joined texts, and those of text i at ``first[i]:first[i + 1]``."""

    def __init__(self, texts: list[str]):
        from hearth.llm.textvec import points, runs, span_hashes
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.cps = points("".join(texts))
        self.start, self.end = runs((self.cps != 32) & ((self.cps < 9) | (self.cps > 13)), base)
        self.hash = span_hashes(self.cps, self.start, self.end)
        self.first = np.searchsorted(self.start, base)

    def windows(self, length: int, seed: int):
        """Start of each window and of its anchor, and the seeds' hashes."""
        from hearth.llm.textvec import shingle_hashes
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        n = len(text) - length + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        seeds = shingle_hashes(self.hash, list(range(seed)))
        least, at = seeds[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, length - seed + 1):  # the last of equal ones
            lower = seeds[j:j + n] <= least
            least[lower] = seeds[j:j + n][lower]
            at[lower] = j
        start = np.flatnonzero(text[:n] == text[length - 1:])
        return start, start + at[start], seeds

    def sequences(self) -> np.ndarray:
        """Two hashes of each text's word sequence."""
        from hearth.llm.textvec import mix
        size = np.diff(self.first)
        place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], size)
        one = mix(self.hash + mix(place.astype(np.uint64)))
        out = np.zeros((2, len(size)), np.uint64)
        has = np.flatnonzero(size)
        if len(has):
            out[0, has] = np.add.reduceat(one, self.first[:-1][has])
            out[1, has] = np.add.reduceat(mix(one ^ _SALT), self.first[:-1][has])
        return out + size.astype(np.uint64)


def _lists(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values))


def _anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Per document long enough: its word-sequence hash and its anchors' hashes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        for batch in batches:
            for first, group in groups(batch.column("text").to_pylist()):
                t = _Text(group)
                _, at, seeds = t.windows(length, seed)
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                whole = t.sequences().view(np.int64)
                cut = np.searchsorted(at, t.first)
                rows = np.flatnonzero(np.diff(cut))
                pick = pa.array(first + rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pick), batch.column("th").take(pick), pa.array(whole[0, rows]),
                     pa.array(whole[1, rows]), _lists(np.append(cut[rows], len(at)), seeds[at].view(np.int64))],
                    names=["id", "th", "q1", "q2", "seeds"])

    return docs.select("id", "th", "text").mapInArrow(
        run, f"id {kind}, th long, q1 long, q2 long, seeds array<long>")


def _stretches(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """For each place of the documents' ``seeds``: where its windows begin
    (``start`` and on), their hashes, and one hash of the whole stretch."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups, mix, shingle_hashes
        for batch in batches:
            for first, group in groups(batch.column("text").to_pylist()):
                t = _Text(group)
                start, at, hashes = t.windows(length, seed)
                wanted = batch.column("seeds").slice(first, len(group))
                wanted = np.unique(wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                # That a text also answers to a seed of its neighbours changes no result.
                here = np.isin(hashes[at], wanted)
                start, at = start[here], at[here]
                if not len(start):
                    continue
                head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                size = np.diff(np.append(head, len(at)))
                step = (np.arange(len(at)) - np.repeat(head, size)).astype(np.uint64)
                window = shingle_hashes(mix(t.hash ^ _SALT), list(range(length)))[start]
                whole = mix(np.add.reduceat(mix(window + step * _SALT), head) + size.astype(np.uint64))
                text = np.searchsorted(t.first, start[head], side="right") - 1
                row = pa.array(first + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("th").take(row),
                     pa.array(hashes[at[head]].view(np.int64)), pa.array(whole.view(np.int64)),
                     pa.array((start[head] - t.first[text]).astype(np.int32)),
                     _lists(np.append(head, len(at)), window.view(np.int64))],
                    names=["id", "th", "seed", "whole", "start", "windows"])

    return docs.select("id", "th", "text", "seeds").mapInArrow(
        run, f"id {kind}, th long, seed long, whole long, start int, windows array<long>")


def _first_holders(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per key the first place that has it, ``source``, and whether documents after that have it, too."""
    return rows.groupBy(*key).agg(F.min(F.struct("id", "start")).alias("source"), F.max("id").alias("most")).select(
        *key, "source", (F.col("source.id") < F.col("most")).alias("again"))


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``id, th, hits``: per document (id and text hash) the extended matches
    ``(start, size, source, source_start)``, ``size`` windows each; and ``id,
    th`` of the whole copies."""
    text = text_of(text_col)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).filter(
        F.col("id").isNotNull())
    prints = stage(_anchors(docs, length, seed), "anchors")
    same = prints.groupBy("q1", "q2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    classes = stage(same, "classes")
    copies = stage(merged(prints.select("id", "th", "q1", "q2"), classes, ["q1", "q2"])
                   .filter("id > least").select("id", "th").distinct(), "copies")
    each = prints.select("id", "th", F.explode("seeds").alias("seed"))
    shared = stage(each.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed"), "shared")
    met = stage(merged(each, shared, "seed"), "seeds")
    free(prints, classes, shared)
    seeds = met.groupBy("id", "th").agg(F.collect_set("seed").alias("seeds"))
    seeds = stage(merged(seeds, copies, ["id", "th"], "left_anti"), "seeded")
    free(met)
    near = docs.join(seeds.withColumnsRenamed({"id": "sid", "th": "sth"}),
                     (F.col("id") == F.col("sid")) & (F.col("th") == F.col("sth")))
    stretches = stage(_stretches(near, length, seed), "stretches")
    free(seeds)

    holders = stage(_first_holders(stretches, ["seed", "whole"]), "holders")
    several = stage(holders.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "seed", F.lit(True).alias("mixed")), "several")
    holders = stage(merged(holders, several, "seed", "left").filter(F.col("again") | F.col("mixed"))
                    .select("seed", "whole", "source", F.coalesce("mixed", F.lit(False)).alias("mixed")), "known")
    later = F.col("id") > F.col("source.id")
    judged = stage(merged(stretches, holders, ["seed", "whole"]).filter(later | F.col("mixed")).select(
        "id", "th", "seed", "start", F.when(later, F.col("source")).alias("source"), F.size("windows").alias("size"),
        F.when(~later, F.col("windows")).alias("windows")), "judged")
    free(stretches, holders, several)
    found = ["id", "th", "start", "size", F.col("source.id").alias("source"), F.col("source.start").alias("source_start")]
    hits = judged.filter("source is not null").select(*found)
    single = judged.filter("source is null").select("id", "th", "seed", "start", F.posexplode("windows").alias("i", "window"))
    single = stage(single.select("id", "th", "seed", "window", (F.col("start") + F.col("i")).alias("start"),
                                 F.lit(1).alias("size")), "single")
    firsts = stage(_first_holders(single, ["seed", "window"]).filter("again"), "sources")
    ends = merged(single, firsts, ["seed", "window"]).filter(later).select(*found)
    hits = stage(hits.unionByName(ends), "hits")
    free(judged, single, firsts)
    return hits.groupBy("id", "th").agg(
        F.collect_set(F.struct("start", "size", "source", "source_start")).alias("hits")), copies


def maximal(start: np.ndarray, size: np.ndarray, source: np.ndarray, source_start: np.ndarray,
            length: int) -> list[tuple]:
    """The repeats ``(start, stop, source, source_start)`` that the matches of
    ``size`` windows make up: those that continue one another in one source.
    ``source`` are numbers that stand for the ids."""
    order = np.lexsort((start, source_start - start, source))
    start, source, shift = start[order], source[order], (source_start - start)[order]
    stop = start + size[order] - 1 + length
    new = np.ones(len(start), bool)
    new[1:] = (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > stop[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    return sorted(zip(start[head].tolist(), stop[tail].tolist(), source[head].tolist(),
                      (start[head] + shift[head]).tolist(), strict=True))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   seed: int = SEED) -> DataFrame:
    """``row`` (the input row as a struct), the kept ``text``, ``n_words``,
    ``n_removed``, the ``removed`` stretches ``from-to`` and the ``repeats``
    behind them; that of a whole copy is all its words, without a source."""
    hits, copies = find_repeats(df, id_col, text_col, length, seed)
    hits = stage(hits, "repeats").withColumnsRenamed({"id": "hid", "th": "hth"})
    copies = copies.select(F.col("id").alias("wid"), F.col("th").alias("wth"), F.lit(True).alias("whole"))
    docs = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"),
                     F.xxhash64(text_of(text_col)).alias("th"))
    rows = merged(docs, hits, (F.col("id") == F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    rows = merged(rows, copies, (F.col("id") == F.col("wid")) & (F.col("th") == F.col("wth")), "left").select(
        "row", text_of_struct("row", text_col).alias("text"), "hits", F.col("whole").isNotNull().alias("whole"))
    found = StructType().add("start", LongType()).add("stop", LongType()).add(
        "source", df.schema[id_col].dataType).add("source_start", LongType())
    schema = StructType([rows.schema["row"]]).add("text", StringType()).add("n_words", LongType()).add(
        "n_removed", LongType()).add("removed", ArrayType(StringType())).add("repeats", ArrayType(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        for batch in batches:
            whole = batch.column("whole").to_pylist()
            kind = batch.column("hits").type.value_type.field("source").type
            for first, group in groups(batch.column("text").to_pylist()):
                t = _Text(group)
                base = np.concatenate([[0], np.cumsum([len(x) for x in group])])
                kept, size, gone, cuts, said = [], [], [], [], []
                for i, text in enumerate(group):
                    a, b = t.first[i], t.first[i + 1]
                    drop = np.full(b - a, whole[first + i])
                    repeats = [(0, int(b - a), None, None)] if whole[first + i] else []
                    mine = batch.column("hits")[first + i]
                    if mine.is_valid:
                        h = mine.values
                        ids = h.field("source").dictionary_encode()
                        for lo, hi, k, at in maximal(
                                h.field("start").to_numpy().astype(np.int64),
                                h.field("size").to_numpy().astype(np.int64), ids.indices.to_numpy(),
                                h.field("source_start").to_numpy().astype(np.int64), length):
                            drop[lo:hi] = True
                            repeats.append((lo, hi, ids.dictionary[k], at))
                    rest = np.flatnonzero(~drop) + a
                    kept.append(" ".join(text[s:e] for s, e in zip(
                        (t.start[rest] - base[i]).tolist(), (t.end[rest] - base[i]).tolist(), strict=True)))
                    size.append(int(b - a))
                    gone.append(int(drop.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]]))).tolist()
                    cuts.append([f"{x}-{y}" for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    said.append(repeats)
                cut = np.cumsum([0] + [len(x) for x in said])
                flat = [r for x in said for r in x]
                cols = [pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64()),
                        pa.array([r[2].as_py() if r[2] is not None else None for r in flat], kind),
                        pa.array([r[3] for r in flat], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(group)), pa.array(kept, pa.string()),
                     pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.list_(pa.string())),
                     _lists(cut, pa.StructArray.from_arrays(cols, names=["start", "stop", "source", "source_start"]))],
                    names=["row", "text", "n_words", "n_removed", "removed", "repeats"])

    return rows.mapInArrow(run, schema)


def text_of_struct(row: str, text_col: str):
    return F.coalesce(F.col(row).getField(text_col).cast("string"), F.lit(""))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"),
        F.array_join("removed", ",").alias("removed"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT rid, doc_id, s, array_to_string(w[s:s + 12], ' ') AS c
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
first AS (SELECT c, min(doc_id) AS least FROM windows GROUP BY c HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT rid, unnest(range(s, s + 13)) AS i FROM windows JOIN first USING (c) WHERE doc_id > least),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
  FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid),
edges AS (
  SELECT rid, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS island, i FROM gone),
spans AS (SELECT rid, min(i) - 1 AS a, max(i) AS b FROM edges GROUP BY rid, island),
said AS (SELECT rid, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM spans GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256, coalesce(removed, '') AS removed
FROM d LEFT JOIN kept USING (rid) LEFT JOIN said USING (rid)
"""
