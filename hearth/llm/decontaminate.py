"""Operator 2: benchmark decontamination by spaced-seed hashing.

A mask of ones and blanks is laid over every run of words of the test items
and of the documents; the words under the ones are hashed, so a substituted
word under a blank does not matter. ``MASKS`` differ in their blanks, and are
chosen so that every pattern of substitutions that the verification accepts in
a run of 13 to 22 words hits one of them (tried exhaustively; random ones in
texts of up to 50 words leave none out either). Hits are joined on the hash; each (document, item, alignment) is then verified by comparing
the words around the hit one by one: the best run under +1 for an equal word
and -2 for a different one must have ``MIN_OVERLAP`` words (or the whole of a
shorter item) with ``MIN_IDENTITY`` of them equal.

An item of fewer than ``MIN_OVERLAP`` words is looked up by its first and last
three words, which are equal in every run that covers the item: a differing one
costs two equal ones. An item of up to six words so matches only as a whole; one
of fewer than ``MIN_ITEM`` words is no evidence (one or two words that occur in
any text) and never matches.

Documents are never shuffled: each task keeps, for the places that may be hits,
the words around them. Up to ``MAX_FILTER`` test hashes a sorted array of them
is sent to the tasks to drop other places at once; beyond that the tasks send
every place with its document's words and the join alone decides. Hits and
alignments are counted per place of a document, so no pairs arise within a
group, and an item that a third of the documents hold is a skewed key which
the adaptive join splits.

Result: one row per (document, item) overlap: ``doc_id, item_id, doc_start,
item_start, overlap, matched`` (word positions and counts of the best run).
Cases: null or empty texts and items have no words and never match; repeated
document rows give one result; a row without an id is reported under the null
id; ties take the larger position; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.staging import stage, table, text_of

# The masks.
MASKS = ("1101001000111", "111010001011", "1010000110111", "111011000101", "100000111111")
MIN_ITEM = 3
MIN_OVERLAP = 13
MIN_IDENTITY = 0.8
MAX_FILTER = 4_000_000
_SPAN = max(map(len, MASKS))


def _seed_kinds(short: list[int]) -> list[tuple[int, list[int]]]:
    """(span, offsets) of the masks and of short items."""
    return ([(len(m), [i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
            + [(n, [0, 1, 2, n - 3, n - 2, n - 1]) for n in short])


def _seeds(hashes: np.ndarray, first: np.ndarray, short: list[int],
           whole_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word position, seed) per kind for the texts ``first`` delimits.
    ``whole_only``: short kinds only where they cover a whole text."""
    from hearth.llm.textvec import mix, shingle_hashes
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = np.diff(first)
    for kind, (span, offsets) in enumerate(_seed_kinds(short)):
        h = shingle_hashes(hashes, offsets)
        at = np.arange(len(h))
        ok = owner[at] == owner[at + span - 1]
        if whole_only:
            ok &= (size[owner[at]] >= MIN_OVERLAP) if kind < len(MASKS) else (size[owner[at]] == span)
        at = at[ok]
        yield at, mix(h[ok] ^ np.uint64(0x51ED270B * (kind if kind < len(MASKS) else 1000 + span) + 1))


def _items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, words`` (array of word hashes) per item with enough words."""
    rows = df.select(F.col(id_col).alias("item_id"), text_of(text_col).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import Words, groups
        for batch in batches:
            for first, group in groups(batch.column(1).to_pylist()):
                w = Words(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(group)),
                     pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(w.hash.view(np.int64)))],
                    names=["item_id", "words"])

    return rows.mapInArrow(run, f"item_id {kind}, words array<long>").filter(F.size("words") >= MIN_ITEM)


def _item_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for at, seed in _seeds(hashes, first, short, True):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner[at])), pa.array((at - first[owner[at]]).astype(np.int32)),
                     pa.array(seed.view(np.int64))], names=["item_id", "item_at", "seed"])

    return items.select("item_id", "words").mapInArrow(run, f"item_id {kind}, item_at int, seed long").distinct()


def _places(df: DataFrame, id_col: str, text_col: str, short: list[int], reach: int,
            wanted: np.ndarray | None) -> DataFrame:
    """Per stretch of a document with possible hits: ``doc_id, from`` (its
    first word), ``words`` and the hits ``at`` (within it) with ``seed``."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = None
    if wanted is not None:
        marks = np.zeros(1 << 20, bool)
        marks[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import Words, groups
        for batch in batches:
            for first_row, group in groups(batch.column(1).to_pylist()):
                w = Words(group)
                ats, seeds = [], []
                for at, seed in _seeds(w.hash, w.first, short, False):
                    if wanted is not None:
                        near = np.flatnonzero(marks[(seed & np.uint64((1 << 20) - 1)).astype(np.int64)])
                        at, seed = at[near], seed[near]
                        spot = np.minimum(np.searchsorted(wanted, seed), len(wanted) - 1)
                        hit = wanted[spot] == seed
                        at, seed = at[hit], seed[hit]
                    ats.append(at)
                    seeds.append(seed)
                at, seed = np.concatenate(ats), np.concatenate(seeds)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                doc = np.searchsorted(w.first, at, side="right") - 1
                lo = np.maximum(at - reach, w.first[doc])
                hi = np.minimum(at + _SPAN + reach, w.first[doc + 1])
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(at)) - 1
                stretch = np.cumsum(new) - 1
                lo, hi = lo[head], hi[tail]
                words = [w.hash[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                hits = pa.array(np.append(head, len(at)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first_row + doc[head])),
                     pa.array((lo - w.first[doc[head]]).astype(np.int64)),
                     pa.ListArray.from_arrays(
                         pa.array(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)),
                         pa.array(np.concatenate(words).view(np.int64))),
                     pa.ListArray.from_arrays(hits, pa.array((at - lo[stretch]).astype(np.int32))),
                     pa.ListArray.from_arrays(hits, pa.array(seed.view(np.int64)))],
                    names=["doc_id", "from", "words", "at", "seed"])

    return rows.mapInArrow(run, f"doc_id {kind}, from long, words array<long>, at array<int>, seed array<long>")


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal words) of the run with the largest sum of +1 per
    equal and -2 per different word."""
    gain = np.where(equal, 1, -2)
    total = np.concatenate([[0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[:end + 1] == low[end])[-1])
    return start, end - start, int(equal[start:end].sum())


def _verified(pairs: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, items = batch.column("words"), batch.column("item_words")
            shift, begin = batch.column("shift").to_pylist(), batch.column("from").to_pylist()
            rows, out = [], []
            for i in range(batch.num_rows):
                d = words[i].values.to_numpy(zero_copy_only=False)
                t = items[i].values.to_numpy(zero_copy_only=False)
                a, b = max(0, shift[i]), min(len(d), shift[i] + len(t))
                start, n, same = best_run(d[a:b] == t[a - shift[i]:b - shift[i]])
                if n >= min(MIN_OVERLAP, len(t)) and same >= MIN_IDENTITY * n:
                    rows.append(i)
                    out.append((begin[i] + a + start, a - shift[i] + start, n, same))
            cols = np.array(out, dtype=np.int64).reshape(-1, 4)
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick), batch.column("item_id").take(pick),
                 *[pa.array(cols[:, k]) for k in range(4)]],
                names=["doc_id", "item_id", "doc_start", "item_start", "overlap", "matched"])

    return pairs.mapInArrow(run, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, doc_start long, "
                                 "item_start long, overlap long, matched long")


def find_overlaps(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  item_id: str = "item_id", item_text: str = "text",
                  max_filter: int = MAX_FILTER) -> DataFrame:
    """One row per (document, test item) with a verified overlap."""
    items = stage(_items(tests, item_id, item_text), "items")
    sizes = items.agg(F.max(F.size("words")).alias("most"),
                      F.collect_set(F.when(F.size("words") < MIN_OVERLAP, F.size("words"))).alias("short")).first()
    reach, short = sizes["most"] or 0, sorted(sizes["short"])
    seeds = stage(_item_seeds(items, short), "seeds")
    wanted = None
    if seeds.select("seed").count() <= max_filter:
        wanted = np.unique(np.array([r[0] for r in seeds.select("seed").distinct().collect()],
                                    dtype=np.int64).view(np.uint64))
        if not len(wanted):
            wanted = np.zeros(1, np.uint64)
    places = stage(_places(docs, doc_id, doc_text, short, reach, wanted)
                   .withColumn("place", F.monotonically_increasing_id()), "places")
    hits = places.select("place", F.explode(F.arrays_zip("at", "seed")).alias("h")).select("place", "h.at", "h.seed")
    lined = stage(hits.join(seeds, "seed").select(
        "place", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "lined")
    pairs = (lined.join(places.select("place", "doc_id", "from", "words"), "place")
             .join(items.select("item_id", F.col("words").alias("item_words")), "item_id"))
    best = F.max(F.struct("matched", (-F.col("overlap")).alias("less"), "overlap", "doc_start", "item_start"))
    return (_verified(pairs).groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select(F.col("doc_id").alias(doc_id), F.col("item_id").alias("item_id"),
                    "b.doc_start", "b.item_start", "b.overlap", "b.matched"))


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, without a verified overlap."""
    th = F.xxhash64(text_of(text_col))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), th.alias("th")).alias("doc_id"),
                        F.col(text_col).alias("text"))
    found = stage(find_overlaps(keyed, tests).select("doc_id.id", "doc_id.th").distinct(), "leaks")
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), th.alias("th")).join(
        found.select(F.col("id").alias("fid"), F.col("th").alias("fth")),
        F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left_anti").select("row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
