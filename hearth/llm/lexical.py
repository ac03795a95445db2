"""Operator 12: ranked lexical search in K2-treaps over the term-document grid.

The corpus is a grid: a row per term, a column per document, in each cell the
term's impact there, ``(SCALE * tf) div (1000 * tf + 8 * m)``, where m grows
with the document's length. The columns are cut into blocks of consecutive
documents as the tasks read them (``BLOCK_CELLS`` filled cells each, so no text
is shuffled), and each block becomes one K2-treap: a quadtree that keeps only
quadrants with filled cells, four bits of shape and the largest impact in each,
a byte or two per number as an order-preserving code. Rows are numbered by the
first document that holds the term, which puts the rare terms of a document
side by side and leaves most of the grid empty.

A query descends the row paths of all its terms at once. Its state is a range
of documents with one quadrant per term; the sum of weight times maximum bounds
the score of every document in the range, the ranges with the highest bounds
are split first, and a range below the tenth best score so far is never opened.
Ranges at that score are opened, as a smaller id wins a tie. At the last level
a range is a document and the bound its exact score.

1. One pass sums up N (documents with a term) and L (all terms).
2. One pass builds the blocks; they are written as a table and stand for any
   number of queries.
3. The document frequencies of the query terms are added up from the blocks.
4. Each block is searched for all queries and gives its best ``TOP``; a window
   over at most ``TOP`` rows per block and query ranks them.

A block is several MB, so wherever blocks are written, read and handed to a
worker it is one at a time (``BLOCKS_AT_A_TIME``), however many a task has.

Queries are dealt into chunks of ``CHUNK_CHARS`` characters; the terms of one
chunk are what the driver holds and sends out at a time. A very common term
costs one row path, and a term's occurrences are never gathered.

Result: ``item_id, rank, doc_id, score``. Cases: a null or empty document holds
no term and is not in N; a null or empty query has no result, and so has one
whose terms no document holds; a very long text is a block of its own; a
repeated row is a document of its own; equal scores go by ascending id, null
ids last; empty tables give an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.llm.staging import stage, table, text_of

TOP = 10
SCALE = 1_000_000_000
SLOPE = 90  # of 100: how much of a document's m follows its length
BLOCK_CELLS = 1 << 19
CHUNK_CHARS = 16_000_000
BATCH = 256  # ranges opened at a time
BLOCKS_AT_A_TIME = 1  # in a row group of the written index and in a batch for a worker

# Of a quadrant's shape (a bit per child): whether child q is there, and how
# many children come before it.
_HAS = np.array([[m >> q & 1 for q in range(4)] for m in range(16)], bool)
_BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int32)
_CHILDREN = np.array([bin(m).count("1") for m in range(16)], np.int32)


def _term_mask(cps: np.ndarray) -> np.ndarray:
    """Whether a code point is part of a term: an ASCII letter or digit, or any beyond ASCII."""
    return (cps >= 128) | ((cps >= 48) & (cps <= 57)) | ((cps >= 65) & (cps <= 90)) | ((cps >= 97) & (cps <= 122))


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every term of a group of texts, in order."""
    from hearth.llm.textvec import points, runs, span_hashes
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cps = points("".join(texts))
    start, end = runs(_term_mask(cps), base)
    low = np.where((cps >= 65) & (cps <= 90), cps + 32, cps)
    return np.searchsorted(base, start, side="right") - 1, span_hashes(low, start, end)


def counted(texts: list[str]):
    """Of a group of texts: (text, hash, tf) of the distinct terms in the order
    of text and hash, and the number of terms of each text."""
    text, value = terms_of(texts)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text))), np.bincount(text, minlength=len(texts))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N and L of a table with a column ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups, points, runs
        n, total = 0, 0
        for batch in batches:
            for _, group in groups(batch.column(0).to_pylist()):
                base = np.concatenate([[0], np.cumsum([len(t) for t in group])])
                start, _ = runs(_term_mask(points("".join(group))), base)
                n += len(np.unique(np.searchsorted(base, start, side="right")))
                total += len(start)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "l"])

    r = docs.select("text").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return r[0] or 0, r[1] or 0


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at the even places of 64."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """The K2-treap of a block. ``shape[k]`` and ``top[k]`` are the quadrants of
    level k in the order of their place, the whole grid at level 0; those of
    the last level are cells, without a shape. ``terms`` are the sorted hashes,
    ``row`` and ``df`` their row and number of documents."""

    def __init__(self, terms, row, df, values, shape, top):
        self.terms, self.row, self.df, self.values, self.shape, self.top = terms, row, df, values, shape, top

    @classmethod
    def build(cls, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Treap:
        """From the filled cells, in the order of ``doc`` (numbered from 0)."""
        terms, first, at, df = np.unique(term, return_index=True, return_inverse=True, return_counts=True)
        row = np.empty(len(terms), np.int64)
        row[np.lexsort((terms, first))] = np.arange(len(terms))
        values, code = np.unique(impact, return_inverse=True)
        code = code.astype(np.uint8 if len(values) <= 1 << 8 else np.uint16 if len(values) <= 1 << 16 else np.uint32)
        place = (_spread(row[at]) << np.uint64(1)) | _spread(doc)
        order = np.argsort(place)
        place, code = place[order], code[order]
        levels = max(int(row.max()), int(doc.max())).bit_length()
        shape, top = [], [code]
        for _ in range(levels):
            above = place >> np.uint64(2)
            head = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            bits = np.left_shift(1, (place & np.uint64(3)).astype(np.int64))
            shape.append(np.bitwise_or.reduceat(bits, head).astype(np.uint8))
            top.append(np.maximum.reduceat(top[-1], head))
            place = above[head]
            del above, bits, head
        return cls(terms, row.astype(np.int32), df.astype(np.int32), values, shape[::-1], top[::-1])

    def packed(self) -> bytes:
        """Shapes and maxima of all levels, two shapes in a byte."""
        out = []
        for s in self.shape:
            s = np.append(s, np.uint8(0)) if len(s) % 2 else s
            out.append((s[::2] | s[1::2] << 4).tobytes())
        return b"".join(out + [t.tobytes() for t in self.top])

    @classmethod
    def unpacked(cls, terms, row, values, sizes: list[int], blob: bytes) -> Treap:
        """``sizes``: the number of quadrants of each level."""
        kind = np.uint8 if len(values) <= 1 << 8 else np.uint16 if len(values) <= 1 << 16 else np.uint32
        raw, at, shape, top = np.frombuffer(blob, np.uint8), 0, [], []
        for n in sizes[:-1]:
            two = raw[at:at + (n + 1) // 2]
            shape.append(np.stack([two & 15, two >> 4], axis=1).ravel()[:n])
            at += (n + 1) // 2
        for n in sizes:
            end = at + n * np.dtype(kind).itemsize
            top.append(np.frombuffer(blob[at:end], kind))
            at = end
        return cls(terms, row, None, values, shape, top)


class Searcher:
    """Best-first search in one treap. ``tie`` is the place of each document
    in the order of ids."""

    def __init__(self, treap: Treap, tie: np.ndarray):
        self.t, self.tie, self.levels = treap, tie, len(treap.shape)
        # The quadrant -1 stands for an empty one: no children, maximum 0.
        self.shape = [np.append(s, np.uint8(0)) for s in treap.shape]
        self.first = [np.append(0, np.cumsum(_CHILDREN[s])).astype(np.int32) for s in treap.shape]
        values = treap.values.astype(np.int32)  # impacts are below SCALE / 1000
        self.most = [np.append(values[c], np.int32(0)) for c in treap.top]

    def _open(self, level: int, node: np.ndarray, bits: np.ndarray, right: int) -> np.ndarray:
        """The quadrants of one half of each range: (ranges, terms)."""
        q = 2 * bits + right
        shape = self.shape[level][node]
        return np.where(_HAS[shape, q], self.first[level][node] + _BEFORE[shape, q], np.int32(-1))

    def best(self, hashes: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best with a score above 0."""
        at = np.minimum(np.searchsorted(self.t.terms, hashes), len(self.t.terms) - 1)
        here = (self.t.terms[at] == hashes) & (weights > 0)
        rows, w = self.t.row[at[here]], weights[here]
        if not len(rows):
            return []
        # Per level the open ranges: their first bits, quadrants and bounds.
        pool: list[list] = [[] for _ in range(self.levels + 1)]
        root = np.zeros((1, len(rows)), np.int32)
        pool[0].append((np.zeros(1, np.int64), root, self.most[0][root] @ w))
        found: list[tuple[int, int, int]] = []  # (-score, place among the ids, document)
        least = 1
        if not self.levels:
            return [(int(pool[0][0][2][0]), 0)]
        while True:
            level = max(range(self.levels), key=lambda j: max((int(p[2].max()) for p in pool[j]), default=0))
            parts = pool[level]
            if not parts or max(int(p[2].max()) for p in parts) < least:
                break
            doc, node, bound = (np.concatenate([p[i] for p in parts]) for i in range(3))
            keep = np.flatnonzero(bound >= least)
            if len(keep) > BATCH:
                order = np.argpartition(-bound[keep], BATCH)
                rest = keep[order[BATCH:]]
                keep = keep[order[:BATCH]]
                pool[level] = [(doc[rest], node[rest], bound[rest])]
            else:
                pool[level] = []
            doc, node = doc[keep], node[keep]
            bits = rows >> (self.levels - 1 - level) & 1
            for right in (0, 1):
                child = self._open(level, node, bits, right)
                score = self.most[level + 1][child] @ w
                ok = np.flatnonzero(score >= least)
                if not len(ok):
                    continue
                sub = 2 * doc[ok] + right
                if level + 1 < self.levels:
                    pool[level + 1].append((sub, child[ok], score[ok]))
                    continue
                found += zip((-score[ok]).tolist(), self.tie[sub].tolist(), sub.tolist(), strict=True)
                if len(found) >= k:
                    found = sorted(found)[:k]
                    least = max(1, -found[-1][0])
        return [(-s, d) for s, _, d in sorted(found)[:k]]


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_cells: int = BLOCK_CELLS) -> tuple[DataFrame, int]:
    """The blocks as a written table, and N. A block has its documents ``ids``,
    the ``terms``, their ``row`` and ``df``, and the treap."""
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    n_docs, n_terms = corpus_size(docs)

    def block(ids: list, cells: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays(ids)
        doc, term, tf, size = (np.concatenate([c[i] for c in cells]) for i in range(4))
        m = 100 - SLOPE + SLOPE * size * n_docs // n_terms
        treap = Treap.build(doc, term, SCALE * tf // (1000 * tf + 8 * m))
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.RecordBatch.from_arrays(
            [one(ids), one(pa.array(treap.terms.view(np.int64))), one(pa.array(treap.row)), one(pa.array(treap.df)),
             one(pa.array(treap.values.astype(np.int64))), one(pa.array([len(t) for t in treap.top], pa.int64())),
             pa.array([treap.packed()], pa.binary())],
            names=["ids", "terms", "row", "df", "values", "sizes", "treap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        ids, cells, n, filled = [], [], 0, 0
        for batch in batches:
            for first, group in groups(batch.column("text").to_pylist()):
                text, value, tf, size = counted(group)
                if filled and filled + len(value) > block_cells:
                    yield block(ids, cells)
                    ids, cells, n, filled = [], [], 0, 0
                has = np.flatnonzero(size)
                number = np.cumsum(size > 0) - 1 + n  # documents without a term have no column
                if len(has):
                    ids.append(batch.column("id").slice(first, len(group)).take(pa.array(has)))
                    cells.append((number[text], value, tf, size[text]))
                n, filled = n + len(has), filled + len(value)
        if filled:
            yield block(ids, cells)

    made = docs.mapInArrow(run, f"ids array<{kind}>, terms array<long>, row array<int>, df array<int>, "
                                "values array<long>, sizes array<long>, treap binary")
    return stage(made, "treaps", {"parquet.block.row.count.limit": str(BLOCKS_AT_A_TIME)}), n_docs


@contextmanager
def _few_blocks(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand their workers ``BLOCKS_AT_A_TIME`` rows at a time."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, BLOCKS_AT_A_TIME)
    try:
        yield
    finally:
        spark.conf.set(rows, before)


def _query_terms(items: DataFrame) -> list[tuple]:
    """(query, term hash) of one chunk's queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        for batch in batches:
            for first, group in groups(batch.column("text").to_pylist()):
                text, value, _, _ = counted(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("qid").take(pa.array(first + text)), pa.array(value.view(np.int64))],
                    names=["qid", "term"])

    return [(r[0], r[1]) for r in items.select("qid", "text").mapInArrow(run, "qid long, term long").collect()]


def _search(index: DataFrame, n_docs: int, pairs: list[tuple], top: int) -> DataFrame:
    """``qid, doc_id, score``: the best of each block for each query."""
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    query = np.array([p[0] for p in pairs], np.int64)
    term = np.array([p[1] for p in pairs], np.int64).view(np.uint64)
    wanted = spark.sparkContext.broadcast(np.unique(term))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms = batch.column("terms")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.minimum(np.searchsorted(terms, wanted.value), len(terms) - 1)
                here = terms[at] == wanted.value
                total[here] += batch.column("df")[i].values.to_numpy(zero_copy_only=False)[at[here]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "df"])

    weights = np.zeros(len(wanted.value), np.int64)
    for r in (index.select("terms", "df").mapInArrow(count, "at long, df long")
              .groupBy("at").agg(F.sum("df").alias("df")).collect()):
        weights[r["at"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    order = np.argsort(query, kind="stable")
    query, term = query[order], term[order]
    weight = weights[np.searchsorted(np.unique(term), term)]
    each, head, size = np.unique(query, return_index=True, return_counts=True)
    shared = spark.sparkContext.broadcast([(int(q), term[a:a + n], weight[a:a + n]) for q, a, n in zip(
        each, head, size, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, i: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                tie = np.empty(len(ids), np.int64)
                tie[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                s = Searcher(Treap.unpacked(get("terms", i).view(np.uint64), get("row", i), get("values", i),
                                            get("sizes", i).tolist(), batch.column("treap")[i].as_py()), tie)
                out = [(q, score, d) for q, hashes, w in shared.value for score, d in s.best(hashes, w, top)]
                if out:
                    q, score, d = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q, pa.int64()), ids.take(pa.array(d)), pa.array(score, pa.int64())],
                        names=["qid", "doc_id", "score"])

    return index.select("ids", "terms", "row", "values", "sizes", "treap").mapInArrow(
        run, f"qid long, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", top: int = TOP,
                  block_cells: int = BLOCK_CELLS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item."""
    index, n_docs = build_index(docs, id_col, text_col, block_cells)
    queries = stage(items.select(F.col(item_id).alias("item_id"), text_of(item_text).alias("text"))
                    .withColumn("qid", F.monotonically_increasing_id()), "queries")
    chunks = -(-(queries.agg(F.sum(F.length("text"))).first()[0] or 0) // chunk_chars)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = None
    for c in range(max(1, chunks)):
        mine = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(max(1, chunks))) == c)
        terms = _query_terms(mine)
        with _few_blocks(index.sparkSession):
            part = stage(_search(index, n_docs, terms, top).withColumn("rank", F.row_number().over(order))
                         .filter(F.col("rank") <= top), "ranked")
        ranked = part if ranked is None else ranked.union(part)
    return ranked.join(queries.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERMS}')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
impact AS (
  SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)) AS x
  FROM tf JOIN len USING (rid), total),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERMS}')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, rid, doc_id, sum(w * x)::BIGINT AS score
  FROM items JOIN impact USING (term) JOIN weight USING (term) GROUP BY ALL HAVING sum(w * x) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored) WHERE rank <= 10
"""
