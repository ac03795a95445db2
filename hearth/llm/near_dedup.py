"""Operator 3: near-duplicate documents by consistent weighted sampling.

A document is the weighted set of its five-word shingles (lower-case words;
one shingle of all words where there are fewer): term frequency times inverse
document frequency. Two documents are linked when their weighted Jaccard
similarity or the plain one of their sets of shingles is ``THRESHOLD`` or more
(within a large group of copies, what the copies share weighs little and each
edit much, so that the weighted one alone falls as the group grows); classes are
the connected components.

1. Document frequencies over the whole corpus, exact for every shingle: each
   task counts the shingles of a piece of its documents and sends the sorted
   hashes on in slices of the hash range, where the counts are added up. Those in
   at least two and in 1 / ``FREQUENT`` of all documents go to all tasks as a
   table, which has at most ``FREQUENT`` entries for each shingle of an average
   document, whatever the corpus. The frequencies of the rarer ones go back slice
   by slice to the piece they came from, in the order in which they were sent, and
   from there with each document as far as it goes.
2. Improved consistent weighted sampling draws ``BANDS x ROWS`` samples per
   document, and min-hashing as many of the plain set; a pair of similarity s
   agrees in each of the one or the other with probability s. At 0.8 a pair
   misses every band with probability 3e-5. For the sampling alone, weights are
   rounded to steps of an eighth in the logarithm.
3. Documents of equal word sequence are one class at once; only one of each
   goes on. In each bucket (band and its samples) every member is compared
   with one leader, which is linear in the bucket's size.
4. A pair that was not compared so can only matter where a bucket still holds
   several classes. There the members outside the bucket's largest class are
   compared with all members of the other classes, in blocks of
   ``BLOCK_CHARS`` characters whose texts meet in one row. Nothing is capped,
   only links are sent on, and a bucket whose members already form one class
   costs nothing more.
5. Every link is verified by the similarities of both texts. A member's pair
   with its leader is passed over if their samples, weighted and plain, agree in
   less than ``THRESHOLD - SURE`` of all: at a similarity of exactly 0.8 that happens
   with probability 0.28 %, and less above. Such a pair is met again in step 4,
   which leaves out buckets of two; so the pair of such a bucket is always
   verified.

Result: one row per input row: ``doc_id, class_id`` (the id that stays),
``class_size, kept``. Cases: a null text counts as empty; all texts without
words are one class; the smallest id stays (null ids last); a row repeated
with the same id is kept once; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.components import components
from hearth.llm.staging import free, is_empty, merged, stage, table, text_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
FREQUENT = 1 << 13  # shingles in at least this part of all documents have a weight of their own
HELD = 1 << 20  # shingles that a task counts before it sends them on
CHUNK = 10  # bits: a piece lies within so many documents in a row
PART_BYTES = 16 << 20  # of text, for each task that adds up
BLOCK_CHARS = 1 << 20
ORDERS = 4
_TEXT = (1 << 31) - 1  # in the place of a slice: a document, after all slices
SURE = 0.13  # three standard deviations of the share of equal samples
STEP = 0.125  # sampled weights are rounded to this in their logarithm
_DRAWS = 1 << 15


def shingles(texts: list[str], words: int = WORDS):
    """Of a group of texts: each text's word-sequence hash (two halves), and
    the distinct shingles with their counts as (text, hash, count) arrays in
    the order of text and hash."""
    from hearth.llm.textvec import Words, mix, shingle_hashes
    w = Words(texts)
    n = len(texts)
    size = np.diff(w.first)
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], size)
    one = mix(w.hash + mix(place.astype(np.uint64)))
    sequence = np.zeros((2, n), np.uint64)
    has = size > 0
    if has.any():
        sequence[0, has] = np.add.reduceat(one, w.first[:-1][has])
        sequence[1, has] = np.add.reduceat(mix(one ^ np.uint64(0xA5A5A5A5)), w.first[:-1][has])
    owner = np.repeat(np.arange(n), size)
    full = shingle_hashes(w.hash, list(range(words)))
    inside = owner[:len(full)] == owner[words - 1:] if len(full) else np.zeros(0, bool)
    short = np.flatnonzero(has & (size < words))
    text = np.concatenate([owner[:len(full)][inside], short])
    value = np.concatenate([full[inside], sequence[0, short]])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return sequence, text[at], value[at], np.diff(np.append(at, len(text)))


class Weights:
    """TF-IDF weights: ``value`` are the hashes (ascending) and ``count`` the
    document frequencies of the shingles in ``least`` and more of ``n``
    documents. The frequencies of all others come with the shingles (``few``,
    of the type ``kind``); without them they weigh as one in ``least - 1``.
    ``back``: for the driver, the table of the frequencies that go back."""

    def __init__(self, value: np.ndarray, count: np.ndarray, n: int, least: int = 2,
                 back: DataFrame | None = None, parts: int = 1):
        self.value, self.own = value, np.log((n + 1) / (count + 1)) + 1
        self.n, self.rare = n, np.log((n + 1) / least) + 1
        self.kind = np.dtype(np.uint16 if least <= 1 << 16 else np.uint32)
        self.back, self.parts = back, parts

    def __getstate__(self) -> dict:
        return {**self.__dict__, "back": None}

    def idf(self, value: np.ndarray, few: np.ndarray | None = None) -> np.ndarray:
        rare = np.full(len(value), self.rare) if few is None else np.log((self.n + 1) / (few + 1.0)) + 1
        if not len(self.value):
            return rare
        at = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        return np.where(self.value[at] == value, self.own[at], rare)

    def of(self, value: np.ndarray, count: np.ndarray, few: np.ndarray | None = None) -> np.ndarray:
        return count * self.idf(value, few)

    def levels(self, value: np.ndarray, count: np.ndarray, few: np.ndarray | None = None) -> np.ndarray:
        """The weights, as whole steps of ``STEP`` in their logarithm."""
        return np.rint(np.log(self.of(value, count, few)) / STEP).astype(np.int64)

    def few_of(self, blobs: list[bytes] | None) -> np.ndarray | None:
        """The frequencies that came with a group of texts, in the order of its shingles."""
        return None if blobs is None else np.frombuffer(b"".join(blobs), self.kind)


def _blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array cut into binary values of ``sizes`` elements."""
    ends = (np.append(0, np.cumsum(sizes)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [
        None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def document_frequencies(docs: DataFrame) -> Weights:
    """Counts in how many rows of ``docs`` each shingle is, and returns the
    weights. Tasks send sorted hashes with their counts as slices of the
    hash range, of which each is added up in one piece. Rows that come in the
    order of ``uid`` without a gap, up to ``HELD`` shingles, are a piece; it goes
    by its first ``uid``, under which its frequencies go back: 0 for those in
    the table of the frequent ones."""
    if "uid" not in docs.columns:
        docs = docs.withColumn("uid", F.monotonically_increasing_id())
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = size["n"]
    least = max(2, -(-n // FREQUENT))
    parts = max((size["bytes"] or 0) // PART_BYTES,
                int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slices = np.uint64(8 * parts)

    kind = Weights(np.zeros(0), np.zeros(0), n, least).kind

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups

        def counted(piece: int, held: list[np.ndarray]) -> pa.RecordBatch:
            value = np.concatenate(held)
            value.sort()
            at = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            count = np.diff(np.append(at, len(value))).astype(np.int32)
            value = value[at]
            part = ((value >> np.uint64(32)) * slices >> np.uint64(32)).astype(np.int32)
            head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(np.append(head, len(value)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(head), piece, np.int64)), pa.array(part[head]),
                 _blobs(value, size), _blobs(count, size)], names=["piece", "part", "shingles", "counts"])

        held: list[np.ndarray] = []
        piece, last, size = 0, -2, 0
        for batch in batches:
            uid, texts = batch.column("uid").to_numpy(), batch.column("text").to_pylist()
            cuts = np.flatnonzero((uid[1:] != uid[:-1] + 1) | (uid[1:] >> CHUNK != uid[:-1] >> CHUNK)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(uid)], strict=True):
                for first, group in groups(texts[a:b]):
                    here = int(uid[a + first])
                    if here != last + 1 or here >> CHUNK != last >> CHUNK or size >= HELD:
                        if size:
                            yield counted(piece, held)
                        held, piece, size = [], here, 0
                    held.append(shingles(group)[2])
                    size += len(held[-1])
                    last = here + len(group) - 1
        if size:
            yield counted(piece, held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["piece", "part", "shingles", "n"]
        pieces, parts_of, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        values, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for batch in batches:
            shingled = batch.column("shingles").to_pylist()
            pieces.append(batch.column("piece").to_numpy())
            parts_of.append(batch.column("part").to_numpy())
            sizes.append(np.array([len(x) // 8 for x in shingled], np.int64))
            values.append(np.frombuffer(b"".join(shingled), np.uint64))
            counts.append(np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int32))
        value, count, size = np.concatenate(values), np.concatenate(counts), np.concatenate(sizes)
        if not len(value):
            return
        order = np.argsort(value)
        value = value[order]
        new = np.append(True, value[1:] != value[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(count[order].astype(np.int64), at)
        often = total >= least
        back = np.empty(len(value), kind)
        back[order] = np.where(often, 0, total).astype(kind)[np.cumsum(new) - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(pieces)), pa.array(np.concatenate(parts_of)),
             pa.nulls(len(size), pa.binary()), _blobs(back, size)], names=names)
        if often.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([value[at][often].tobytes()], pa.binary()),
                 pa.array([total[often].tobytes()], pa.binary())], names=names)

    counts = stage(docs.select("uid", "text")
                   .mapInArrow(cut, "piece long, part int, shingles binary, counts binary")
                   .repartition(parts, "part").mapInArrow(add, "piece long, part int, shingles binary, n binary"),
                   "counts")
    table = counts.filter("piece is null").select("shingles", "n").toArrow()
    free(docs.select("uid"))  # the shuffle, which is larger than the texts; a job's last one is still in use
    value = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64)
    count = np.frombuffer(b"".join(table.column("n").to_pylist()), np.int64)
    order = np.argsort(value)
    return Weights(value[order], count[order], n, least, counts, parts)


class Sampler:
    """Consistent weighted samples: for each hash function the element with
    the smallest ``c / (y e^r)``, where r and c are Gamma(2, 1) and y rounds
    the weight on a random grid; all drawn by the element's hash from tables
    of ``_DRAWS`` entries. Weights have few levels, so the whole expression is
    tabulated once per level; equal entries are ordered by the element's hash."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.odd = (rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.r = rng.gamma(2.0, 1.0, _DRAWS) + 1e-3
        self.beta = rng.random(_DRAWS)
        self.lnc = np.log(rng.gamma(2.0, 1.0, _DRAWS) + 1e-9)
        self.tables: dict[int, np.ndarray] = {}

    def _table(self, level: int) -> np.ndarray:
        if level not in self.tables:
            grid = np.floor(level * STEP / self.r + self.beta)
            ln_a = self.lnc - self.r * (grid - self.beta) - self.r
            rank = np.maximum(ln_a + 64, 0).astype(np.float32).view(np.uint32)
            self.tables[level] = rank.astype(np.uint64) << np.uint64(32)
        return self.tables[level]

    def samples(self, text: np.ndarray, value: np.ndarray, level: np.ndarray, n_texts: int) -> np.ndarray:
        """(texts, functions) samples of 32 bits; zeros for an empty set."""
        from hearth.llm.textvec import mix
        out = np.zeros((n_texts, len(self.odd)), np.uint32)
        if not len(text):
            return out
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        who = text[first]
        seen, row = np.unique(level, return_inverse=True)
        tables = np.concatenate([self._table(int(k)) for k in seen])
        row = row.astype(np.uint64) * np.uint64(_DRAWS)
        low = value & np.uint64(0xFFFFFFFF)
        shift = np.uint64(64 - _DRAWS.bit_length() + 1)
        for j, odd in enumerate(self.odd):
            at = value * odd
            at >>= shift
            at += row
            rank = tables[at.view(np.int64)]
            rank |= low
            out[who, j] = (mix(np.minimum.reduceat(rank, first)) >> np.uint64(32)).astype(np.uint32)
        return out

    def plain(self, text: np.ndarray, value: np.ndarray, n_texts: int) -> np.ndarray:
        """The same of the sets, all elements of equal weight: the least of
        their multiples, as the hashes are random already."""
        from hearth.llm.textvec import mix
        out = np.zeros((n_texts, len(self.odd)), np.uint32)
        if not len(text):
            return out
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        who = text[first]
        for j, odd in enumerate(self.odd):
            out[who, j] = (mix(np.minimum.reduceat(value * odd, first)) >> np.uint64(32)).astype(np.uint32)
        return out


def _signed(docs: DataFrame, weights: Weights, bands: int, rows: int) -> DataFrame:
    """Per row: its word-sequence hash ``s1, s2``, its samples (16 bits of
    each, weighted and then plain), and the frequencies ``n`` of its shingles that are not in the table. The rows of a
    piece meet the frequencies that went back to it."""
    kind = docs.schema["id"].dataType.simpleString()
    chunk = F.shiftright("uid", CHUNK).alias("chunk")
    kept = ["uid", "id", "t1", "t2"]
    mine = docs.select(chunk, *kept, "text", F.lit(_TEXT).alias("part"), F.lit(None).cast("binary").alias("n"))
    back = weights.back.filter("piece is not null").withColumnRenamed("piece", "uid").select(
        chunk, "uid", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in (*kept[1:], "text")], "part", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        sampler = Sampler(bands * rows)

        def signed(few: list[bytes], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs = pa.Table.from_batches(held).combine_chunks()
            parts = [(first, group, shingles(group)) for first, group in groups(docs.column("text").to_pylist())]
            every, at = np.unique(np.concatenate([p[2][2] for p in parts]), return_inverse=True)
            n, done = weights.few_of(few), 0
            if len(n) != len(every):
                raise RuntimeError(f"{len(n)} frequencies came back for {len(every)} shingles")
            for first, group, (seq, text, value, count) in parts:
                own = n[at[done:done + len(value)]]
                done += len(value)
                sig = np.concatenate([sampler.samples(text, value, weights.levels(value, count, own), len(group)),
                                      sampler.plain(text, value, len(group))], axis=1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [*[docs.column(c).slice(first, len(group)).combine_chunks() for c in kept],
                     pa.array(seq[0].view(np.int64)), pa.array(seq[1].view(np.int64)),
                     pa.array([row.tobytes() for row in sig], pa.binary()),
                     _blobs(own, np.bincount(text, minlength=len(group)))],
                    names=[*kept, "s1", "s2", "sig", "n"])

        few: list[bytes] = []
        held: list[pa.RecordBatch] = []
        for batch in batches:
            text = batch.column("part").to_numpy() == _TEXT
            cuts = np.flatnonzero(text[1:] != text[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
                if a == b:
                    continue
                if text[a]:
                    held.append(batch.select([*kept, "text"]).slice(a, b - a))
                    continue
                if held:  # the next piece
                    yield from signed(few, held)
                    few, held = [], []
                few += batch.column("n").slice(a, b - a).to_pylist()
        if held:
            yield from signed(few, held)

    return mine.unionByName(back).repartition(weights.parts, "chunk").sortWithinPartitions("uid", "part").mapInArrow(
        run, f"uid long, id {kind}, t1 long, t2 long, s1 long, s2 long, sig binary, n binary")


def _band_keys(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """``uid, key``: one row per document and band, weighted or plain."""
    width = 2 * rows
    return reps.select("uid", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(2 * bands - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))).alias("band", "key")
    ).select("uid", "key")


def _agree(a: str, b: str, n: int) -> object:
    """The share of equal samples of two signature columns, the larger one of
    the ``n`` weighted and the ``n`` plain samples."""
    def share(first: int) -> object:
        parts = F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: F.when(
            F.substring(F.col(a), i * 2 + 1, F.lit(2)) == F.substring(F.col(b), i * 2 + 1, F.lit(2)), 1).otherwise(0))
        return F.aggregate(parts, F.lit(0), lambda x, y: x + y) / F.lit(float(n))

    return F.greatest(share(0), share(n))


def weighted_jaccard(xs: list[str], ys: list[str], weights: Weights,
                     few: list[bytes] | None = None) -> np.ndarray:
    """The similarity of each pair of texts, the larger one of the weighted and
    the plain; 1 for two texts without words. ``few``: the frequencies that came with the texts, first those of ``xs``."""
    n = len(xs)
    _, text, value, count = shingles([*xs, *ys])
    weight = weights.of(value, count, weights.few_of(few))
    pair = text % n
    order = np.lexsort((value, pair))
    pair, value, weight = pair[order], value[order], weight[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))

    def ratio(weight: np.ndarray) -> np.ndarray:
        total = np.bincount(pair, weights=weight, minlength=n)
        low = np.bincount(pair[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=n)
        return np.where(total > 0, low / np.maximum(total - low, 1e-12), 1.0)

    return np.maximum(ratio(weight), ratio(np.ones(len(weight))))


def _verify(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts reach the threshold."""
    def end(uid: str, text: str, n: str) -> DataFrame:
        return texts.select(F.col("uid").alias(uid), F.col("text").alias(text), F.col("n").alias(n))

    left = stage(merged(pairs, end("a", "x", "xn"), "a"), "left")
    both = merged(left, end("b", "y", "yn"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        for batch in batches:
            xs, ys, xn, yn = (batch.column(c).to_pylist() for c in ("x", "y", "xn", "yn"))
            for first, group in groups([x + y for x, y in zip(xs, ys, strict=True)]):
                last = first + len(group)
                ok = weighted_jaccard(xs[first:last], ys[first:last], weights,
                                      xn[first:last] + yn[first:last]) >= threshold
                yield batch.select(["a", "b"]).slice(first, len(group)).filter(pa.array(ok))

    return stage(both.select("a", "b", "x", "y", "xn", "yn").mapInArrow(run, "a long, b long"), "verified")


def similar(few: list[str], every: list[str], weights: Weights, threshold: float,
            n: list[bytes] | None = None) -> Iterator[np.ndarray]:
    """For each text of ``few``, the places in ``every`` whose weighted or plain
    similarity reaches the threshold.
    ``n``: the frequencies that came with the texts, first those of ``few``."""
    _, text, value, count = shingles([*few, *every])
    weight = weights.of(value, count, weights.few_of(n))
    total = np.bincount(text, weights=weight, minlength=len(few) + len(every))
    size = np.bincount(text, minlength=len(few) + len(every))
    first = np.searchsorted(text, np.arange(len(few) + 1))
    rest = np.arange(first[-1], len(text))
    rest = rest[np.argsort(value[rest], kind="stable")]
    values, owner, other = value[rest], text[rest] - len(few), weight[rest]
    for i in range(len(few)):
        own = slice(first[i], first[i + 1])
        lo = np.searchsorted(values, value[own])
        met = np.searchsorted(values, value[own], side="right") - lo
        at = np.repeat(lo - (np.cumsum(met) - met), met) + np.arange(int(met.sum()))
        low = np.bincount(owner[at], weights=np.minimum(other[at], np.repeat(weight[own], met)),
                          minlength=len(every))
        both = np.bincount(owner[at], minlength=len(every))
        yield np.flatnonzero((low >= threshold * np.maximum(total[i] + total[len(few):] - low, 1e-12))
                             | (both >= threshold * np.maximum(size[i] + size[len(few):] - both, 1e-12)))


def _rest(members: DataFrame, classes: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Links between classes that share a bucket: members outside the bucket's
    largest class against all others. One link per member and class is enough,
    as only the components count."""
    own = stage(members.join(classes, "uid", "left").withColumn("cls", F.coalesce("cls", "uid")), "own")
    per = own.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"))
    open_keys = stage(per.groupBy("key").agg(F.max_by("cls", F.struct("n", "cls")).alias("main"),
                                             F.sum("n").alias("size"), F.max("n").alias("most"))
                      .filter("size > most and size > 2").select("key", "main"), "open")
    rows = stage(merged(own.join(open_keys, "key"), texts, "uid"), "rest")
    chars = F.length("text")
    sizes = stage(rows.groupBy("key").agg(
        F.ceil(F.sum(chars) / BLOCK_CHARS).alias("all_blocks"),
        F.ceil(F.sum(F.when(F.col("cls") != F.col("main"), chars)) / BLOCK_CHARS).alias("few_blocks")), "sizes")
    rows = rows.join(sizes, "key")

    def blocked(df: DataFrame, blocks: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("uid"), F.greatest(F.col(blocks), F.lit(1))).alias("block")
        return df.groupBy("key", block).agg(F.collect_list(F.struct("uid", "cls", "text", "n")).alias(name)).drop("block")

    few, all_of = blocked(rows.filter("cls <> main"), "few_blocks", "few"), blocked(rows, "all_blocks", "every")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(col, i):
            v = col[i].values
            return (v.field("uid").to_numpy(), v.field("cls").to_numpy(), v.field("text").to_pylist(),
                    v.field("n").to_pylist())

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                fu, fc, ft, fn = parts(batch.column("few"), i)
                eu, ec, et, en = parts(batch.column("every"), i)
                for u, c, hit in zip(fu, fc, similar(ft, et, weights, threshold, fn + en), strict=True):
                    hit = hit[ec[hit] != c]
                    for e in eu[hit[np.unique(ec[hit], return_index=True)[1]]]:
                        out.append((min(u, e), max(u, e)))
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return few.join(all_of, "key").select("few", "every").mapInArrow(run, "a long, b long").distinct()


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``uid, id, t1, t2, cls``: a row per input row (its id and text hashes);
    rows of one class share ``cls``."""
    text = text_of(text_col)
    docs = stage(df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"),
                           F.xxhash64(text, F.lit(1)).alias("t2"))
                 .withColumn("uid", F.monotonically_increasing_id()), "docs")
    weights = document_frequencies(docs)
    signed = stage(_signed(docs, weights, bands, rows), "signed")
    firsts = stage(signed.groupBy("s1", "s2").agg(F.min("uid").alias("rep")), "firsts")
    free(weights.back)
    named = stage(merged(signed.select("uid", "id", "t1", "t2", "s1", "s2"), firsts, ["s1", "s2"])
                  .select("uid", "id", "t1", "t2", "rep"), "named")
    reps = merged(signed, firsts.select(F.col("rep").alias("uid")), "uid", "left_semi")
    sigs = stage(reps.select("uid", "sig"), "reps")
    keys = stage(_band_keys(sigs, bands, rows), "bands")
    # A leader per bucket, by a hash so that buckets of one family differ; of
    # ORDERS hashes, so that most of its members meet few leaders, not one per band.
    buckets = stage(keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("uid", F.xxhash64(F.pmod("key", F.lit(ORDERS)), "uid")).alias("leader"))
        .filter("n > 1").select("key", "leader", (F.col("n") == 2).alias("two")), "buckets")
    members = stage(merged(keys, buckets, "key"), "members")
    n, least = bands * rows, threshold - SURE
    star = (members.filter("uid <> leader").select(
        F.least("uid", "leader").alias("a"), F.greatest("uid", "leader").alias("b"), "two")
        .groupBy("a", "b").agg(F.max("two").alias("two")))
    star = merged(star, sigs.select(F.col("uid").alias("a"), F.col("sig").alias("sa")), "a")
    star = merged(star, sigs.select(F.col("uid").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = stage(star.filter(F.col("two") | (_agree("sa", "sb", n) >= least)).select("a", "b"), "pairs")

    involved = members.select("uid").distinct()
    wanted = stage(merged(signed.select("uid", "n"), involved, "uid", "left_semi"), "wanted")
    # A table of at most 2^20 hash values lets most other documents go before
    # the texts are shuffled.
    near = F.pmod(F.xxhash64("uid"), F.lit(1 << 20))
    some = docs.select("uid", "text").join(
        F.broadcast(wanted.select(near.alias("near")).distinct()), near == F.col("near"), "left_semi")
    texts = stage(merged(some, wanted, "uid"), "texts")
    free(docs, wanted)
    links = _verify(pairs, texts, weights, threshold)
    classes = components(links)
    more = stage(_rest(members.select("key", "uid"), classes, texts, weights, threshold), "more")
    if not is_empty(more):
        classes = components(links.union(more))
    return (named.join(stage(classes.select(F.col("uid").alias("rep"), "cls"), "classes"), "rep", "left")
            .select("uid", "id", "t1", "t2", F.coalesce("cls", "rep").alias("cls")))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row with its class and whether it is the row kept."""
    rows = stage(near_classes(df, id_col, text_col, threshold), "classes")
    best = stage(rows.groupBy("cls").agg(
        F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("id").isNull().alias("n"), "id", "uid")).alias("best")), "best")
    return rows.join(best, "cls").select(
        F.col("id").alias(id_col), F.col("best.id").alias("class_id"), "class_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one row of each class, its columns as they are. Rows that
    share id and text are one place; one of them stays."""
    text = text_of(text_col)
    keyed = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"),
                      F.xxhash64(text, F.lit(1)).alias("t2"))
    rows = stage(near_classes(df, id_col, text_col, threshold), "classes")
    best = stage(rows.groupBy("cls").agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), "id", "uid")).alias("best")), "best")
    kept = stage(rows.join(best, "cls").filter(F.col("uid") == F.col("best.uid")).select(
        F.col("id").alias("kid"), F.col("t1").alias("k1"), F.col("t2").alias("k2")), "kept")
    out = keyed.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("t1") == F.col("k1"))
                     & (F.col("t2") == F.col("k2")), "left_semi")
    if not is_empty(rows.groupBy("id", "t1", "t2").count().filter("count > 1")):
        out = out.dropDuplicates(["id", "t1", "t2"])
    return out.select("row.*")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
