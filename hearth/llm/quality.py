"""Operator 4: quality classifier on random-indexing word vectors.

Every token type has a sparse random index vector drawn from its hash. The
vector of a type is the sum of the index vectors of its neighbours
(``REACH`` on each side) over the training sample, scaled to length one, with
its own index vector beside it. Tokens are words, runs of symbols, and a mark
for the shape of each word: upper case, capitalised, a repetition of the word
before, digits. A document is the mean of its tokens' vectors with a few
lengths and shares; a two-layer numpy network gives the probability, and a
temperature fitted on rows kept out of training calibrates it.

Fitting uses a bounded sample: at most ``ROWS_PER_CLASS`` labelled rows of
each class, as many as have ``CHARS_PER_CLASS`` characters together; their
texts are whole. Only the model is sent to the tasks: ``VOCABULARY`` types at
most. Scoring reads every whole text in one pass without a shuffle.

Result: ``doc_id, score, predicted``. Cases: null and empty texts are scored
as a document without tokens; without labelled rows every score is 0.5, with
rows of one class that class; labels other than 0 and 1 are ignored; repeated
rows are scored alike; an empty table gives an empty result; other columns are
ignored, whatever their names; a very long text is scored group by group
within its task; equal counts of types go by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.labelled import labelled_sample
from hearth.llm.language_id import held_out_by
from hearth.llm.staging import table, text_of

DIM, NONZERO, REACH = 64, 6, 2
VOCABULARY, MIN_COUNT = 30_000, 3
ROWS_PER_CLASS, CHARS_PER_CLASS = 3000, 12_000_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
CUT = 0.7


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a group of texts, each token's text, and for each text
    its number of words, of distinct words and of characters."""
    from hearth.llm.textvec import char_class, lower_table, mix, points, runs, span_hashes
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cps = points("".join(texts))
    low = lower_table()[cps]
    alnum, space = char_class(str.isalnum)[cps], char_class(str.isspace)[cps]
    upper = char_class(str.isupper)[cps]
    w0, w1 = runs(alnum, base)
    s0, s1 = runs(~alnum & ~space, base)
    word, sign = span_hashes(low, w0, w1), span_hashes(cps, s0, s1)
    w_text = np.searchsorted(base, w0, side="right") - 1
    s_text = np.searchsorted(base, s0, side="right") - 1
    ups = np.append(0, np.cumsum(upper))
    n_up = ups[w1] - ups[w0]
    shape = np.where((n_up == w1 - w0) & (w1 - w0 > 1), 2, np.where(n_up > 0, 1, 0))
    shape = np.where(char_class(str.isdigit)[cps[w0]] if len(w0) else np.zeros(0, bool), 3, shape)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (w_text[1:] == w_text[:-1])
    mark = mix((shape + 4 * again + 1).astype(np.uint64))
    place = np.concatenate([w0, w0, s0])
    order = np.argsort(place, kind="stable")
    value = np.concatenate([word, mark, sign])[order]
    text = np.concatenate([w_text, w_text, s_text])[order]
    n = len(texts)
    words = np.bincount(w_text, minlength=n)
    pair = np.lexsort((word, w_text))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (word[pair][1:] != word[pair][:-1]) | (w_text[pair][1:] != w_text[pair][:-1])
    distinct = np.bincount(w_text[pair][fresh], minlength=n)
    return value, text, np.stack([words, distinct, np.diff(base)], axis=1)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """A sparse vector of +1 and -1 for each hash."""
    from hearth.llm.textvec import mix
    out = np.zeros((len(hashes), DIM), np.float32)
    rows = np.arange(len(hashes))
    for k in range(NONZERO):
        h = mix(hashes + np.uint64(0x9E37 * (k + 1)))
        out[rows, (h % np.uint64(DIM)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1)
    return out


class Model:
    def __init__(self, texts: list[str], labels: list[int], weights: list[float]):
        self.constant = None
        if len(set(labels)) < 2:
            self.constant = float(labels[0]) if labels else 0.5
            return
        self._index(texts)
        y, w = np.array(labels, np.float32), np.array(weights, np.float32)
        x = self.features(texts)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        kept = np.arange(len(y)) % 5 == 0
        self._train(x[~kept], y[~kept], w[~kept])
        z = self._logit(x[kept])
        heat = np.exp(np.linspace(-1.5, 3, 91))
        loss = [np.average(np.logaddexp(0, z / t) - y[kept] * z / t, weights=w[kept]) for t in heat]
        self.heat = float(heat[int(np.argmin(loss))])

    def _index(self, texts: list[str]) -> None:
        """The vocabulary and its vectors, group by group: memory does not
        grow with the sample beyond its vocabulary."""
        from hearth.llm.textvec import groups
        every, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, group in groups(texts):
            seen, count = np.unique(tokens(group)[0], return_counts=True)
            every, at = np.unique(np.concatenate([every, seen]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, count]), minlength=len(every)).astype(np.int64)
        often = np.argsort(-n, kind="stable")[:VOCABULARY]
        self.vocabulary = np.sort(every[often[n[often] >= MIN_COUNT]])
        own = index_vectors(self.vocabulary)
        around = np.zeros_like(own)
        size = max(1, len(self.vocabulary))
        for _, group in groups(texts):
            value, text, _ = tokens(group)
            row = self._rows(value)
            for d in range(1, REACH + 1):
                a, b = row[:-d], row[d:]
                near = (text[:-d] == text[d:]) & (a >= 0) & (b >= 0)
                pair, times = np.unique(np.concatenate([a[near] * size + b[near], b[near] * size + a[near]]),
                                        return_counts=True)
                if len(pair):
                    left = pair // size
                    head = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
                    around[left[head]] += np.add.reduceat(
                        own[pair % size] * times[:, None].astype(np.float32), head, axis=0)
        around /= np.linalg.norm(around, axis=1, keepdims=True) + 1e-9
        self.vectors = np.concatenate([around, own], axis=1)

    def _rows(self, value: np.ndarray) -> np.ndarray:
        """The vocabulary row of each token, or -1."""
        if not len(self.vocabulary):
            return np.full(len(value), -1)
        spot = np.minimum(np.searchsorted(self.vocabulary, value), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[spot] == value, spot, -1)

    def features(self, texts: list[str]) -> np.ndarray:
        from hearth.llm.textvec import groups
        out = np.zeros((len(texts), 2 * DIM + 4), np.float32)
        for first, group in groups(texts):
            value, text, size = tokens(group)
            row = self._rows(value)
            known = row >= 0
            edge = np.searchsorted(text[known], np.arange(len(group) + 1))
            row = row[known]
            for i in range(len(group)):
                n = edge[i + 1] - edge[i]
                total = np.zeros(2 * DIM, np.float32)
                for a in range(edge[i], edge[i + 1], 65536):
                    total += self.vectors[row[a:min(a + 65536, edge[i + 1])]].sum(axis=0)
                out[first + i, :2 * DIM] = total / max(1, n)
            words, distinct, chars = size.T
            all_of = np.bincount(text, minlength=len(group))
            out[first:first + len(group), 2 * DIM:] = np.stack(
                [np.log1p(words), distinct / np.maximum(1, words), chars / np.maximum(1, words).clip(1),
                 np.diff(edge) / np.maximum(1, all_of)], axis=1)
        out[:, 2 * DIM + 2] = np.log1p(out[:, 2 * DIM + 2])
        return out

    def _train(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for a in range(0, len(y), 128):
                b = order[a:a + 128]
                h = np.tanh(x[b] @ p[0] + p[1])
                err = w[b] * (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - y[b]) / len(b)
                back = np.outer(err, p[2]) * (1 - h * h)
                grads = [x[b].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ err + DECAY * p[2],
                         np.array([err.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.layers = [a.astype(np.float32) for a in p]

    def _logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(x @ a + b) @ c + d[0]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self._logit((self.features(texts) - self.mean) / self.scale) / self.heat
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, usable, label_col: str = "quality") -> Model:
    return Model(*labelled_sample(docs, labels, label_col, usable, ROWS_PER_CLASS, CHARS_PER_CLASS))


def score_texts(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; ``model.score`` takes a list of texts."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        for batch in batches:
            for first, group in groups(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(group)), pa.array(shared.value.score(group), pa.float64())],
                    names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out_by("doc_id", 4, 2)
    model = fit(docs, labels, ~held)
    return score_texts(docs, model).select("doc_id", held.alias("held_out"), "score",
                                           (F.col("score") >= CUT).cast("int").alias("predicted"))
