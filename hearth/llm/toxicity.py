"""Operator 6: toxicity by multiple-instance learning.

Labels are of documents; the instances are sentences (cut at ``. ! ?`` and
line breaks, and after ``LONGEST`` words). A sentence has hashed features: its
words and the first four and five letters of longer words. A linear model
gives each sentence a probability, and noisy-or combines them: a document is
toxic unless every sentence is not. The weights are trained on the likelihood
of the document labels, so the sentences at fault are found without sentence
labels; features that toxic documents do not have more often are left out, and
an L1 penalty picks among the others. The worst sentence of each document is
reported with its place.

Fitting uses a bounded sample: at most ``ROWS_PER_CLASS`` labelled rows of
each class, as many as have ``CHARS_PER_CLASS`` characters together, whole
texts, weighted back to the labels' shares. Only the weights (``FEATURES`` numbers) are sent to the tasks. Scoring
reads every whole text in one pass without a shuffle.

Result: ``doc_id, score, worst_score, worst_start, worst_end`` (code points).
Cases: null and empty texts have no sentence and score 0, as has every text
when no labelled rows exist; with rows of one class that class is scored for
texts with a sentence; labels other than 0 and 1 are ignored; the first of
equally bad sentences is reported; repeated rows are scored alike; an empty
table gives an empty result; a very long text is one group's arrays in its
task; other columns are ignored, whatever their names.
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

FEATURES = 1 << 17
ROWS_PER_CLASS, CHARS_PER_CLASS = 4000, 12_000_000
LONGEST = 40
EPOCHS, REFIT, RATE, SHRINK, DECAY, LIFT = 150, 100, 0.1, 3e-4, 1e-5, 1.5
CUT = 0.7
_STOPS = ".!?\n"


def instances(texts: list[str]):
    """Of a group of texts: feature ids, where each sentence's features begin,
    and each sentence's text, first and last code point."""
    from hearth.llm.textvec import Words, char_class, span_hashes
    w = Words(texts)
    none = np.zeros(0, np.int64)
    if not len(w.hash):
        return none, none, none, none, none
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    stop = np.cumsum(char_class(_is_stop)[w.cps])
    before = stop[w.start]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (before[1:] != before[:-1])
    head = np.flatnonzero(new)
    place = np.arange(len(text)) - head[np.cumsum(new) - 1]
    new |= place % LONGEST == 0
    head = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    long = w.end - w.start
    four, five = np.flatnonzero(long > 4), np.flatnonzero(long > 5)
    who = np.concatenate([np.arange(len(text)), four, five])
    value = np.concatenate([w.hash, span_hashes(w.low, w.start[four], w.start[four] + 4) ^ np.uint64(0x4444),
                            span_hashes(w.low, w.start[five], w.start[five] + 5) ^ np.uint64(0x5555)])
    order = np.argsort(who, kind="stable")
    feature = (value[order] & np.uint64(FEATURES - 1)).astype(np.int64)
    begin = np.searchsorted(sentence[who[order]], np.arange(len(head)))
    last = np.append(head[1:], len(text)) - 1
    return feature, begin, text[head], w.start[head] - w.base[text[head]], w.end[last] - w.base[text[head]]


def _is_stop(c: str) -> bool:
    return c in _STOPS


class _Bag:
    """Sentences with features, grouped into labelled documents."""

    def __init__(self, feat, sentence, owner, sentences, y, weight):
        self.feat, self.sentence, self.owner, self.n = feat, sentence, owner, sentences
        self.y, self.weight = y, weight

    def only(self, pick: np.ndarray) -> _Bag:
        here = pick[self.feat]
        return _Bag((np.cumsum(pick) - 1)[self.feat[here]], self.sentence[here], self.owner, self.n,
                    self.y, self.weight)

    def descend(self, w: np.ndarray, b: float, epochs: int, shrink: float = 0.0, decay: float = 0.0):
        """Adam on the noisy-or likelihood; ``shrink`` is an L1 penalty."""
        m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
        for step in range(1, epochs + 1):
            z = np.bincount(self.sentence, weights=w[self.feat], minlength=self.n) + b
            s = np.bincount(self.owner, weights=np.logaddexp(0, z), minlength=len(self.y))
            pull = np.where(self.y == 1, -1 / np.expm1(np.clip(s, 1e-6, 50)), 1.0) * self.weight
            g = pull[self.owner] / (1 + np.exp(-z))
            gw = np.bincount(self.feat, weights=g[self.sentence], minlength=len(w)) + decay * w
            gb = g.sum()
            m += 0.1 * (gw - m)
            v += 0.01 * (gw * gw - v)
            mb += 0.1 * (gb - mb)
            vb += 0.01 * (gb * gb - vb)
            c1, c2 = 1 - 0.9 ** step, 1 - 0.99 ** step
            rate = RATE / (np.sqrt(v / c2) + 1e-8)
            w = w - rate * (m / c1)
            w = np.sign(w) * np.maximum(0, np.abs(w) - rate * shrink)
            b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        return w, b


class Model:
    def __init__(self, texts: list[str], labels: list[int], weights: list[float]):
        self.w, self.b = np.zeros(FEATURES, np.float32), np.float32(-30 if not any(labels) else 30)
        if len(set(labels)) == 2:
            self._train(texts, np.array(labels), np.array(weights))

    def _train(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> None:
        from hearth.llm.textvec import groups
        telling = self._telling(texts, y, weight)
        feats, places, owners, n = [], [], [], 0
        for first, group in groups(texts):
            feat, begin, owner, _, _ = instances(group)
            place = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(feat)))) + n
            kept = telling[feat]
            feats.append(feat[kept])
            places.append(place[kept])
            owners.append(owner + first)
            n += len(begin)
        uniq, feat = np.unique(np.concatenate(feats), return_inverse=True)
        bag = _Bag(feat, np.concatenate(places), np.concatenate(owners), n, y, weight / weight.sum())
        w, b = bag.descend(np.zeros(len(uniq)), -5.0, EPOCHS, shrink=SHRINK)
        # The penalty picks the features; their weights are fitted again without it.
        pick = np.abs(w) > 1e-4
        w[pick], b = bag.only(pick).descend(w[pick], b, REFIT, decay=DECAY)
        w[~pick] = 0
        self.w[uniq], self.b = w, np.float32(b)

    @staticmethod
    def _telling(texts: list[str], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The features found in at least two toxic documents and in a larger
        share of them than of the others; counted group by group."""
        from hearth.llm.textvec import groups
        count, share = np.zeros(FEATURES), np.zeros((2, FEATURES))
        for first, group in groups(texts):
            feat, begin, owner, _, _ = instances(group)
            doc = np.repeat(owner, np.diff(np.append(begin, len(feat)))) + first
            pair = np.unique(doc * FEATURES + feat)
            doc, feat = pair // FEATURES, pair % FEATURES
            for k in (0, 1):
                here = y[doc] == k
                share[k] += np.bincount(feat[here], weights=weight[doc[here]], minlength=FEATURES)
                if k:
                    count += np.bincount(feat[here], minlength=FEATURES)
        yes, no = share[1] / weight[y == 1].sum(), share[0] / weight[y == 0].sum()
        return (count >= 2) & (yes > LIFT * no)

    def judge(self, texts: list[str]):
        """Score of each text; score, start and end of its worst sentence."""
        feat, begin, owner, start, end = instances(texts)
        n = len(texts)
        score, worst = np.zeros(n), np.zeros(n)
        at = np.zeros((2, n), np.int64)
        if len(begin):
            z = np.add.reduceat(self.w[feat].astype(np.float64), begin) + self.b
            score = -np.expm1(-np.bincount(owner, weights=np.logaddexp(0, z), minlength=n))
            order = np.lexsort((start, -z, owner))
            top = order[np.append(True, owner[order][1:] != owner[order][:-1])]
            worst[owner[top]] = 1 / (1 + np.exp(-z[top]))
            at[0, owner[top]], at[1, owner[top]] = start[top], end[top]
        return score, worst, at[0], at[1]


def fit(docs: DataFrame, labels: DataFrame, usable, label_col: str = "toxic") -> Model:
    return Model(*labelled_sample(docs, labels, label_col, usable, ROWS_PER_CLASS, CHARS_PER_CLASS))


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its score and its worst sentence."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", "worst_score", "worst_start", "worst_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hearth.llm.textvec import groups
        for batch in batches:
            for first, group in groups(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(group)), *map(pa.array, shared.value.judge(group))],
                    names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, score double, worst_score double, worst_start long, worst_end long")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out_by("doc_id", 3, 1)
    model = fit(docs, labels, ~held)
    return score_toxicity(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        "worst_score", "worst_start", "worst_end")
