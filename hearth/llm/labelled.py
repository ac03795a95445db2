"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.staging import text_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, rows_per_class: int,
                    chars_per_class: int, id_col: str = "doc_id", text_col: str = "text"):
    """Whole texts of at most ``rows_per_class`` rows and ``chars_per_class``
    characters of each label, ``(texts, labels, weights)``; the weights restore
    the shares of the classes.

    Rows are taken in the order of a hash of the id over all usable labels,
    until the next one would exceed a bound; no text is cut. Their ids are a
    list of bounded length, which is broadcast to the documents twice: for the
    lengths, and for the texts that are taken. Labels other than 0 and 1, and
    null ids, are not used.
    """
    y = F.col(label_col).cast("int")
    known = labels.filter(y.isin(0, 1) & F.col(id_col).isNotNull() & usable).select(
        F.col(id_col).alias("_id"), y.alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], [], []
    order = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * rows_per_class / n))])
    chosen = known.filter(order < share[F.col("_y")] * (1 << 30)).limit(4 * rows_per_class)
    text = text_of(text_col)
    found = (docs.select(F.col(id_col).alias("_id"), text.alias("t")).join(F.broadcast(chosen), "_id")
             .withColumn("o", order))
    sizes = found.select("_y", "o", F.length("t").alias("n"), F.xxhash64("t").alias("h")).limit(4 * rows_per_class)
    last: dict[int, tuple] = {}  # of each class the last row that is taken
    rows, chars, full = {0: 0, 1: 0}, {0: 0, 1: 0}, set()
    for r in sorted(sizes.collect(), key=lambda r: (r["o"], r["_y"], r["h"])):
        k = r["_y"]
        rows[k], chars[k] = rows[k] + 1, chars[k] + r["n"]
        if rows[k] > rows_per_class or chars[k] > chars_per_class:
            full.add(k)
        if k not in full:
            last[k] = (r["o"], r["h"])
    taken = F.lit(False)
    for k, (o, h) in last.items():
        taken |= (F.col("_y") == k) & ((F.col("o") < o) | ((F.col("o") == o) & (F.xxhash64("t") <= h)))
    got = found.filter(taken).select("t", "_y", "o", F.xxhash64("t").alias("h")).limit(2 * rows_per_class).collect()
    got.sort(key=lambda r: (r["o"], r["_y"], r["h"]))
    texts, ys = [r["t"] for r in got], [r["_y"] for r in got]
    weight = {k: counts[k] / max(1, ys.count(k)) for k in counts}
    mean = sum(weight[k] for k in ys) / max(1, len(ys))
    return texts, ys, [weight[k] / mean for k in ys]
