"""Sketches that are kept per load and merge (A5, A6, opt-in).

An exact distinct count or median has to read all rows again after every load.
A sketch of each load, a few kilobytes per group, is stored instead; sketches of
several loads merge into the sketch of all their rows. ``DISTINCT_ERROR`` is the
relative standard error of a distinct count, ``RANK_ERROR`` the error of a
quantile's rank that holds with probability 0.99; merging keeps both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
K = 400
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 2.296 / K ** 0.9723


def sketch(df: DataFrame, by: list[str], distinct: dict[str, str], quantiles: dict[str, str]) -> DataFrame:
    """Per group a distinct-count sketch of each column of ``distinct`` and a
    quantile sketch of each of ``quantiles`` (name -> column): columns
    ``<name>_hll`` and ``<name>_kll``. NULL values are not counted."""
    return df.groupBy(*by).agg(
        *[F.hll_sketch_agg(c, LG_K).alias(f"{n}_hll") for n, c in distinct.items()],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), K).alias(f"{n}_kll") for n, c in quantiles.items()])


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of several loads, or of finer groups, as one row per group."""
    return sketches.groupBy(*by).agg(*[
        (F.hll_union_agg(c) if c.endswith("_hll") else F.kll_merge_agg_double(c, K)).alias(c)
        for c in sketches.columns if c.endswith(("_hll", "_kll"))])


def estimate(sketches: DataFrame, by: list[str], median: list[str]) -> DataFrame:
    """``<name>_distinct`` of every distinct-count sketch; ``<name>_n`` and
    ``<name>_median`` of the quantile sketches (NULL without values)."""
    out = [F.hll_sketch_estimate(c).alias(f"{c[:-4]}_distinct") for c in sketches.columns if c.endswith("_hll")]
    for name in median:
        n = F.kll_sketch_get_n_double(f"{name}_kll")
        out += [n.alias(f"{name}_n"),
                F.when(n > 0, F.kll_sketch_get_quantile_double(f"{name}_kll", F.lit(0.5))).alias(f"{name}_median")]
    return sketches.select(*by, *out)
