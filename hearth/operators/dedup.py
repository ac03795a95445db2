"""First-row-per-key selection as aggregation, not as a window.

``row_number() over (partition by k order by o) = 1`` sorts every group in
one task. ``min_by(struct(row), sort key)`` is a partial aggregate: each map
task keeps one candidate per key, so a key holding a third of the data costs
no more than any other.

The sort key is a struct of (NULL-order flag, value) pairs, negated for
descending numeric/date items. A unique tie-breaker must end the order, or
the pick among equal keys is arbitrary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    """One ``ORDER BY`` item. ``nulls_first`` defaults to the SQL-standard
    (PostgreSQL) rule: NULLs sort as the largest value."""

    col: str
    desc: bool = False
    nulls_first: bool | None = None

    def key_parts(self, dtype: str) -> list[Column]:
        c = F.col(self.col)
        nf = self.desc if self.nulls_first is None else self.nulls_first
        flag = F.when(c.isNull(), F.lit(0 if nf else 2)).otherwise(F.lit(1))
        if not self.desc:
            v = c
        elif dtype == "date":
            v = -F.unix_date(c)
        elif dtype.startswith("timestamp"):
            v = -F.unix_micros(c.cast("timestamp"))
        elif dtype in ("string", "boolean", "binary"):
            raise TypeError(f"descending order on {dtype} column {self.col!r} "
                            "is not supported by distinct_on")
        else:
            v = -c
        return [flag, v]


def distinct_on(df: DataFrame, keys: list[str], order: list[Order]) -> DataFrame:
    """PostgreSQL ``SELECT DISTINCT ON (keys) * ... ORDER BY keys, order``."""
    dtypes = dict(df.dtypes)
    parts: list[Column] = []
    for i, o in enumerate(order):
        f, v = o.key_parts(dtypes[o.col])
        parts += [f.alias(f"f{i}"), v.alias(f"v{i}")]
    cols = [c for c in df.columns if c not in keys]
    picked = (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*cols), F.struct(*parts)).alias("_row")))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in cols]).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Keep the first row per key in ingest order (pandas ``drop_duplicates``).

    ``ordinal`` is a unique, stable row position recorded at scan time.
    """
    return distinct_on(df, keys, [Order(ordinal)])


def with_ordinal(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Stable ingest position, to be taken directly on a file scan.

    (file path, split start, row id): the row id grows with the position
    inside a split, and splits of one file are ordered by their start, so the
    struct orders rows as they appear in the files.
    """
    return df.withColumn(name, F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("pos")))
