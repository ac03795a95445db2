"""Wide <-> long reshaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def month_columns(columns: list[str], prefix: str = "20", minimum: str = "2020") -> list[str]:
    """Month columns of a wide series, picked by name (string comparison).

    The column list is plan metadata (``df.columns``); no job runs.
    """
    return [c for c in columns if c.startswith(prefix) and c >= minimum]


def melt(df: DataFrame, ids: list[str], value_cols: list[str],
         var: str = "variable", value: str = "value", drop_nulls: bool = True) -> DataFrame:
    """Wide -> long. ``DataFrame.unpivot`` keeps NULL values; they are dropped
    here by default, as the reference drops missing values after melting."""
    if not value_cols:
        raise ValueError("no value columns to unpivot")
    vt = {t for c, t in df.dtypes if c in value_cols}
    src = df
    if len(vt) > 1:  # unpivot needs one value type
        src = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in value_cols])
    out = src.unpivot(ids, value_cols, var, value)
    return out.where(F.col(value).isNotNull()) if drop_nulls else out


def first_metrics(long: DataFrame, entity: str, metric: str, value: str, order: str,
                  primary: str, secondary: str, carry: list[str] | None = None,
                  primary_alias: str = "primary_value",
                  secondary_alias: str = "secondary_value") -> DataFrame:
    """Long -> wide for two metrics, first occurrence of each per entity.

    Equivalent to: rows of ``primary`` deduplicated on ``entity`` keeping the
    first (by ``order``), left-joined to the same for ``secondary``. Only
    entities having the primary metric are returned; ``carry`` columns come
    from the primary row. One partial aggregation, no join.
    """
    carry = carry or []
    is_p = F.col(metric) == primary
    is_s = F.col(metric) == secondary
    g = long.groupBy(entity).agg(
        F.min_by(F.struct(*[F.col(c) for c in carry], F.col(value).alias("_v")),
                 F.when(is_p, F.col(order))).alias("_p"),
        F.min_by(F.col(value), F.when(is_s, F.col(order))).alias("_s"),
        F.max(is_p).alias("_has_p"))
    return (g.where(F.col("_has_p"))
            .select(entity, *[F.col("_p")[c].alias(c) for c in carry],
                    F.col("_p")["_v"].alias(primary_alias),
                    F.col("_s").alias(secondary_alias)))
