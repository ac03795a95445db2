"""Join operators of the ingest: lookups, semi/anti joins, key resolution.

Broadcast is used only for the literal dimensions (boroughs, districts:
fixed row counts). Every other join is left to the planner; with AQE on, a
side is broadcast only after its measured size is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literal dimensions have a fixed number of rows; anything bigger must not be
# hinted.
LITERAL_MAX_ROWS = 64


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, cols: list[str],
           literal_rows: int | None = None) -> DataFrame:
    """Left lookup of ``cols`` from ``dim`` (N:1) on ``df[key] = dim[dim_key]``.

    ``literal_rows`` — the known row count of a literal dimension — enables a
    broadcast hint; other dimensions are left to AQE's measured sizes.
    """
    d = dim.select(F.col(dim_key).alias("_lk"), *cols)
    if literal_rows is not None and literal_rows <= LITERAL_MAX_ROWS:
        d = F.broadcast(d)
    return df.join(d, F.col(key) == F.col("_lk"), "left").drop("_lk")


def semi_known(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key is present in ``dim`` (``isin(list)`` without a
    list on the driver)."""
    dk = dim_key or key
    return df.join(dim.select(F.col(dk).alias(key)), key, "left_semi")


def anti_orphans(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Rows of ``df`` with a non-NULL key missing from ``dim`` (FK orphans)."""
    dk = dim_key or key
    return (df.where(F.col(key).isNotNull())
            .join(dim.select(F.col(dk).alias(key)), key, "left_anti"))


def resolve_keys(feed: DataFrame, prop: DataFrame, keys: list[str], id_col: str = "property_id",
                 null_safe: bool = False) -> DataFrame:
    """Attach ``id_col`` from ``prop`` to each feed row by natural key (inner).

    ``prop`` must be unique on ``keys`` (dedup mode) for one id per row.
    ``null_safe`` matches NULL to NULL, as pandas ``merge`` does; default
    drops NULL keys (SQL semantics; also removes the NULL-key hot spot).
    """
    p = prop.select(*[F.col(k).alias(f"_p_{k}") for k in keys], id_col)
    if not null_safe:
        feed = feed.where(_all_not_null(keys))
    cond = None
    for k in keys:
        c = (F.col(k).eqNullSafe(F.col(f"_p_{k}")) if null_safe
             else F.col(k) == F.col(f"_p_{k}"))
        cond = c if cond is None else cond & c
    return feed.join(p, cond, "inner").drop(*[f"_p_{k}" for k in keys])


def _all_not_null(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def fanout_counts(feed: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """Rows the reference's load would write, without writing the pairs.

    The reference writes one property row per feed row and then re-joins the
    feed to those properties on ``keys``: a key shared by k feed rows yields
    k x k sales. Per key group this returns k and k*k (the pair count), so
    the size of that fan-out can be reported and checked at any scale.
    NULL keys form a group when ``null_safe`` (pandas matches NULL to NULL).
    """
    f = feed if null_safe else feed.where(_all_not_null(keys))
    g = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("feed_rows"))
    return g.select(*keys, "feed_rows",
                    (F.col("feed_rows") * F.col("feed_rows")).alias("joined_rows"))


def borough_links(prop: DataFrame, school: DataFrame, district: DataFrame,
                  region: str = "NY") -> DataFrame:
    """The property-school bridge in factored form, one row per borough.

    The reference links every property of ``region`` to every school whose
    district lies in the property's borough. Those pairs are a product per
    borough; they are represented by their two factors (property count,
    school count) instead of being materialised. ``links`` = their product
    is the bridge's row count; any average over the bridge is computed from
    per-borough sums (see ``plans.score.attendance_by_zip``).
    """
    p = (prop.where(F.col("region") == region)
         .groupBy("borough_id").agg(F.count(F.lit(1)).alias("properties")))
    s = (school.where(F.col("district_id").isNotNull())
         .join(district.select("district_id", "borough_id"), "district_id")
         .groupBy("borough_id").agg(F.count(F.lit(1)).alias("schools")))
    return (p.join(s, "borough_id")
            .select("borough_id", F.col("properties").cast("long"),
                    F.col("schools").cast("long"),
                    (F.col("properties") * F.col("schools")).cast("long").alias("links")))
