"""Reporting queries over the star model.

Each function takes a star (any object exposing the star tables as
DataFrame attributes: ``borough``, ``property``, ``sales_transaction`` ...)
plus parameters, and returns a lazy DataFrame. Thresholds, limits and dates
are parameters with the reference's values as defaults.

Plan shape, chosen for large inputs:

* Sales are aggregated per ``property_id`` (or per property and year) before
  the join with ``property``. The partial aggregate collapses a hot property
  on the map side, the join then sees at most one row per property, and its
  exchange on ``property_id`` is shared by the aggregate.
* Averages are carried as (sum, count) through those stages; the final value
  is sum/count in exact decimals.
* Small fixed dimensions (boroughs) are left to AQE, which broadcasts from
  measured sizes; nothing is broadcast on an unchecked estimate.
* Top-k ends with a unique tie-breaker and explicit NULL order (PostgreSQL
  puts NULLs first in DESC), so the k rows are deterministic.
* Medians use the exact distributed ``percentile_cont``.

Output columns are cast to fixed types: counts BIGINT, money and ratios
DOUBLE (after rounding), years INT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions import expr as X
from hearth.operators.dedup import Order, distinct_on
from hearth.operators.blocks import stage
from hearth.operators.quantile import percentile_cont

DEC = "decimal(38,6)"


def _avg(s: str, n: str) -> Column:
    """Exact mean from carried (sum, count)."""
    return F.col(s).cast(DEC) / F.nullif(F.col(n), F.lit(0)).cast("decimal(20,0)")


def _sales_by_property(st: DataFrame, extra: list[Column] | None = None,
                       where: Column | None = None) -> DataFrame:
    if where is not None:
        st = st.where(where)
    return (st.groupBy("property_id", *(extra or []))
            .agg(F.sum("sale_price").alias("s"),
                 F.count("sale_price").alias("n_price"),
                 F.count(F.lit(1)).alias("n")))


# Q1 / D1 --------------------------------------------------------------------
def avg_price_by_borough(star) -> DataFrame:
    """Average sale price and number of sales per borough."""
    per_prop = _sales_by_property(star.sales_transaction)
    p = star.property.select("property_id", "borough_id")
    g = (per_prop.join(p, "property_id")
         .groupBy("borough_id")
         .agg(F.sum("s").alias("s"), F.sum("n_price").alias("n_price"),
              F.sum("n").alias("n")))
    out = (g.join(star.borough.select("borough_id", "borough_name"), "borough_id")
           .groupBy("borough_name")
           .agg(F.sum("s").alias("s"), F.sum("n_price").alias("n_price"),
                F.sum("n").alias("num_sales")))
    return (out.select("borough_name",
                       F.round(_avg("s", "n_price")).cast("double").alias("avg_sale_price"),
                       F.col("num_sales").cast("long"))
            .orderBy(F.col("avg_sale_price").desc_nulls_first(), "borough_name"))


# Q2 / D4 --------------------------------------------------------------------
def top_zips_by_score(score: DataFrame, limit: int = 10) -> DataFrame:
    """Highest quality scores (ordered by the rounded score, then zip)."""
    return (score.select(
                "zip_code",
                F.round("quality_score", 1).cast("double").alias("quality_score"),
                F.round("median_sale_price").cast("double").alias("median_sale_price"),
                F.col("violation_count").cast("int"),
                F.col("complaint_count").cast("int"))
            .orderBy(F.col("quality_score").desc_nulls_first(), "zip_code")
            .limit(limit))


# Q3 / D10 -------------------------------------------------------------------
def towns_below_assessment(star, region: str = "CT", min_sales: int = 10,
                           limit: int = 15) -> DataFrame:
    """Share of sales below assessed value per town, towns with many sales."""
    below = F.col("sold_below_assessment")
    per_prop = (star.sales_transaction.groupBy("property_id")
                .agg(F.count(F.lit(1)).alias("n"), F.count_if(below).alias("b")))
    p = (star.property.where(F.col("region") == region)
         .select("property_id", "municipality_id"))
    g = (per_prop.join(p, "property_id")
         .join(star.municipality.select("municipality_id", "town_name"), "municipality_id")
         .groupBy("town_name")
         .agg(F.sum("n").alias("total_sales"), F.sum("b").alias("below_assessment"))
         .where(F.col("total_sales") > min_sales))
    return (g.select("town_name",
                     F.col("total_sales").cast("long"),
                     F.col("below_assessment").cast("long"),
                     X.pct(F.col("below_assessment"), F.col("total_sales"), 2)
                     .cast("double").alias("pct_below"))
            .orderBy(F.col("pct_below").desc_nulls_first(), "town_name")
            .limit(limit))


# Q4 / D7 -------------------------------------------------------------------
def attendance_vs_price(star, high_cut: float = 0.9, link_region: str = "NY") -> DataFrame:
    """Mean school attendance and mean sale price per school district.

    The reference joins district -> school -> property_school -> property ->
    sale, where property_school links every property of a borough to every
    school of it. That join is a product per borough; its averages factorise:
    over district d in borough b, avg(attendance) is the mean over d's
    schools and avg(price) the mean over b's linked sales. Both sides are
    aggregated to one row per district / per borough and joined — no pair is
    materialised. Districts with no school or no linked sale have no rows in
    the join and are absent here too.
    """
    dist = star.school_district.select("district_id", "borough_id")
    sch = (star.school.where(F.col("district_id").isNotNull())
           .join(dist.select("district_id"), "district_id", "left_semi")
           .groupBy("district_id")
           .agg(F.sum("attendance_rate").alias("sa"),
                F.count("attendance_rate").alias("na")))
    per_prop = _sales_by_property(star.sales_transaction)
    linked = (star.property.where(F.col("region") == link_region)
              .select("property_id", "borough_id"))
    bsales = (per_prop.join(linked, "property_id")
              .groupBy("borough_id")
              .agg(F.sum("s").alias("s"), F.sum("n_price").alias("n_price"),
                   F.sum("n").alias("n"))
              .where(F.col("n") > 0))
    d = (sch.join(dist, "district_id")
         .join(bsales, "borough_id")
         .join(star.borough.select("borough_id", "borough_name"), "borough_id"))
    att = _avg("sa", "na")
    return (d.select("borough_name",
                     F.round(att, 2).cast("double").alias("avg_attendance_rate"),
                     F.round(_avg("s", "n_price")).cast("double").alias("avg_sale_price"),
                     F.when(att > F.lit(high_cut), "High").otherwise("Low").alias("tier"),
                     att.alias("_att"), "district_id")
            .orderBy(F.col("_att").desc_nulls_first(), "district_id")
            .drop("_att", "district_id"))


# Q5 / D6 --------------------------------------------------------------------
def complaint_share_by_zip(star, min_count: int = 100, limit: int = 30) -> DataFrame:
    """Complaint types per zip with their share of the zip's kept groups."""
    from pyspark.sql import Window
    g = (star.service_request_311.where(F.col("zip_code").isNotNull())
         .groupBy("zip_code", "complaint_type")
         .agg(F.count(F.lit(1)).alias("cnt"))
         .where(F.col("cnt") > min_count))
    tot = F.sum("cnt").over(Window.partitionBy("zip_code"))
    return (g.select("zip_code", "complaint_type", F.col("cnt").cast("long"),
                     X.pct(F.col("cnt"), tot, 1).cast("double").alias("pct"))
            .orderBy(F.col("zip_code").asc_nulls_last(), F.col("cnt").desc_nulls_first(),
                     F.col("complaint_type").asc_nulls_last())
            .limit(limit))


# Q6 / D8 --------------------------------------------------------------------
def _value_change(fl: DataFrame, limit: int) -> DataFrame:
    return (fl.select("zip_code",
                      F.round("price_start").cast("double").alias("price_2020"),
                      F.round("price_end").cast("double").alias("price_latest"),
                      X.pct_change("price_start", "price_end", 1).cast("double")
                      .alias("pct_change"))
            .orderBy(F.col("pct_change").desc_nulls_first(), "zip_code")
            .limit(limit))


def home_value_change(star, limit: int = 20) -> DataFrame:
    """First and last monthly value per zip, literal window form.

    FIRST_VALUE/LAST_VALUE over zip-partitioned windows, then GROUP BY as
    dedup. A market series is one row per (zip, month), so each window
    partition is bounded by the number of months.
    """
    from pyspark.sql import Window
    ms = star.neighborhood_market_stat
    w = Window.partitionBy("zip_code").orderBy("stat_month")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fl = (ms.select("zip_code",
                    F.first("median_home_value").over(w).alias("price_start"),
                    F.last("median_home_value").over(wall).alias("price_end"))
          .distinct())
    return _value_change(fl, limit)


def home_value_change_minby(star, limit: int = 20) -> DataFrame:
    """Same result as ``home_value_change`` as one partial aggregation.

    Equal when (zip, month) is unique (checked by ``dq_primary_key`` on the
    market table); no sort of any partition.
    """
    ms = star.neighborhood_market_stat.where(F.col("stat_month").isNotNull())
    fl = ms.groupBy("zip_code").agg(
        F.min_by("median_home_value", "stat_month").alias("price_start"),
        F.max_by("median_home_value", "stat_month").alias("price_end"))
    return _value_change(fl, limit)


# Q7 / D2 --------------------------------------------------------------------
def price_by_type(star, with_per_sqft: bool = True, approx_median: bool = False) -> DataFrame:
    """Count, mean, exact median and mean price per sqft per property type.

    ``approx_median`` uses ``percentile_approx`` (a bounded sketch per type)
    instead of the exact distributed ``percentile_cont``.
    """
    st = star.sales_transaction
    p = star.property.where(F.col("property_type").isNotNull()).select(
        "property_id", "property_type")
    # The facts are joined once, down to one row per type and price; sums,
    # counts and the median all come from that table.
    prices = stage(st.select("property_id", "sale_price", "price_per_sqft").join(p, "property_id")
                   .groupBy("property_type", "sale_price")
                   .agg(F.count(F.lit(1)).alias("w"), F.sum("price_per_sqft").alias("sq"),
                        F.count("price_per_sqft").alias("n_sq")), "type_prices")
    priced = F.col("sale_price").isNotNull()
    g = prices.groupBy("property_type").agg(
        F.sum("w").alias("n"), F.sum(F.col("sale_price") * F.col("w").cast("decimal(12,0)")).alias("s"),
        F.sum(F.when(priced, F.col("w")).otherwise(0)).alias("n_price"),
        F.sum("sq").alias("sq"), F.sum("n_sq").alias("n_sq"))
    if approx_median:
        med = (st.select("property_id", "sale_price").join(p, "property_id")
               .groupBy("property_type")
               .agg(F.percentile_approx("sale_price", 0.5, 10000).alias("med")))
    else:
        med = percentile_cont(prices.where(priced), ["property_type"], "sale_price", 0.5, alias="med", weight="w")
    cols = [F.col("property_type"),
            F.col("n").cast("long").alias("num_sales"),
            F.round(_avg("s", "n_price")).cast("double").alias("avg_price"),
            F.bround("med", 0).cast("double").alias("median_price")]
    if with_per_sqft:
        cols.append(F.round(_avg("sq", "n_sq"), 2).cast("double").alias("avg_price_per_sqft"))
    return (g.join(med, "property_type", "left").select(*cols)
            .orderBy(F.col("avg_price").desc_nulls_first(), "property_type"))


def market_overview_by_type(star) -> DataFrame:
    """Dashboard variant of ``price_by_type`` without the per-sqft mean."""
    return price_by_type(star, with_per_sqft=False)


# Q8 / D9 -------------------------------------------------------------------
def _gain_cols() -> list[Column]:
    first, last = F.col("first_price"), F.col("last_price")
    return [F.col("address"), F.col("zip_code"), F.col("borough_name"),
            first.cast("double").alias("first_price"),
            last.cast("double").alias("last_price"),
            F.round(last - first).cast("double").alias("price_gain"),
            X.pct_change(first, last, 1).cast("double").alias("pct_gain")]


def price_gain(star, min_sales: int = 2, limit: int = 20) -> DataFrame:
    """Properties with the largest spread between lowest and highest price.

    The reference names them first/last price but computes MIN/MAX; kept.
    """
    ms = (star.price_history.groupBy("property_id")
          .agg(F.min("sale_price").alias("first_price"),
               F.max("sale_price").alias("last_price"),
               F.count(F.lit(1)).alias("num_sales"))
          .where(F.col("num_sales") >= min_sales))
    j = (ms.join(star.property.select("property_id", "address", "zip_code", "borough_id"),
                 "property_id")
         .join(star.borough.select("borough_id", "borough_name"), "borough_id"))
    return (j.select(*_gain_cols(), "property_id")
            .orderBy(F.col("pct_gain").desc_nulls_first(), "property_id")
            .limit(limit).drop("property_id"))


def price_gain_dedup(star, min_dates: int = 2, limit: int = 20) -> DataFrame:
    """Dashboard variant: distinct sale dates, one row per (address, zip).

    DISTINCT ON (address, zip) ... ORDER BY last_price DESC keeps the row
    with the highest last price (ties: lowest property id), computed as a
    partial aggregate.
    """
    ms = (star.price_history.groupBy("property_id")
          .agg(F.min("sale_price").alias("first_price"),
               F.max("sale_price").alias("last_price"),
               F.count_distinct("sale_date").alias("num_sales"))
          .where(F.col("num_sales") >= min_dates))
    j = (ms.join(star.property.select("property_id", "address", "zip_code", "borough_id"),
                 "property_id")
         .join(star.borough.select("borough_id", "borough_name"), "borough_id")
         .select("property_id", "address", "zip_code", "borough_name",
                 "first_price", "last_price"))
    d = distinct_on(j, ["address", "zip_code"],
                    [Order("last_price", desc=True), Order("property_id")])
    return (d.select(*_gain_cols(), "property_id")
            .orderBy(F.col("pct_gain").desc_nulls_first(), "property_id")
            .limit(limit).drop("property_id"))


# Q9 / D5 -------------------------------------------------------------------
def score_tiers(score: DataFrame, high: float = 80, medium: float = 60) -> DataFrame:
    """Zips, mean price, violations and complaints per score tier."""
    q = F.col("quality_score")
    tier = (F.when(q >= high, F.lit(f"High ({high:g}-100)"))
             .when(q >= medium, F.lit(f"Medium ({medium:g}-{high - 1:g})"))
             .otherwise(F.lit(f"Low (<{medium:g})")))
    g = (score.where(F.col("median_sale_price").isNotNull())
         .groupBy(tier.alias("quality_tier"))
         .agg(F.count(F.lit(1)).alias("zip_count"),
              F.avg("median_sale_price").alias("p"),
              F.avg(F.col("violation_count").cast("decimal(20,0)")).alias("v"),
              F.avg(F.col("complaint_count").cast("decimal(20,0)")).alias("c")))
    return (g.select("quality_tier", F.col("zip_count").cast("long"),
                     F.round("p").cast("double").alias("avg_sale_price"),
                     F.round("v", 1).cast("double").alias("avg_violations"),
                     F.round("c", 1).cast("double").alias("avg_complaints"))
            .orderBy(F.col("avg_sale_price").desc_nulls_first(), "quality_tier"))


# Q10 / D3 ------------------------------------------------------------------
def annual_trend(star, start_year: int | None = 2020,
                 exclude_borough: str | None = None) -> DataFrame:
    """Sales count and mean price per borough and year.

    ``start_year`` keeps years >= it (written as a date range so it reaches
    the scan); ``exclude_borough`` drops one borough by name (dashboard
    variant). NULL sale dates are dropped.
    """
    cond = F.col("sale_date").isNotNull()
    if start_year is not None:
        cond = cond & (F.col("sale_date") >= F.lit(f"{start_year}-01-01").cast("date"))
    per = _sales_by_property(star.sales_transaction,
                             [F.year("sale_date").alias("year")], cond)
    b = star.borough.select("borough_id", "borough_name")
    if exclude_borough is not None:
        b = b.where(F.col("borough_name") != exclude_borough)
    g = (per.join(star.property.select("property_id", "borough_id"), "property_id")
         .join(b, "borough_id")
         .groupBy("borough_name", "year")
         .agg(F.sum("s").alias("s"), F.sum("n_price").alias("n_price"),
              F.sum("n").alias("num_sales")))
    return (g.select("borough_name", F.col("year").cast("int"),
                     F.col("num_sales").cast("long"),
                     F.round(_avg("s", "n_price")).cast("double").alias("avg_price"))
            .orderBy(F.col("borough_name").asc_nulls_last(), F.col("year").asc_nulls_last()))


def annual_trend_city(star, exclude_borough: str = "CONNECTICUT") -> DataFrame:
    """Dashboard variant: all years, the state-feed borough left out."""
    return annual_trend(star, start_year=None, exclude_borough=exclude_borough)
