"""The derived neighbourhood quality score (one row per zip per month).

Inputs are aggregated to one row per zip first (violations, complaints,
sales, school attendance) and left-joined to the zip dimension; all four
aggregates hash-partition on ``zip_code`` so the join chain reuses that
partitioning.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth import schemas as S
from hearth.functions import expr as X
from hearth.operators.keys import dense_keys


# E1 ------------------------------------------------------------------------
def sales_by_zip(star) -> DataFrame:
    """Per zip: mean sale price (named median, as in the reference) and the
    percentage of sales below assessed value."""
    per_prop = (star.sales_transaction.groupBy("property_id")
                .agg(F.sum("sale_price").alias("s"), F.count("sale_price").alias("n_price"),
                     F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col("sold_below_assessment")).alias("b")))
    p = star.property.where(F.col("zip_code").isNotNull()).select("property_id", "zip_code")
    g = (per_prop.join(p, "property_id").groupBy("zip_code")
         .agg(*[F.sum(c).alias(c) for c in ("s", "n_price", "n", "b")]))
    mean = F.col("s").cast("decimal(38,6)") / F.nullif(F.col("n_price"), F.lit(0)).cast("decimal(20,0)")
    return g.select("zip_code",
                    mean.cast(S.MONEY).alias("median_sale_price"),
                    X.pct(F.col("b"), F.col("n"), 2).cast(S.PCT).alias("pct_sold_below_assessment"))


# E2 ------------------------------------------------------------------------
def attendance_by_zip(star, link_region: str = "NY", exact: bool = True) -> DataFrame:
    """Mean attendance of the schools linked to each zip's properties.

    Links are by borough: every property of ``link_region`` is linked to
    every school whose district lies in the property's borough. Instead of
    materialising those pairs, schools are reduced to (borough: sum, count of
    non-NULL attendance) and properties to (zip, borough: count); the mean
    per zip is sum(n * sum_att) / sum(n * cnt_att) — equal to the mean over
    the literal pair join. Result: NUMERIC(5,3) (``exact=False`` keeps the
    unrounded decimal for further arithmetic).
    """
    dist = star.school_district.select("district_id", "borough_id")
    sch = (star.school.where(F.col("district_id").isNotNull())
           .join(dist, "district_id")
           .groupBy("borough_id")
           .agg(F.sum("attendance_rate").alias("sa"),
                F.count("attendance_rate").alias("na"),
                F.count(F.lit(1)).alias("ns")))
    props = (star.property.where((F.col("region") == link_region)
                                 & F.col("zip_code").isNotNull())
             .groupBy("zip_code", "borough_id").agg(F.count(F.lit(1)).alias("np")))
    g = (props.join(sch, "borough_id")
         .groupBy("zip_code")
         .agg(F.sum(F.col("np") * F.col("sa")).alias("s"),
              F.sum(F.col("np") * F.col("na")).alias("n")))
    mean = F.col("s").cast("decimal(38,12)") / F.nullif(F.col("n"), F.lit(0)).cast("decimal(20,0)")
    return g.select("zip_code", (mean.cast(S.RATE) if exact else mean)
                    .alias("avg_school_attendance"))


# E3 ------------------------------------------------------------------------
def quality_score(star, as_of: str | _dt.date = "2024-06-15",
                  approx_distinct: bool = False) -> DataFrame:
    """The score table: counts, attendance, sales and the composite score.

    Violations and complaints are distinct ids per zip (NULL zip dropped);
    zips outside the dimension are not scored. ``score_month`` is the first
    day of ``as_of``'s month. ``approx_distinct`` swaps the exact distinct
    counts for HyperLogLog++ sketches (bounded memory per zip, ~1% error).
    """
    def distinct(c: str):
        return F.approx_count_distinct(c, 0.01) if approx_distinct else F.count_distinct(c)

    viol = (star.housing_violation.where(F.col("zip_code").isNotNull())
            .groupBy("zip_code")
            .agg(distinct("violation_id").alias("violation_count")))
    compl = (star.service_request_311.where(F.col("zip_code").isNotNull())
             .groupBy("zip_code")
             .agg(distinct("request_id").alias("complaint_count")))
    sales = sales_by_zip(star)
    att = attendance_by_zip(star, exact=False)
    z = (star.neighborhood.select("zip_code")
         .join(viol, "zip_code", "left")
         .join(compl, "zip_code", "left")
         .join(sales, "zip_code", "left")
         .join(att, "zip_code", "left"))
    v = F.coalesce(F.col("violation_count"), F.lit(0))
    c = F.coalesce(F.col("complaint_count"), F.lit(0))
    scored = z.select(
        "zip_code",
        X.month_start(as_of).alias("score_month"),
        v.cast("int").alias("violation_count"),
        c.cast("int").alias("complaint_count"),
        F.col("avg_school_attendance").cast(S.RATE).alias("avg_school_attendance"),
        "median_sale_price", "pct_sold_below_assessment",
        X.quality_score(v, c, F.col("avg_school_attendance")).alias("quality_score"))
    # One row per zip of the dimension: bounded by the zip domain, so a single
    # ordered window numbers it.
    return dense_keys(scored, ["zip_code"], key="score_id", method="window")
