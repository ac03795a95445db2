"""Literal dimension tables of the ingest (small, fixed size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import schemas as S

# The boroughs in load order (their ids follow this order) and
# their state.
BOROUGHS = [
    ("MANHATTAN", "NY"),
    ("BRONX", "NY"),
    ("BROOKLYN", "NY"),
    ("QUEENS", "NY"),
    ("STATEN ISLAND", "NY"),
    ("CONNECTICUT", "CT"),
]
# School district number ranges per borough (1-32).
DISTRICT_RANGES = [
    (1, 6, "MANHATTAN"),
    (7, 12, "BRONX"),
    (13, 23, "BROOKLYN"),
    (24, 30, "QUEENS"),
    (31, 32, "STATEN ISLAND"),
]


def boroughs(spark: SparkSession) -> DataFrame:
    """borough(borough_id, borough_name, state); ids 1..6 in load order."""
    rows = [(i + 1, n, s) for i, (n, s) in enumerate(BOROUGHS)]
    return spark.createDataFrame(rows, S.BOROUGH)


def school_districts(spark: SparkSession, borough: DataFrame | None = None) -> DataFrame:
    """school_district(district_id, borough_id) for districts 1..32."""
    b = borough if borough is not None else boroughs(spark)
    d = F.col("id")
    name = F.lit(None).cast("string")
    for lo, hi, nm in reversed(DISTRICT_RANGES):
        name = F.when(d.between(lo, hi), F.lit(nm)).otherwise(name)
    lo = min(r[0] for r in DISTRICT_RANGES)
    hi = max(r[1] for r in DISTRICT_RANGES)
    ds = spark.range(lo, hi + 1).select(d.cast("int").alias("district_id"),
                                        name.alias("borough_name"))
    return (ds.join(F.broadcast(b.select("borough_id", "borough_name")), "borough_name", "left")
            .select("district_id", "borough_id"))
