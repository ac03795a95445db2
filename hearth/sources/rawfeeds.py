"""Raw source feeds made from the driver's test tables.

The reference ingests six text files (city sales, state sales, violations,
311 requests, wide home values, long school metrics). None ships with it, so
each feed is derived here from the test tables as all-STRING columns in the
source files' layout, with messy text mixed in by a deterministic rule
(currency signs, thousands separators, ``.0`` zips, padding, other date
formats, ``N/A``, unmapped codes). The ingest jobs then clean them exactly as
they would clean the files. Every feed covers the whole underlying table.

The DuckDB oracle builds the same strings independently (``hearth.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.operators.partitioning import spread_small_input
from hearth.sources.testviews import TestStar

_PC = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _money(cents: str) -> str:
    """cents -> 'd.cc' (Spark SQL)."""
    return (f"concat(CAST(({cents}) div 100 AS STRING), '.', "
            f"lpad(CAST(({cents}) % 100 AS STRING), 2, '0'))")


_BORO = """CASE {k} % 6 WHEN 0 THEN 'manhattan' WHEN 1 THEN 'BRONX' WHEN 2 THEN 'Brooklyn'
  WHEN 3 THEN 'QUEENS' WHEN 4 THEN 'staten island' ELSE 'unknown' END"""


def _orders(t: TestStar) -> DataFrame:
    o = spread_small_input(t.raw("orders"))
    c = t.raw("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = t.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, F.col("c_nationkey") == n.n_nationkey))


def city_sales(t: TestStar) -> DataFrame:
    """City rolling-sales file: one row per order; ``_ord`` = file position."""
    return _orders(t).selectExpr(
        "o_orderkey AS _ord",
        "CASE WHEN o_orderkey % 11 = 0 THEN '9' ELSE CAST(n_regionkey + 1 AS STRING) END AS borough",
        "n_name AS neighborhood",
        "concat(lpad(CAST(o_custkey % 16 AS STRING), 2, '0'), ' ', o_orderpriority) "
        "AS building_class_category",
        "c_name AS address",
        """CASE WHEN o_orderkey % 13 = 0 THEN concat(CAST(c_nationkey AS STRING), '.0')
                WHEN o_orderkey % 17 = 0 THEN 'N/A'
                WHEN o_orderkey % 19 = 0
                     THEN concat(' ', lpad(CAST(c_nationkey AS STRING), 5, '0'), '\t')
                ELSE lpad(CAST(c_nationkey AS STRING), 5, '0') END AS zip_code""",
        "CASE WHEN o_orderkey % 23 = 0 THEN '2.7' ELSE CAST(o_custkey % 4 + 1 AS STRING) END "
        "AS residential_units",
        "format_number(o_custkey * 7, 0) AS land_square_feet",
        """CASE WHEN o_orderkey % 29 = 0 THEN '0' WHEN o_orderkey % 31 = 0 THEN '-'
                ELSE format_number(CAST(floor(o_totalprice / 100) AS BIGINT), 0) END
           AS gross_square_feet""",
        "CAST(1900 + o_custkey % 120 AS STRING) AS year_built",
        f"""CASE WHEN o_orderkey % 7 = 0 THEN '0' WHEN o_orderkey % 41 = 0 THEN 'n/a'
                 ELSE concat('$', format_number({_PC} div 100, 0), '.',
                             lpad(CAST({_PC} % 100 AS STRING), 2, '0')) END AS sale_price""",
        """CASE WHEN o_orderkey % 37 = 0 THEN 'not a date'
                WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
                ELSE date_format(o_orderdate, 'MM/dd/yyyy') END AS sale_date""")


def state_sales(t: TestStar) -> DataFrame:
    """State sales file: town, address, amounts as text, recorded date, use."""
    pct = "(80 + o_orderkey % 40)"
    return _orders(t).selectExpr(
        "o_orderkey AS _ord",
        "n_name AS town",
        "concat(o_orderpriority, ' ', c_mktsegment) AS address",
        f"""CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 'NaN'
                 ELSE {_money(_PC)} END AS saleamount""",
        f"CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE {_money(f'({_PC} * {pct}) div 100')} END "
        "AS assessedvalue",
        "CASE WHEN o_orderkey % 29 = 0 THEN 'unknown' ELSE date_format(o_orderdate, 'MM/dd/yyyy') END "
        "AS daterecorded",
        f"{_money(pct)} AS salesratio",
        """CASE o_orderkey % 8 WHEN 0 THEN 'Single Family' WHEN 1 THEN 'Two Family'
                WHEN 2 THEN 'Three Family' WHEN 3 THEN 'Condo' WHEN 4 THEN 'Apartment'
                WHEN 5 THEN 'Townhouse' WHEN 6 THEN 'Commercial' ELSE 'Vacant Land' END
           AS propertytype""")


def _geo(sign: str = "") -> str:
    vc = "CAST(round(value * 100) AS BIGINT)"
    return (f"CASE WHEN event_id % 59 = 0 THEN 'n/a' "
            f"ELSE concat('{sign}', {_money(vc)}) END")


def violations(t: TestStar) -> DataFrame:
    """Housing-violation file from the ``error`` events."""
    e = spread_small_input(t.raw("events")).where(F.col("event_type") == "error")
    return e.selectExpr(
        "event_id AS _ord",
        "CASE WHEN event_id % 53 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS violationid",
        """CASE WHEN event_id % 5 = 0 THEN concat(CAST(user_id % 30 AS STRING), '.0')
                ELSE lpad(CAST(user_id % 30 AS STRING), 5, '0') END AS zip""",
        _BORO.format(k="user_id") + " AS boro",
        "CAST(user_id AS STRING) AS housenumber",
        "concat('STREET ', CAST(user_id % 50 AS STRING)) AS streetname",
        "substr('ABC', CAST(event_id % 3 AS INT) + 1, 1) AS class",
        "CASE WHEN event_id % 47 = 0 THEN 'N/A' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END "
        "AS inspectiondate",
        "CASE WHEN event_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSE' END AS currentstatus",
        "CASE WHEN event_id % 4 < 2 THEN 'OPEN' ELSE 'CLOSE' END AS violationstatus",
        "props AS novdescription",
        f"{_geo()} AS latitude",
        f"{_geo('-')} AS longitude")


def requests_311(t: TestStar) -> DataFrame:
    """311 service-request file from the other events."""
    e = spread_small_input(t.raw("events")).where(F.col("event_type") != "error")
    return e.selectExpr(
        "event_id AS _ord",
        "CAST(event_id AS STRING) AS unique_key",
        "CASE WHEN event_id % 61 = 0 THEN 'bad' ELSE date_format(ts, 'MM/dd/yyyy hh:mm:ss a') END "
        "AS created_date",
        "upper(event_type) AS complaint_type",
        "concat(event_type, ' report') AS descriptor",
        "CASE WHEN event_id % 9 = 0 THEN NULL ELSE lpad(CAST(user_id % 30 AS STRING), 5, '0') END "
        "AS incident_zip",
        _BORO.format(k="user_id") + " AS borough",
        "CASE WHEN event_id % 3 = 0 THEN 'Closed' ELSE 'Open' END AS status",
        f"{_geo()} AS latitude",
        f"{_geo('-')} AS longitude")


def home_values_long(t: TestStar) -> DataFrame:
    """(RegionName, StateName, month, value text) before widening."""
    li = t.raw("lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    s = t.raw("supplier").select("s_suppkey", "s_nationkey")
    n = t.raw("nation").select("n_nationkey", "n_regionkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    g = (li.join(s, li.l_suppkey == s.s_suppkey)
         .join(n, F.col("s_nationkey") == n.n_nationkey)
         .groupBy((F.col("s_suppkey") % 30).cast("string").alias("RegionName"),
                  F.when(F.col("n_regionkey") == 4, "CT").otherwise("NY").alias("StateName"),
                  F.date_format(F.trunc(F.col("l_shipdate").cast("date"), "month"),
                                "yyyy-MM-dd").alias("month"))
         .agg(F.sum(cents).alias("c"), F.count(F.lit(1)).alias("n")))
    return g.selectExpr("RegionName", "StateName", "month",
                        _money("(2 * c + n) div (2 * n)") + " AS value")


def home_values_wide(t: TestStar) -> DataFrame:
    """Wide home-value file: one column per month named ``yyyy-MM-dd``."""
    return (home_values_long(t).groupBy("RegionName", "StateName")
            .pivot("month").agg(F.first("value")))


def school_metrics(t: TestStar) -> DataFrame:
    """Long school-metric file from events (one metric value per row)."""
    e = t.raw("events")
    return e.selectExpr(
        "event_id AS _ord",
        """CASE WHEN user_id % 37 = 0 THEN concat('AB', 'X', CAST(user_id AS STRING))
                ELSE concat(lpad(CAST(user_id % 40 AS STRING), 2, '0'), 'X', CAST(user_id AS STRING))
           END AS dbn""",
        "concat('School ', CAST(user_id AS STRING), ' ', event_type) AS school_name",
        "CASE event_id % 3 WHEN 0 THEN 'Elementary' WHEN 1 THEN 'Middle' ELSE 'K-8' END AS school_type",
        """CASE event_type WHEN 'view' THEN 'attendance_k8_all'
                WHEN 'click' THEN 'chronic_absent_ems_all' ELSE event_type END
           AS metric_variable_name""",
        """CASE WHEN event_id % 41 = 0 THEN 'N/A'
                ELSE concat('0.', lpad(CAST(CAST(round(value * 100) AS BIGINT) % 1000 AS STRING), 3, '0'))
           END AS metric_value""")
