"""Named ingest, operator and data-quality queries over the test feeds.

Each runs a library job on feeds derived from the whole test tables
(``hearth.sources.rawfeeds``) or on the test star, and returns a DataFrame
whose columns the DuckDB oracle reproduces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth import schemas as S
from hearth.functions import clean as C
from hearth.operators import joins as J
from hearth.operators import quality as Q
from hearth.operators.blocks import stage
from hearth.operators.dedup import Order, distinct_on
from hearth.operators.quantile import percentile_cont
from hearth.plans import ingest as I
from hearth.sources import literal, rawfeeds
from hearth.sources.testviews import TestStar

HOME_MIN_MONTH = "2000"     # reference: "2020"; test months span 1995-2001


def _src(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("_ord", "src")


def _city(t: TestStar) -> DataFrame:
    return I.clean_city_sales(rawfeeds.city_sales(t))


def _state(t: TestStar) -> DataFrame:
    return I.clean_state_sales(rawfeeds.state_sales(t))


def _boroughs(t: TestStar) -> DataFrame:
    return literal.boroughs(t.spark)


# ---- ingest ---------------------------------------------------------------
def ingest_city_sales(t: TestStar) -> DataFrame:
    return _src(_city(t).drop("neighborhood"))


def ingest_state_sales(t: TestStar) -> DataFrame:
    return _src(_state(t))


def keep_first_by_key(t: TestStar) -> DataFrame:
    return I.neighborhoods(_city(t), _boroughs(t))


def surrogate_keys(t: TestStar) -> DataFrame:
    return I.city_properties(_city(t), _boroughs(t))


def _ny_sales(t: TestStar) -> DataFrame:
    city = stage(_city(t), "city_sales")
    return I.city_sales(city, I.city_properties(city, _boroughs(t)))


def sales_key_resolution(t: TestStar) -> DataFrame:
    return I.number_sales(_ny_sales(t))


def price_history(t: TestStar) -> DataFrame:
    return I.price_history(I.number_sales(_ny_sales(t)))


def sales_key_resolution_parity(t: TestStar) -> DataFrame:
    return J.fanout_counts(_city(t), ["address", "zip_code"])


def state_key_resolution_parity(t: TestStar) -> DataFrame:
    return J.fanout_counts(_state(t), ["address"])


def ingest_municipalities(t: TestStar) -> DataFrame:
    return I.municipalities(_state(t))


def _ct(t: TestStar):
    st = stage(_state(t), "state_sales")
    towns = I.municipalities(st)
    props = I.state_properties(st, towns)
    return st, props


def _number_ct(sales: DataFrame) -> DataFrame:
    """State-feed rows numbered 1..n in file order (their own id sequence)."""
    from hearth.operators.keys import dense_keys
    return dense_keys(sales, ["_ord"], key="transaction_id").drop("_ord")


def assessment_history(t: TestStar) -> DataFrame:
    st, props = _ct(t)
    return I.assessment_history(_number_ct(I.state_sales(st, props)))


def union_regions(t: TestStar) -> DataFrame:
    st = stage(_state(t), "state_sales")
    ct_rows = I.state_property_rows(st, I.municipalities(st))
    return I.union_regions(I.city_property_rows(_city(t), _boroughs(t)), ct_rows)


def ingest_incidents(t: TestStar) -> DataFrame:
    return I.housing_violations(rawfeeds.violations(t), _boroughs(t))


def ingest_requests_311(t: TestStar) -> DataFrame:
    return I.service_requests(rawfeeds.requests_311(t), _boroughs(t))


def ingest_home_values(t: TestStar) -> DataFrame:
    return I.home_values(rawfeeds.home_values_wide(t), t.neighborhood, minimum=HOME_MIN_MONTH)


def _schools(t: TestStar):
    return I.split_schools(I.schools(rawfeeds.school_metrics(t)),
                           literal.school_districts(t.spark))


def ingest_schools(t: TestStar) -> DataFrame:
    return _schools(t)[0]


def school_quarantine(t: TestStar) -> DataFrame:
    return _schools(t)[1]


def property_school_links(t: TestStar) -> DataFrame:
    return J.borough_links(t.property, t.school, t.school_district)


def semi_known_zips(t: TestStar) -> DataFrame:
    v = t.housing_violation_with(30).select("violation_id", "zip_code")
    return J.semi_known(v, t.neighborhood, "zip_code")


def anti_orphans(t: TestStar) -> DataFrame:
    v = t.housing_violation_with(30).select("violation_id", "zip_code")
    return J.anti_orphans(v, t.neighborhood, "zip_code")


def distinct_on_lines(t: TestStar) -> DataFrame:
    li = t.raw("lineitem")
    order = [Order("l_extendedprice", desc=True)] + [
        Order(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
                           "l_returnflag", "l_linestatus", "l_shipdate")]
    return distinct_on(li, ["l_orderkey", "l_linenumber"], order)


def exact_median(t: TestStar) -> DataFrame:
    li = t.raw("lineitem").select(
        "l_returnflag", "l_linestatus",
        F.col("l_extendedprice").cast(S.MONEY).alias("price"))
    return percentile_cont(li, ["l_returnflag", "l_linestatus"], "price", 0.5,
                           alias="median_price")


# ---- cleaners -------------------------------------------------------------
def clean_int(t: TestStar) -> DataFrame:
    r = rawfeeds.city_sales(t)
    cols = ["gross_square_feet", "land_square_feet", "year_built", "residential_units"]
    return r.select(F.col("_ord").alias("src"),
                    *[C.clean_int(c).alias(c) for c in cols])


def clean_price(t: TestStar) -> DataFrame:
    r = rawfeeds.city_sales(t)
    return r.select(F.col("_ord").alias("src"), "sale_price",
                    C.clean_price("sale_price").alias("price"))


def clean_zip(t: TestStar) -> DataFrame:
    r = rawfeeds.city_sales(t)
    v = rawfeeds.violations(t)
    return (r.select(F.col("_ord").alias("src"), F.lit("city").alias("feed"),
                     F.col("zip_code").alias("raw"), C.clean_zip("zip_code").alias("zip"))
            .unionByName(v.select(F.col("_ord").alias("src"), F.lit("violation").alias("feed"),
                                  F.col("zip").alias("raw"), C.clean_zip("zip").alias("zip"))))


def parse_dates_coerce(t: TestStar) -> DataFrame:
    r = rawfeeds.city_sales(t)
    s = rawfeeds.state_sales(t)
    return (r.select(F.col("_ord").alias("src"), F.lit("city").alias("feed"),
                     C.parse_date("sale_date").alias("d"))
            .unionByName(s.select(F.col("_ord").alias("src"), F.lit("state").alias("feed"),
                                  C.parse_date("daterecorded").alias("d"))))


def parse_numbers_coerce(t: TestStar) -> DataFrame:
    s = rawfeeds.state_sales(t)
    return s.select(F.col("_ord").alias("src"),
                    C.parse_number("saleamount").alias("saleamount"),
                    C.parse_number("assessedvalue").alias("assessedvalue"),
                    C.parse_number("salesratio").alias("salesratio"))


def sold_below_flag(t: TestStar) -> DataFrame:
    from hearth.functions import expr as X
    st = _state(t)
    return st.select(F.col("_ord").alias("src"), "sale_price", "assessed_value",
                     X.sold_below_assessment("sale_price", "assessed_value")
                     .alias("sold_below_assessment"))


def price_per_sqft(t: TestStar) -> DataFrame:
    c = _city(t)
    return c.select(F.col("_ord").alias("src"), "sale_price", "gross_sqft", "price_per_sqft")


# ---- data quality ---------------------------------------------------------
class _OrphanStar:
    """The test star with violations that may point outside the zip dimension."""

    def __init__(self, t: TestStar):
        self._t = t

    def __getattr__(self, name):
        if name == "housing_violation":
            return self._t.housing_violation_with(30)
        return getattr(self._t, name)


STAR_TABLES = ["borough", "neighborhood", "municipality", "property", "sales_transaction",
               "price_history", "assessment_history", "housing_violation",
               "service_request_311", "school_district", "school",
               "neighborhood_market_stat", "neighborhood_quality_score"]


def dq_pk(t: TestStar) -> DataFrame:
    li = Q.key_report(t.raw("lineitem"), "lineitem", [("duplicate_key", ["l_orderkey", "l_linenumber"], False)])
    days = Q.key_report(t.raw("orders"), "orders", [("duplicate_unique", ["o_custkey", "o_orderdate"], False)])
    return Q.primary_key_report(t, STAR_TABLES).unionByName(li).unionByName(days)


def dq_not_null(t: TestStar) -> DataFrame:
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("has_line")).distinct()
    orders = t.raw("orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return Q.not_null_report(t, STAR_TABLES).unionByName(Q._counts_one_pass(
        orders, "orders", [("not_null", "has_line", F.col("has_line").isNull())]))


def dq_fk(t: TestStar) -> DataFrame:
    zips = ("housing_violation", "zip_code", "neighborhood", "zip_code")
    return Q.foreign_key_report(_OrphanStar(t), STAR_TABLES, [*S.FOREIGN_KEYS, zips])


def dq_length(t: TestStar) -> DataFrame:
    return Q.length_report(t, STAR_TABLES).unionByName(Q._counts_one_pass(
        t.raw("part"), "part", [("length>9", "p_type", F.length("p_type") > 9)]))


def dq_decimal(t: TestStar) -> DataFrame:
    def fits(c: str, p: int, s: int):
        return (f"numeric({p},{s})", c,
                F.col(c).isNotNull() & F.col(c).try_cast(f"decimal({p},{s})").isNull())
    st = Q._counts_one_pass(_state(t), "state_sales",
                            [fits("sale_price", 15, 2), fits("assessed_value", 15, 2),
                             fits("sales_ratio", 8, 4)])
    v = rawfeeds.violations(t).select(C.parse_number("latitude").alias("latitude"))
    return st.unionByName(Q._counts_one_pass(v, "violations", [fits("latitude", 4, 2)]))


def dq_duplicates(t: TestStar) -> DataFrame:
    """V8 where a part of the feed was delivered twice."""
    again = t.price_history.where(F.col("history_id") % 7 == 0)
    return Q.duplicate_keys(t.price_history.unionByName(again), ["property_id", "sale_price", "sale_date"])


def dq_defaults(t: TestStar) -> DataFrame:
    """DDL defaults filled where the feed carries no value: the state of a
    town (the state feed has no state column, the DDL default is 'CT')."""
    towns = (_state(t).select(F.col("town").alias("town_name"),
                              F.lit(None).cast("string").alias("state")).distinct())
    return Q.apply_defaults(towns, S.DEFAULTS["municipality"])


def dq_unique_month(t: TestStar) -> DataFrame:
    """(zip, month) is a key of the market statistics: the first and last
    value of a series are only defined if it is."""
    return Q.key_report(t.neighborhood_market_stat, "neighborhood_market_stat", [
        ("duplicate_unique", ["zip_code", "stat_month"], False), ("duplicate_unique", ["zip_code"], False)])


def dq_duplicate_days(t: TestStar) -> DataFrame:
    """V8 on rows that do violate it: two sales of a property on one day."""
    return Q.duplicate_keys(t.price_history, ["property_id", "sale_date"])


def dq_defaults_partial(t: TestStar) -> DataFrame:
    """V7 where some rows carry the value and some do not."""
    towns = t.municipality.select("municipality_id", "town_name",
                                  F.when(F.col("municipality_id") % 2 == 0, F.col("state")).alias("state"))
    return Q.apply_defaults(towns, S.DEFAULTS["municipality"])


def _overflowing(t: TestStar) -> DataFrame:
    """The city feed with prices beyond NUMERIC(15,2) and areas that make the
    price per square foot overflow NUMERIC(10,2)."""
    big, dense = F.col("_ord") % 97 == 0, F.col("_ord") % 89 == 0
    return (rawfeeds.city_sales(t)
            .withColumn("sale_price", F.when(big, "1e20").when(dense, "$200,000,000").otherwise(F.col("sale_price")))
            .withColumn("gross_square_feet", F.when(dense, "1").otherwise(F.col("gross_square_feet"))))


def dq_overflow(t: TestStar) -> DataFrame:
    """V6 over rows that overflow: how many values do not fit, and that the
    cleaner passes over them with NULL instead of failing."""
    raw = _overflowing(t)
    typed = raw.select(C.clean_price("sale_price").alias("sale_price"),
                       (C.clean_price("sale_price") / F.nullif(C.clean_int("gross_square_feet"), F.lit(0)))
                       .alias("price_per_sqft"))
    bad = [Q._count(Q.decimal_overflow(typed.select(c), {c: spec}), "city_sales", "numeric({},{})".format(*spec), c)
           for c, spec in (("sale_price", (15, 2)), ("price_per_sqft", (10, 2)))]
    clean = I.clean_city_sales(raw)
    nulls = Q._count(clean.where(F.col("price_per_sqft").isNull() & (F.col("gross_sqft") == 1)),
                     "city_sales", "overflow_is_null", "price_per_sqft")
    return bad[0].unionByName(bad[1]).unionByName(nulls)


def dq_reject_report(t: TestStar) -> DataFrame:
    return I.reject_report({"city_sales": rawfeeds.city_sales(t), "state_sales": rawfeeds.state_sales(t),
                            "violations": rawfeeds.violations(t)})


def json_array_records(t: TestStar) -> DataFrame:
    """Events as an open-data array export (one object per line), read back."""
    from hearth.sources.files import json_records
    e = t.raw("events")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"),
                              F.col("props").alias("props")))
    lines = e.select(F.concat(F.when(F.col("event_id") % 7 == 0, "[").otherwise(","), body,
                              F.when(F.col("event_id") % 11 == 0, "]").otherwise("")).alias("value"))
    marks = e.where(F.col("event_id") % 13 == 0).select(F.lit("]").alias("value"))
    return json_records(lines.unionByName(marks), ["id", "kind", "props"])


def dq_rejects(t: TestStar) -> DataFrame:
    return I.city_rejects(rawfeeds.city_sales(t))


def dq_outliers(t: TestStar) -> DataFrame:
    g = (t.price_history.groupBy("property_id")
         .agg(F.min("sale_price").alias("low"), F.max("sale_price").alias("high")))
    return Q.outliers(g, ["property_id"], "low", "high", 20.0)


# ---- landing files, batches, later loads -----------------------------------
def csv_quoted_breaks(t: TestStar) -> DataFrame:
    """S1: the events as a quoted CSV with line breaks, commas and quotes in a
    column, written and read back by many tasks per file."""
    from hearth.session import scratch_path
    from hearth.sources.files import read_csv
    e = t.raw("events").select(
        F.col("event_id").cast("string").alias("id"), "event_type",
        F.concat("props", F.lit('\n"'), "event_type", F.lit('",\n\n'), F.col("event_id").cast("string")).alias("note"))
    path = scratch_path(t.spark, f"csv-{uuid.uuid4().hex}")
    e.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return read_csv(t.spark, path, glob="*.csv", ordinal=None, missing=None)


def csv_headers(t: TestStar) -> DataFrame:
    """S2, I1: files of one folder whose headers differ in order, case and
    blanks; a column that some lack is NULL there."""
    from hearth.session import scratch_path
    from hearth.sources.files import read_csv
    o = t.raw("orders")
    key, status, prio = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    path = scratch_path(t.spark, f"csv-{uuid.uuid4().hex}")
    w = lambda df: df.write.mode("append").option("header", True).csv(path)
    w(o.where(key % 2 == 0).select(key.alias("Order Key"), status.alias("order-status"), prio.alias("Priority")))
    w(o.where(key % 2 == 1).select(status.alias("ORDER STATUS"), key.alias(" order  key ")))
    return read_csv(t.spark, path, columns=["order_key", "order_status", "priority"], glob="*.csv",
                    normalize=True, multiline=False, ordinal=None)


_DATE_TEXTS = ["yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss.SSS", "MM/dd/yyyy HH:mm:ss.SSS", "dd-MMM-yy",
               "MMMM d yyyy", "d MMMM yyyy", "yyyy.MM.dd", "MMM d, yyyy", "yyyyMMdd", "M/d/yy",
               "yyyy-MM-dd'T'HH:mm:ss'Z'", "'week of' yyyy"]


def parse_date_forms(t: TestStar) -> DataFrame:
    """P5: order dates written in twelve forms (the last is no date) and parsed."""
    o, day = t.raw("orders"), F.col("o_orderdate")
    text = F.element_at(F.array(*[F.date_format(day, f) for f in _DATE_TEXTS]),
                        (F.col("o_orderkey") % len(_DATE_TEXTS)).cast("int") + 1)
    return o.select("o_orderkey", C.parse_date(text).alias("d"))


def append_retried(t: TestStar) -> DataFrame:
    """K-1: the lines appended in two batches, the first of them twice."""
    from hearth.session import scratch_path
    from hearth.sinks import append_batch, read_batches
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    path = scratch_path(t.spark, f"batches-{uuid.uuid4().hex}")
    for batch in (0, 1, 0):
        append_batch(li.where(F.col("l_orderkey") % 2 == batch), path, f"load/{batch}")
    return read_batches(t.spark, path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))


def keys_second_load(t: TestStar) -> DataFrame:
    """K1: a second load that adds the suppliers' addresses to the customers'
    keeps the ids of the first and numbers the new ones after them."""
    from hearth.operators.changes import stable_keys
    from hearth.operators.keys import dense_keys
    c = t.raw("customer").select(F.col("c_name").alias("address"), F.col("c_nationkey").alias("zip"))
    first = stage(dense_keys(c, ["zip", "address"], key="property_id"), "first_load")
    s = t.raw("supplier").select(F.col("s_name").alias("address"), F.col("s_nationkey").alias("zip"))
    return stable_keys(c.unionByName(s), first, ["zip", "address"], key="property_id")


def changes_applied(t: TestStar) -> DataFrame:
    """P22 on update: every line is a reassessment of its order's sale; the
    newest one counts and the flag follows it."""
    from hearth.functions import expr as X
    from hearth.operators.changes import apply_changes
    base = t.sales_transaction.select("transaction_id", "sale_price", "assessed_value_at_sale", "sold_below_assessment")
    changes = t.raw("lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), "l_shipdate", "l_linenumber",
        F.col("l_extendedprice").cast(S.MONEY).alias("assessed_value_at_sale"))
    return apply_changes(base, changes, ["transaction_id"], ["l_shipdate", "l_linenumber"], {
        "sold_below_assessment": X.sold_below_assessment("sale_price", "assessed_value_at_sale")})


# ---- sketches kept per load, co-located tables -------------------------------
def sketches_two_loads(t: TestStar) -> DataFrame:
    """A5, A6: sketches of two loads of lines, stored, merged and compared with
    the exact figures of all lines."""
    from hearth.operators import sketches as K
    by = ["l_returnflag", "l_linestatus"]
    li = t.raw("lineitem")
    loads = [stage(K.sketch(li.where(F.col("l_orderkey") % 2 == i), by, {"parts": "l_partkey"},
                            {"price": "l_extendedprice"}), f"load{i}") for i in (0, 1)]
    est = stage(K.estimate(K.merge(loads[0].unionByName(loads[1]), by), by, median=["price"]), "estimates")
    exact = li.join(F.broadcast(est.select(*by, "price_median")), by).groupBy(*by).agg(
        F.count_distinct("l_partkey").alias("n"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("l_extendedprice") <= F.col("price_median")).alias("below"))
    ok = F.abs(F.col("parts_distinct") - F.col("n")) <= 3 * K.DISTINCT_ERROR * F.col("n") + 1
    rank = F.abs(F.col("below") / F.col("rows") - 0.5) <= 2 * K.RANK_ERROR + 1 / F.col("rows")
    return est.join(exact, by).select(*by, F.col("price_n").alias("rows"), ok.alias("distinct_within"),
                                      rank.alias("median_within"))


def _colocated(t: TestStar):
    from hearth.plans.colocate import colocated_star, write_colocated
    from hearth.session import scratch_path
    root = scratch_path(t.spark, f"colocated-{uuid.uuid4().hex}")
    write_colocated(t, root, tables=["property", "sales_transaction", "price_history"])
    return colocated_star(t.spark, t, root)


def avg_price_by_borough_colocated(t: TestStar) -> DataFrame:
    from hearth.plans import reports as R
    return R.avg_price_by_borough(_colocated(t))


def price_by_type_colocated(t: TestStar) -> DataFrame:
    from hearth.plans import reports as R
    return R.price_by_type(_colocated(t))


def price_gain_colocated(t: TestStar) -> DataFrame:
    from hearth.plans import reports as R
    return R.price_gain(_colocated(t))


OPS = {
    "ingest_city_sales": ingest_city_sales,
    "ingest_state_sales": ingest_state_sales,
    "keep_first_by_key": keep_first_by_key,
    "surrogate_keys": surrogate_keys,
    "sales_key_resolution": sales_key_resolution,
    "price_history": price_history,
    "sales_key_resolution_parity": sales_key_resolution_parity,
    "state_key_resolution_parity": state_key_resolution_parity,
    "ingest_municipalities": ingest_municipalities,
    "assessment_history": assessment_history,
    "union_regions": union_regions,
    "ingest_incidents": ingest_incidents,
    "ingest_requests_311": ingest_requests_311,
    "ingest_home_values": ingest_home_values,
    "ingest_schools": ingest_schools,
    "school_quarantine": school_quarantine,
    "property_school_links": property_school_links,
    "semi_known_zips": semi_known_zips,
    "anti_orphans": anti_orphans,
    "distinct_on": distinct_on_lines,
    "exact_median": exact_median,
    "clean_int": clean_int,
    "clean_price": clean_price,
    "clean_zip": clean_zip,
    "parse_dates_coerce": parse_dates_coerce,
    "parse_numbers_coerce": parse_numbers_coerce,
    "sold_below_flag": sold_below_flag,
    "price_per_sqft": price_per_sqft,
    "dq_pk": dq_pk,
    "dq_not_null": dq_not_null,
    "dq_fk": dq_fk,
    "dq_length": dq_length,
    "dq_decimal": dq_decimal,
    "dq_duplicates": dq_duplicates,
    "dq_defaults": dq_defaults,
    "dq_rejects": dq_rejects,
    "dq_outliers": dq_outliers,
    "dq_unique_month": dq_unique_month,
    "dq_duplicate_days": dq_duplicate_days,
    "dq_defaults_partial": dq_defaults_partial,
    "dq_overflow": dq_overflow,
    "dq_reject_report": dq_reject_report,
    "json_array_records": json_array_records,
    "csv_quoted_breaks": csv_quoted_breaks,
    "csv_headers": csv_headers,
    "parse_date_forms": parse_date_forms,
    "append_retried": append_retried,
    "keys_second_load": keys_second_load,
    "changes_applied": changes_applied,
    "sketches_two_loads": sketches_two_loads,
    "avg_price_by_borough_colocated": avg_price_by_borough_colocated,
    "price_by_type_colocated": price_by_type_colocated,
    "price_gain_colocated": price_gain_colocated,
}
