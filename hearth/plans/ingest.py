"""Ingest jobs: raw all-STRING feeds -> typed, conformed star tables.

Each job is a lazy plan of native expressions (the cleaners in
``hearth.functions.clean``); raw feeds carry an ingest ordinal ``_ord``
(file position) used wherever the reference keeps "the first" row.

Keys: the reference numbers rows with SERIAL in insertion order and reads
them back; here ids are dense numbers in natural-key order, assigned once in
the cluster (``operators.keys.dense_keys``).

Properties: the reference writes one property row per sale row and re-joins
sales on (address, zip) / address alone, which yields k x k sales for k
sales of one address. ``mode="dedup"`` (default) makes property unique per
natural key so each sale resolves to one id; the reference's fan-out is
reported by ``operators.joins.fanout_counts`` instead of being written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import schemas as S
from hearth.functions import clean as C
from hearth.functions import expr as X
from hearth.operators import joins as J
from hearth.operators.blocks import stage
from hearth.operators.dedup import keep_first
from hearth.operators.keys import dense_keys
from hearth.operators.partitioning import keep_valid, spread_small_input
from hearth.operators.reshape import first_metrics, melt, month_columns
from hearth.sources import literal

MIN_PRICE = 50000


# E4: city sales ------------------------------------------------------------
def clean_city_sales(raw: DataFrame, min_price: float = MIN_PRICE) -> DataFrame:
    """Typed city sales that pass the quality filter (price, type, zip, date)."""
    raw = spread_small_input(raw)
    price = C.clean_price("sale_price")
    zip_c = C.clean_zip("zip_code")
    ptype = C.building_type("building_class_category")
    date = C.parse_date("sale_date")
    gross = C.clean_int("gross_square_feet")
    typed = raw.select(
        "_ord", "address", "neighborhood",
        zip_c.alias("zip_code"),
        C.borough_from_digit("borough").alias("borough_name"),
        ptype.alias("property_type"),
        F.col("building_class_category").alias("building_class"),
        gross.alias("gross_sqft"),
        C.clean_int("land_square_feet").alias("land_sqft"),
        C.clean_int("year_built").alias("year_built"),
        C.clean_int("residential_units").alias("residential_units"),
        price.alias("sale_price"),
        date.alias("sale_date"),
        X.price_per_sqft(price.try_cast(S.MONEY), gross).alias("price_per_sqft"))
    return keep_valid(typed, F.col("sale_price").isNotNull()
                      & (F.col("sale_price") > min_price)
                      & F.col("property_type").isNotNull() & F.col("zip_code").isNotNull()
                      & F.col("sale_date").isNotNull())


def city_rejects(raw: DataFrame, min_price: float = MIN_PRICE) -> DataFrame:
    """Quarantine counts of the city filter, by reason (V10)."""
    from hearth.operators.quality import rejects
    price = C.clean_price("sale_price")
    return rejects(raw, {
        "price_missing": price.isNull(),
        "price_not_above_min": price.isNotNull() & (price <= min_price),
        "type_unmapped": C.building_type("building_class_category").isNull(),
        "zip_invalid": C.clean_zip("zip_code").isNull(),
        "date_invalid": C.parse_date("sale_date").isNull(),
    })


def reject_reasons(feed: str, min_price: float = MIN_PRICE) -> dict[str, Column]:
    """Why a raw row of ``feed`` does not reach its table; a row may have
    several reasons. A sale without an address has no natural key, so no
    property: it is counted here and not written."""
    if feed == "city_sales":
        price = C.clean_price("sale_price")
        return {"price_missing": price.isNull(),
                "price_not_above_min": price <= min_price,
                "type_unmapped": C.building_type("building_class_category").isNull(),
                "zip_invalid": C.clean_zip("zip_code").isNull(),
                "date_invalid": C.parse_date("sale_date").isNull(),
                "address_missing": F.col("address").isNull()}
    if feed == "state_sales":
        price = C.parse_number("saleamount")
        return {"price_missing": price.isNull(),
                "price_not_above_min": price <= min_price,
                "type_unmapped": C.state_use_type("propertytype").isNull(),
                "date_invalid": C.parse_date("daterecorded").isNull(),
                "address_missing": F.col("address").isNull(),
                "town_missing": F.col("town").isNull()}
    if feed == "violations":
        return {"id_missing": F.col("violationid").isNull(),
                "date_invalid": C.parse_date("inspectiondate").isNull()}
    return {}


# Keys of the feeds whose rows are loaded without one, too; reported only.
NOTED_KEYS = {"requests_311": "unique_key", "home_values": "RegionName", "school_metrics": "dbn"}


def reject_report(feeds: dict[str, DataFrame]) -> DataFrame:
    """V10 for a whole load: (feed, reason, rows), one pass per feed. The
    reasons ``read``, ``accepted`` and ``rejected`` count rows, so that
    accepted + rejected = read; the others count rows per reason. A feed with
    a ``_corrupt`` column also reports its malformed records."""
    parts = []
    for feed, raw in feeds.items():
        why = {k: F.coalesce(c, F.lit(False)) for k, c in reject_reasons(feed).items()}
        if "_corrupt" in raw.columns:
            why["malformed"] = F.col("_corrupt").isNotNull()
        bad = reduce(lambda a, b: a | b, why.values(), F.lit(False))
        counts = {"read": F.lit(True), "accepted": ~bad, "rejected": bad, **why}
        if feed in NOTED_KEYS:
            counts["key_missing"] = F.col(NOTED_KEYS[feed]).isNull()
        row = raw.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
        stack = ", ".join(f"'{k}', `{k}`" for k in counts)
        parts.append(row.selectExpr(f"'{feed}' as feed", f"stack({len(counts)}, {stack}) as (reason, rows)"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def neighborhoods(city: DataFrame, borough: DataFrame) -> DataFrame:
    """One row per zip: first neighbourhood/borough seen in file order."""
    first = keep_first(city.select("zip_code", "neighborhood", "borough_name", "_ord"),
                       ["zip_code"], "_ord")
    return (J.lookup(first, borough, "borough_name", "borough_name", ["borough_id"],
                     literal_rows=len(literal.BOROUGHS))
            .select("zip_code", F.col("neighborhood").alias("neighborhood_name"),
                    F.col("borough_id").cast("int")))


PROPERTY_ORDER = ["_feed", "address", "zip_code", "town"]


def city_property_rows(city: DataFrame, borough: DataFrame) -> DataFrame:
    """NY property rows unique per (address, zip), attributes of the first sale."""
    first = keep_first(city.where(F.col("address").isNotNull()),
                       ["address", "zip_code"], "_ord")
    return (J.lookup(first, borough, "borough_name", "borough_name", ["borough_id"],
                     literal_rows=len(literal.BOROUGHS))
            .select("address", "zip_code", F.lit(None).cast("string").alias("town"),
                    F.lit(None).cast("int").alias("municipality_id"),
                    F.col("borough_id").cast("int"), "property_type", "building_class",
                    "gross_sqft", "land_sqft", "year_built", "residential_units",
                    F.lit("NY").alias("region")))


def key_properties(*regional_rows: DataFrame) -> DataFrame:
    """Property ids 1..n over the regional feeds: feed order, then natural key.

    Ids are assigned once over the union, so the regions never collide (the
    reference's SERIAL continues from one feed to the next the same way).
    """
    u = None
    for i, rows in enumerate(regional_rows):
        r = rows.withColumn("_feed", F.lit(i))
        u = r if u is None else u.unionByName(r)
    return dense_keys(u, PROPERTY_ORDER, key="property_id").drop("_feed")


def city_properties(city: DataFrame, borough: DataFrame) -> DataFrame:
    """NY properties with ids (city feed alone)."""
    return key_properties(city_property_rows(city, borough)).drop("town")


def city_sales(city: DataFrame, props: DataFrame) -> DataFrame:
    """Sales with property ids (dedup mode); NULL assessed, so flag FALSE."""
    s = J.resolve_keys(city, props, ["address", "zip_code"])
    price = F.col("sale_price").try_cast(S.MONEY)
    assessed = F.lit(None).cast(S.MONEY)
    return s.select("_ord", "property_id",
                    price.alias("sale_price"), "sale_date", "price_per_sqft",
                    assessed.alias("assessed_value_at_sale"),
                    X.sold_below_assessment(price, assessed).alias("sold_below_assessment"))


def number_sales(ny: DataFrame, ct: DataFrame | None = None, keep_feed: bool = False) -> DataFrame:
    """Transaction ids 1..n: city sales first, then state sales, each in file
    order (the order the reference inserts them). ``keep_feed`` keeps
    ``_feed``: 0 for city, 1 for state."""
    cols = [f.name for f in S.SALES_TRANSACTION.fields if f.name != "transaction_id"]
    both = ny.select(F.lit(0).alias("_feed"), "_ord", *cols)
    if ct is not None:
        both = both.unionByName(ct.select(F.lit(1).alias("_feed"), "_ord", *cols,
                                          *[c for c in ct.columns if c == "sales_ratio"]),
                                allowMissingColumns=True)
    return dense_keys(both, ["_feed", "_ord"], key="transaction_id").drop("_ord", *([] if keep_feed else ["_feed"]))


def price_history(sales: DataFrame) -> DataFrame:
    return sales.select(F.col("transaction_id").alias("history_id"), "property_id",
                        "sale_price", "sale_date",
                        F.year("sale_date").alias("source_year"))


# E5: state sales -----------------------------------------------------------
def clean_state_sales(raw: DataFrame, min_price: float = MIN_PRICE) -> DataFrame:
    """Typed state sales: price above minimum, date and use type present."""
    raw = spread_small_input(raw)
    price = C.parse_number("saleamount")
    assessed = C.parse_number("assessedvalue")
    typed = raw.select(
        "_ord", "town", "address",
        price.alias("sale_price"), assessed.alias("assessed_value"),
        C.parse_date("daterecorded").alias("sale_date"),
        C.parse_number("salesratio").alias("sales_ratio"),
        C.state_use_type("propertytype").alias("property_type"))
    return keep_valid(typed, (F.col("sale_price") > min_price)
                      & F.col("sale_date").isNotNull() & F.col("property_type").isNotNull())


def municipalities(state: DataFrame, code: str = "CT") -> DataFrame:
    """Distinct towns with dense ids by name; state defaults to ``code``."""
    towns = state.select(F.col("town").alias("town_name")).where(
        F.col("town_name").isNotNull()).distinct()
    return (dense_keys(towns, ["town_name"], key="municipality_id")
            .select(F.col("municipality_id").cast("int"), "town_name",
                    F.lit(code).alias("state")))


def state_property_rows(state: DataFrame, towns: DataFrame,
                        ct_borough_id: int = 6) -> DataFrame:
    """CT property rows unique per (address, town), attributes of the first sale."""
    first = keep_first(state.where(F.col("address").isNotNull()), ["address", "town"], "_ord")
    return (first.join(towns.select(F.col("town_name").alias("town"), "municipality_id"),
                       "town", "left")
            .select("address", F.lit(None).cast("string").alias("zip_code"), "town",
                    "municipality_id", F.lit(ct_borough_id).cast("int").alias("borough_id"),
                    "property_type", F.lit(None).cast("string").alias("building_class"),
                    *[F.lit(None).cast("int").alias(c) for c in
                      ("gross_sqft", "land_sqft", "year_built", "residential_units")],
                    F.lit("CT").alias("region")))


def state_properties(state: DataFrame, towns: DataFrame, ct_borough_id: int = 6) -> DataFrame:
    """CT properties with ids (state feed alone); keeps ``town`` for resolution."""
    return key_properties(state_property_rows(state, towns, ct_borough_id))


def state_sales(state: DataFrame, props: DataFrame) -> DataFrame:
    s = J.resolve_keys(state, props, ["address", "town"])
    price = F.col("sale_price").try_cast(S.MONEY)
    assessed = F.col("assessed_value").try_cast(S.MONEY)
    return s.select("_ord", "property_id",
                    price.alias("sale_price"), "sale_date",
                    F.lit(None).cast(S.PPSF).alias("price_per_sqft"),
                    assessed.alias("assessed_value_at_sale"),
                    X.sold_below_assessment(price, assessed).alias("sold_below_assessment"),
                    "sales_ratio")


def assessment_history(sales: DataFrame) -> DataFrame:
    return (sales.where(F.col("assessed_value_at_sale").isNotNull())
            .select(F.col("transaction_id").alias("assessment_id"), "property_id",
                    F.col("assessed_value_at_sale").alias("assessed_value"), "sale_price",
                    F.col("sales_ratio").try_cast(S.RATIO).alias("sales_ratio"),
                    F.year("sale_date").alias("assessment_year"),
                    F.lit("CT").alias("region")))


def union_regions(ny_rows: DataFrame, ct_rows: DataFrame) -> DataFrame:
    """Both regional property feeds in one conformed, keyed table."""
    cols = [f.name for f in S.PROPERTY.fields]
    return key_properties(ny_rows, ct_rows).select(*cols)


# E6: violations and 311 ----------------------------------------------------
def _geo(c: str):
    return C.parse_number(c).try_cast(S.GEO)


def _borough_id(df: DataFrame, col: str, borough: DataFrame) -> DataFrame:
    key = F.upper(C.strip_ws(F.col(col)))
    b = borough.select(F.col("borough_name").alias("_bn"), F.col("borough_id").alias("_bid"))
    return df.join(b, key == F.col("_bn"), "left")


def housing_violations(raw: DataFrame, borough: DataFrame) -> DataFrame:
    """Violations with a parsed inspection date and id (others dropped)."""
    j = _borough_id(spread_small_input(raw), "boro", borough)
    out = j.select(
        F.col("violationid").cast("string").alias("violation_id"),
        C.clean_zip("zip").alias("zip_code"),
        F.col("_bid").cast("int").alias("borough_id"),
        F.col("housenumber").alias("house_number"),
        F.col("streetname").alias("street_name"),
        F.col("class").alias("violation_class"),
        C.parse_date("inspectiondate").alias("inspection_date"),
        F.col("currentstatus").alias("current_status"),
        F.col("violationstatus").alias("violation_status"),
        F.col("novdescription").alias("description"),
        _geo("latitude").alias("latitude"), _geo("longitude").alias("longitude"))
    return keep_valid(out, F.col("violation_id").isNotNull()
                      & F.col("inspection_date").isNotNull())


def service_requests(raw: DataFrame, borough: DataFrame) -> DataFrame:
    j = _borough_id(spread_small_input(raw), "borough", borough)
    return j.select(
        F.col("unique_key").cast("string").alias("request_id"),
        C.parse_timestamp("created_date").alias("created_date"),
        "complaint_type", "descriptor",
        C.clean_zip("incident_zip").alias("zip_code"),
        F.col("_bid").cast("int").alias("borough_id"),
        "status", _geo("latitude").alias("latitude"), _geo("longitude").alias("longitude"))


# E7: home values -----------------------------------------------------------
def home_values(wide: DataFrame, neighborhood: DataFrame, state: str = "NY",
                prefix: str = "20", minimum: str = "2020") -> DataFrame:
    """Wide monthly values -> (zip, month, value) for zips of the dimension."""
    months = month_columns(wide.columns, prefix, minimum)
    z = (wide.where(F.col("StateName") == state)
         .withColumn("zip_code", C.zero_fill("RegionName")))
    z = J.semi_known(z, neighborhood, "zip_code")
    long = melt(z, ["zip_code"], months, "stat_month", "median_home_value")
    return (long.select("zip_code",
                        C.parse_date("stat_month").alias("stat_month"),
                        C.parse_number("median_home_value").try_cast(S.MONEY)
                        .alias("median_home_value"))
            .where(F.col("stat_month").isNotNull() & F.col("median_home_value").isNotNull()))


def market_stats(values: DataFrame) -> DataFrame:
    """The market-stat table: ``home_values`` rows with ids in (zip, month) order."""
    return dense_keys(values, ["zip_code", "stat_month"], key="stat_id")


# E8: schools ---------------------------------------------------------------
ATTENDANCE_METRIC = "attendance_k8_all"
ABSENCE_METRIC = "chronic_absent_ems_all"


def schools(metrics: DataFrame) -> DataFrame:
    """One row per school having the attendance metric (first value of each
    metric in file order), with its district parsed from the id prefix."""
    wide = first_metrics(metrics, "dbn", "metric_variable_name", "metric_value", "_ord",
                         ATTENDANCE_METRIC, ABSENCE_METRIC,
                         carry=["school_name", "school_type"],
                         primary_alias="attendance_rate", secondary_alias="chronic_absent")
    return wide.select(
        "dbn", "school_name", "school_type",
        C.district_from_dbn("dbn").alias("district_id"),
        C.parse_number("attendance_rate").try_cast(S.RATE).alias("attendance_rate"),
        C.parse_number("chronic_absent").try_cast(S.RATE).alias("chronic_absent"))


def split_schools(sch: DataFrame, districts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): a district outside the dimension is quarantined."""
    d = districts.select(F.col("district_id").alias("_d"))
    known = sch.join(d, sch.district_id == F.col("_d"), "left")
    ok = F.col("district_id").isNull() | F.col("_d").isNotNull()
    return (known.where(ok).drop("_d"), known.where(~ok).drop("_d"))


# whole load ----------------------------------------------------------------
def build_star(spark: SparkSession, feeds: dict[str, DataFrame], home_min: str = "2020",
               home_prefix: str = "20") -> dict[str, DataFrame]:
    """All star tables from the six raw feeds (lazy; write with sinks.publish_star)."""
    borough = literal.boroughs(spark)
    district = literal.school_districts(spark, borough)
    # Each cleaned feed feeds several tables: clean once, stage, reuse.
    city = stage(clean_city_sales(feeds["city_sales"]), "city_sales")
    nbhd = neighborhoods(city, borough)
    st = stage(clean_state_sales(feeds["state_sales"]), "state_sales")
    towns = municipalities(st)
    ct_id = [i + 1 for i, (n, _) in enumerate(literal.BOROUGHS) if n == "CONNECTICUT"][0]
    props = key_properties(city_property_rows(city, borough),
                           state_property_rows(st, towns, ct_id))
    ny_props = props.where(F.col("region") == "NY")
    ct_props = props.where(F.col("region") == "CT")
    ny_sales = city_sales(city, ny_props)
    ct_sales = state_sales(st, ct_props)
    # Three tables read the numbered sales: rank them once.
    sales = stage(number_sales(ny_sales, ct_sales, keep_feed=True), "sales")
    sales_cols = [f.name for f in S.SALES_TRANSACTION.fields]
    sch, quarantined = split_schools(schools(feeds["school_metrics"]), district)
    return {
        "borough": borough,
        "neighborhood": nbhd,
        "municipality": towns,
        "property": props.select(*[f.name for f in S.PROPERTY.fields]),
        "sales_transaction": sales.select(*sales_cols),
        "price_history": price_history(sales.where(F.col("_feed") == 0)),
        "assessment_history": assessment_history(sales.where(F.col("_feed") == 1)),
        "housing_violation": housing_violations(feeds["violations"], borough),
        "service_request_311": service_requests(feeds["requests_311"], borough),
        "neighborhood_market_stat": market_stats(home_values(
            feeds["home_values"], nbhd, prefix=home_prefix, minimum=home_min)),
        "school_district": district,
        "school": sch,
        "school_quarantine": quarantined,
        "rejected_rows": reject_report(feeds),
    }
