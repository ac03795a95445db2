"""Declared types of the star model and of the raw source files.

Raw files are read with every column as STRING; typing is the cleaners' job,
so a bad cell becomes NULL instead of failing the scan or being guessed by
schema inference.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
D = T.DateType()
B = T.BooleanType()
MONEY = T.DecimalType(15, 2)
PPSF = T.DecimalType(10, 2)
RATIO = T.DecimalType(8, 4)
RATE = T.DecimalType(5, 3)
PCT = T.DecimalType(5, 2)
GEO = T.DecimalType(10, 6)


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Table and column names and types of the star, which must equal
# the reference's.
BOROUGH = _st(("borough_id", I), ("borough_name", S), ("state", S))
NEIGHBORHOOD = _st(("zip_code", S), ("neighborhood_name", S), ("borough_id", I))
MUNICIPALITY = _st(("municipality_id", I), ("town_name", S), ("state", S))
PROPERTY = _st(
    ("property_id", L), ("address", S), ("zip_code", S), ("municipality_id", I),
    ("borough_id", I), ("property_type", S), ("building_class", S),
    ("gross_sqft", I), ("land_sqft", I), ("year_built", I),
    ("residential_units", I), ("region", S))
SALES_TRANSACTION = _st(
    ("transaction_id", L), ("property_id", L), ("sale_price", MONEY),
    ("sale_date", D), ("price_per_sqft", PPSF), ("assessed_value_at_sale", MONEY),
    ("sold_below_assessment", B))
PRICE_HISTORY = _st(
    ("history_id", L), ("property_id", L), ("sale_price", MONEY),
    ("sale_date", D), ("source_year", I))
ASSESSMENT_HISTORY = _st(
    ("assessment_id", L), ("property_id", L), ("assessed_value", MONEY),
    ("sale_price", MONEY), ("sales_ratio", RATIO), ("assessment_year", I),
    ("region", S))
DEED_MORTGAGE_RECORD = _st(
    ("doc_id", S), ("property_id", L), ("doc_type", S), ("doc_date", D),
    ("doc_amount", MONEY), ("borough_id", I))
HOUSING_VIOLATION = _st(
    ("violation_id", S), ("zip_code", S), ("borough_id", I), ("house_number", S),
    ("street_name", S), ("violation_class", S), ("inspection_date", D),
    ("current_status", S), ("violation_status", S), ("description", S),
    ("latitude", GEO), ("longitude", GEO))
SERVICE_REQUEST_311 = _st(
    ("request_id", S), ("created_date", T.TimestampNTZType()),
    ("complaint_type", S), ("descriptor", S), ("zip_code", S), ("borough_id", I),
    ("status", S), ("latitude", GEO), ("longitude", GEO))
NEIGHBORHOOD_MARKET_STAT = _st(
    ("stat_id", L), ("zip_code", S), ("stat_month", D), ("median_home_value", MONEY))
SCHOOL_DISTRICT = _st(("district_id", I), ("borough_id", I))
SCHOOL = _st(
    ("dbn", S), ("school_name", S), ("school_type", S), ("district_id", I),
    ("attendance_rate", RATE), ("chronic_absent", RATE))
PROPERTY_SCHOOL = _st(("property_id", L), ("dbn", S))
NEIGHBORHOOD_QUALITY_SCORE = _st(
    ("score_id", L), ("zip_code", S), ("score_month", D), ("violation_count", I),
    ("complaint_count", I), ("avg_school_attendance", RATE),
    ("median_sale_price", MONEY), ("pct_sold_below_assessment", PCT),
    ("quality_score", PCT))

STAR = {
    "borough": BOROUGH,
    "neighborhood": NEIGHBORHOOD,
    "municipality": MUNICIPALITY,
    "property": PROPERTY,
    "sales_transaction": SALES_TRANSACTION,
    "price_history": PRICE_HISTORY,
    "assessment_history": ASSESSMENT_HISTORY,
    "deed_mortgage_record": DEED_MORTGAGE_RECORD,
    "housing_violation": HOUSING_VIOLATION,
    "service_request_311": SERVICE_REQUEST_311,
    "neighborhood_market_stat": NEIGHBORHOOD_MARKET_STAT,
    "school_district": SCHOOL_DISTRICT,
    "school": SCHOOL,
    "property_school": PROPERTY_SCHOOL,
    "neighborhood_quality_score": NEIGHBORHOOD_QUALITY_SCORE,
}

# Declared keys, NOT NULL columns and references of the star
# (DDL constraints re-aimed as data-quality jobs).
PRIMARY_KEYS = {
    "borough": ["borough_id"],
    "neighborhood": ["zip_code"],
    "municipality": ["municipality_id"],
    "property": ["property_id"],
    "sales_transaction": ["transaction_id"],
    "price_history": ["history_id"],
    "assessment_history": ["assessment_id"],
    "deed_mortgage_record": ["doc_id"],
    "housing_violation": ["violation_id"],
    "service_request_311": ["request_id"],
    "neighborhood_market_stat": ["stat_id"],
    "school_district": ["district_id"],
    "school": ["dbn"],
    "property_school": ["property_id", "dbn"],
    "neighborhood_quality_score": ["score_id"],
}
UNIQUE_KEYS = {
    "borough": [["borough_name"]],
    "municipality": [["town_name", "state"]],
}
NOT_NULL = {
    "borough": ["borough_name", "state"],
    "municipality": ["town_name"],
}
# (child table, child column) -> (parent table, parent column)
FOREIGN_KEYS = [
    ("neighborhood", "borough_id", "borough", "borough_id"),
    ("property", "zip_code", "neighborhood", "zip_code"),
    ("property", "municipality_id", "municipality", "municipality_id"),
    ("property", "borough_id", "borough", "borough_id"),
    ("sales_transaction", "property_id", "property", "property_id"),
    ("price_history", "property_id", "property", "property_id"),
    ("assessment_history", "property_id", "property", "property_id"),
    ("deed_mortgage_record", "property_id", "property", "property_id"),
    ("deed_mortgage_record", "borough_id", "borough", "borough_id"),
    ("housing_violation", "borough_id", "borough", "borough_id"),
    ("service_request_311", "borough_id", "borough", "borough_id"),
    ("neighborhood_market_stat", "zip_code", "neighborhood", "zip_code"),
    ("school_district", "borough_id", "borough", "borough_id"),
    ("school", "district_id", "school_district", "district_id"),
    ("property_school", "property_id", "property", "property_id"),
    ("property_school", "dbn", "school", "dbn"),
    ("neighborhood_quality_score", "zip_code", "neighborhood", "zip_code"),
]
# VARCHAR(n) / CHAR(n) limits of the DDL, per table and column.
MAX_LENGTH = {
    "borough": {"borough_name": 50, "state": 5},
    "neighborhood": {"zip_code": 10, "neighborhood_name": 100},
    "municipality": {"town_name": 100, "state": 5},
    "property": {"address": 200, "zip_code": 10, "property_type": 50,
                 "building_class": 100, "region": 5},
    "assessment_history": {"region": 5},
    "deed_mortgage_record": {"doc_id": 30, "doc_type": 20},
    "housing_violation": {"violation_id": 20, "zip_code": 10, "house_number": 20,
                          "street_name": 100, "violation_class": 1,
                          "current_status": 50, "violation_status": 20},
    "service_request_311": {"request_id": 20, "complaint_type": 100,
                            "descriptor": 200, "zip_code": 10, "status": 50},
    "neighborhood_market_stat": {"zip_code": 10},
    "school": {"dbn": 10, "school_name": 200, "school_type": 50},
    "property_school": {"dbn": 10},
    "neighborhood_quality_score": {"zip_code": 10},
}
# Column defaults of the DDL.
DEFAULTS = {
    "municipality": {"state": "CT"},
    "sales_transaction": {"sold_below_assessment": False},
    "neighborhood_quality_score": {"violation_count": 0, "complaint_count": 0},
}

# Raw feeds, the columns each ingest job consumes, all read as STRING.
RAW_CITY_SALES = [
    "borough", "neighborhood", "building_class_category", "address", "zip_code",
    "residential_units", "land_square_feet", "gross_square_feet", "year_built",
    "sale_price", "sale_date"]
RAW_STATE_SALES = [
    "town", "address", "saleamount", "assessedvalue", "daterecorded",
    "salesratio", "propertytype"]
RAW_VIOLATIONS = [
    "violationid", "zip", "boro", "housenumber", "streetname", "class",
    "inspectiondate", "currentstatus", "violationstatus", "novdescription",
    "latitude", "longitude"]
RAW_311 = [
    "unique_key", "created_date", "complaint_type", "descriptor", "incident_zip",
    "borough", "status", "latitude", "longitude"]
RAW_SCHOOL_METRICS = [
    "dbn", "school_name", "school_type", "metric_variable_name", "metric_value"]


def string_schema(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, S, True) for c in cols])
