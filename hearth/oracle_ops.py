"""DuckDB oracle SQL for the ingest, operator and data-quality queries.

The raw feeds are rebuilt here in DuckDB syntax (same strings as
``hearth.sources.rawfeeds``) and cleaned with DuckDB's own functions
(``regexp_full_match``, ``TRY_CAST``, ``try_strptime``), so a mismatch
points at a cleaner, not at shared code.
"""

from __future__ import annotations

from hearth.oracle import SCORE_CTES, SCORE_VIEWS, VIEWS, with_views

PC = "CAST(round(o_totalprice * 100) AS BIGINT)"
NUM_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ORD_JOIN = "orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def money(c: str) -> str:
    return f"(CAST(({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def pdouble(x: str) -> str:
    s = strip(x)
    d = f"TRY_CAST({s} AS DOUBLE)"
    return f"(CASE WHEN regexp_full_match({s}, '{NUM_RE}') AND isfinite({d}) THEN {d} END)"


def cint(x: str) -> str:
    d = pdouble(f"replace({x}, ',', '')")
    return f"TRY_CAST(trunc({d}) AS INTEGER)"


def cprice(x: str) -> str:
    d = pdouble(f"regexp_replace({x}, '[$,]', '', 'g')")
    return f"(CASE WHEN {d} > 0 THEN {d} END)"


def czip(x: str) -> str:
    h = f"split_part({strip(x)}, '.', 1)"
    return f"(CASE WHEN regexp_full_match({h}, '^[0-9]{{0,5}}$') THEN lpad({h}, 5, '0') END)"


DATE_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%m/%d/%Y %I:%M:%S %p"]


def pts(x: str) -> str:
    s = strip(x)
    return "COALESCE(" + ", ".join(f"try_strptime({s}, '{f}')" for f in DATE_FORMATS) + ")"


def pdate(x: str) -> str:
    return f"CAST({pts(x)} AS DATE)"


def case_map(x: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {x} {whens} END)"


# Fixed values, written here anew so that a wrong entry of the cleaners' maps
# shows: building class prefix, borough digit, property use, boroughs by id.
CLASS_TYPES = {
    "01": "HOUSE", "02": "HOUSE", "03": "HOUSE", "04": "APARTMENT", "07": "APARTMENT", "09": "CONDO",
    "10": "CONDO", "12": "TOWNHOUSE", "13": "CONDO", "15": "CONDO", "28": "APARTMENT"}
DIGITS = {"1": "MANHATTAN", "2": "BRONX", "3": "BROOKLYN", "4": "QUEENS", "5": "STATEN ISLAND"}
USES = {"Single Family": "HOUSE", "Two Family": "HOUSE", "Three Family": "HOUSE", "Condo": "CONDO",
        "Apartment": "APARTMENT", "Townhouse": "TOWNHOUSE"}
BOROUGH_NAMES = [("MANHATTAN", "NY"), ("BRONX", "NY"), ("BROOKLYN", "NY"), ("QUEENS", "NY"),
                 ("STATEN ISLAND", "NY"), ("CONNECTICUT", "CT")]


def _maps():
    return CLASS_TYPES, DIGITS, USES, BOROUGH_NAMES


def borough_id(name_expr: str) -> str:
    _, _, _, boroughs = _maps()
    whens = " ".join(f"WHEN '{n}' THEN {i + 1}" for i, (n, _) in enumerate(boroughs))
    return f"(CASE {name_expr} {whens} END)"


BORO = """CASE user_id % 6 WHEN 0 THEN 'manhattan' WHEN 1 THEN 'BRONX' WHEN 2 THEN 'Brooklyn'
  WHEN 3 THEN 'QUEENS' WHEN 4 THEN 'staten island' ELSE 'unknown' END"""


def geo(sign: str = "") -> str:
    vc = "CAST(round(value * 100) AS BIGINT)"
    return f"CASE WHEN event_id % 59 = 0 THEN 'n/a' ELSE '{sign}' || {money(vc)} END"


RAW = {
    "raw_city": f"""raw_city AS (
  SELECT o_orderkey AS _ord,
    CASE WHEN o_orderkey % 11 = 0 THEN '9' ELSE CAST(n_regionkey + 1 AS VARCHAR) END AS borough,
    n_name AS neighborhood,
    lpad(CAST(o_custkey % 16 AS VARCHAR), 2, '0') || ' ' || o_orderpriority AS building_class_category,
    c_name AS address,
    CASE WHEN o_orderkey % 13 = 0 THEN CAST(c_nationkey AS VARCHAR) || '.0'
         WHEN o_orderkey % 17 = 0 THEN 'N/A'
         WHEN o_orderkey % 19 = 0 THEN ' ' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || chr(9)
         ELSE lpad(CAST(c_nationkey AS VARCHAR), 5, '0') END AS zip_code,
    CASE WHEN o_orderkey % 23 = 0 THEN '2.7' ELSE CAST(o_custkey % 4 + 1 AS VARCHAR) END AS residential_units,
    format('{{:,}}', o_custkey * 7) AS land_square_feet,
    CASE WHEN o_orderkey % 29 = 0 THEN '0' WHEN o_orderkey % 31 = 0 THEN '-'
         ELSE format('{{:,}}', CAST(floor(o_totalprice / 100) AS BIGINT)) END AS gross_square_feet,
    CAST(1900 + o_custkey % 120 AS VARCHAR) AS year_built,
    CASE WHEN o_orderkey % 7 = 0 THEN '0' WHEN o_orderkey % 41 = 0 THEN 'n/a'
         ELSE '$' || format('{{:,}}', {PC} // 100) || '.' || lpad(CAST({PC} % 100 AS VARCHAR), 2, '0')
    END AS sale_price,
    CASE WHEN o_orderkey % 37 = 0 THEN 'not a date'
         WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
         ELSE strftime(o_orderdate, '%m/%d/%Y') END AS sale_date
  FROM {ORD_JOIN})""",
    "raw_state": f"""raw_state AS (
  SELECT o_orderkey AS _ord, n_name AS town,
    o_orderpriority || ' ' || c_mktsegment AS address,
    CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 'NaN'
         ELSE {money(PC)} END AS saleamount,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL
         ELSE {money(f'({PC} * (80 + o_orderkey % 40)) // 100')} END AS assessedvalue,
    CASE WHEN o_orderkey % 29 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS daterecorded,
    {money('(80 + o_orderkey % 40)')} AS salesratio,
    CASE o_orderkey % 8 WHEN 0 THEN 'Single Family' WHEN 1 THEN 'Two Family'
         WHEN 2 THEN 'Three Family' WHEN 3 THEN 'Condo' WHEN 4 THEN 'Apartment'
         WHEN 5 THEN 'Townhouse' WHEN 6 THEN 'Commercial' ELSE 'Vacant Land' END AS propertytype
  FROM {ORD_JOIN})""",
    "raw_viol": f"""raw_viol AS (
  SELECT event_id AS _ord,
    CASE WHEN event_id % 53 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS violationid,
    CASE WHEN event_id % 5 = 0 THEN CAST(user_id % 30 AS VARCHAR) || '.0'
         ELSE lpad(CAST(user_id % 30 AS VARCHAR), 5, '0') END AS zip,
    {BORO} AS boro,
    CAST(user_id AS VARCHAR) AS housenumber,
    'STREET ' || CAST(user_id % 50 AS VARCHAR) AS streetname,
    substr('ABC', CAST(event_id % 3 AS INTEGER) + 1, 1) AS class,
    CASE WHEN event_id % 47 = 0 THEN 'N/A' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS inspectiondate,
    CASE WHEN event_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSE' END AS currentstatus,
    CASE WHEN event_id % 4 < 2 THEN 'OPEN' ELSE 'CLOSE' END AS violationstatus,
    props AS novdescription,
    {geo()} AS latitude,
    {geo('-')} AS longitude
  FROM events WHERE event_type = 'error')""",
    "raw_311": f"""raw_311 AS (
  SELECT event_id AS _ord, CAST(event_id AS VARCHAR) AS unique_key,
    CASE WHEN event_id % 61 = 0 THEN 'bad' ELSE strftime(ts, '%m/%d/%Y %I:%M:%S %p') END AS created_date,
    upper(event_type) AS complaint_type,
    event_type || ' report' AS descriptor,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE lpad(CAST(user_id % 30 AS VARCHAR), 5, '0') END AS incident_zip,
    {BORO} AS borough,
    CASE WHEN event_id % 3 = 0 THEN 'Closed' ELSE 'Open' END AS status,
    {geo()} AS latitude,
    {geo('-')} AS longitude
  FROM events WHERE event_type <> 'error')""",
    "raw_home": f"""raw_home AS (
  SELECT CAST(s_suppkey % 30 AS VARCHAR) AS RegionName,
    CASE WHEN n_regionkey = 4 THEN 'CT' ELSE 'NY' END AS StateName,
    strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month,
    {money('(2 * SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) + COUNT(*)) // (2 * COUNT(*))')} AS value
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  GROUP BY 1, 2, 3)""",
    "raw_sch": """raw_sch AS (
  SELECT event_id AS _ord,
    CASE WHEN user_id % 37 = 0 THEN 'AB' || 'X' || CAST(user_id AS VARCHAR)
         ELSE lpad(CAST(user_id % 40 AS VARCHAR), 2, '0') || 'X' || CAST(user_id AS VARCHAR) END AS dbn,
    'School ' || CAST(user_id AS VARCHAR) || ' ' || event_type AS school_name,
    CASE event_id % 3 WHEN 0 THEN 'Elementary' WHEN 1 THEN 'Middle' ELSE 'K-8' END AS school_type,
    CASE event_type WHEN 'view' THEN 'attendance_k8_all'
         WHEN 'click' THEN 'chronic_absent_ems_all' ELSE event_type END AS metric_variable_name,
    CASE WHEN event_id % 41 = 0 THEN 'N/A'
         ELSE '0.' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END AS metric_value
  FROM events)""",
}


def _city_clean() -> str:
    bct, bdig, _, _ = _maps()
    ptype = case_map(strip("substr(building_class_category, 1, 2)"), bct)
    bname = case_map(strip("borough"), bdig)
    price = cprice("sale_price")
    gross = cint("gross_square_feet")
    return f"""city_typed AS (
  SELECT _ord, address, neighborhood, {czip('zip_code')} AS zip_code,
    {bname} AS borough_name, {ptype} AS property_type,
    building_class_category AS building_class,
    {gross} AS gross_sqft, {cint('land_square_feet')} AS land_sqft,
    {cint('year_built')} AS year_built, {cint('residential_units')} AS residential_units,
    {price} AS sale_price, {pdate('sale_date')} AS sale_date
  FROM raw_city),
city AS (
  SELECT *, CASE WHEN gross_sqft > 0
                 THEN ((2 * CAST(round(sale_price * 100) AS BIGINT) + gross_sqft) // (2 * gross_sqft)) / 100.0
            END AS price_per_sqft
  FROM city_typed
  WHERE sale_price IS NOT NULL AND sale_price > 50000 AND property_type IS NOT NULL
    AND zip_code IS NOT NULL AND sale_date IS NOT NULL)"""


def _state_clean() -> str:
    _, _, use, _ = _maps()
    return f"""state_typed AS (
  SELECT _ord, town, address, {pdouble('saleamount')} AS sale_price,
    {pdouble('assessedvalue')} AS assessed_value, {pdate('daterecorded')} AS sale_date,
    {pdouble('salesratio')} AS sales_ratio, {case_map('propertytype', use)} AS property_type
  FROM raw_state),
state AS (
  SELECT * FROM state_typed
  WHERE sale_price > 50000 AND sale_date IS NOT NULL AND property_type IS NOT NULL)"""


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CITY = (RAW["raw_city"], _city_clean())
STATE = (RAW["raw_state"], _state_clean())

NY_ROWS = """ny_rows AS (
  SELECT DISTINCT ON (address, zip_code) *
  FROM city WHERE address IS NOT NULL
  ORDER BY address, zip_code, _ord)"""
NY_PROPS = f"""ny_props AS (
  SELECT row_number() OVER (ORDER BY address, zip_code) AS property_id,
         address, zip_code, CAST(NULL AS INTEGER) AS municipality_id,
         CAST({borough_id('borough_name')} AS INTEGER) AS borough_id, property_type, building_class,
         gross_sqft, land_sqft, year_built, residential_units, 'NY' AS region
  FROM ny_rows)"""
TOWNS = """towns AS (
  SELECT CAST(row_number() OVER (ORDER BY town) AS INTEGER) AS municipality_id,
         town AS town_name, 'CT' AS state
  FROM (SELECT DISTINCT town FROM state WHERE town IS NOT NULL))"""
CT_ROWS = """ct_rows AS (
  SELECT DISTINCT ON (address, town) *
  FROM state WHERE address IS NOT NULL
  ORDER BY address, town, _ord)"""
CT_PROPS = """ct_props AS (
  SELECT row_number() OVER (ORDER BY address, town) AS property_id, r.address, r.town,
         t.municipality_id, r.property_type
  FROM ct_rows r LEFT JOIN towns t ON t.town_name = r.town)"""
NY_SALES = """ny_sales AS (
  SELECT row_number() OVER (ORDER BY c._ord) AS transaction_id, p.property_id,
         c.sale_price, c.sale_date, c.price_per_sqft
  FROM city c JOIN ny_props p ON p.address = c.address AND p.zip_code = c.zip_code)"""
VIOL30 = VIEWS["viol"].replace("viol AS", "viol30 AS").replace("user_id % 25", "user_id % 30")


def queries() -> dict[str, str]:
    bct, bdig, use, boroughs = _maps()
    q: dict[str, str] = {}

    q["ingest_city_sales"] = W(*CITY) + """
SELECT _ord AS src, address, zip_code, borough_name, property_type, building_class,
       gross_sqft, land_sqft, year_built, residential_units, sale_price, sale_date, price_per_sqft
FROM city"""
    q["ingest_state_sales"] = W(*STATE) + """
SELECT _ord AS src, town, address, sale_price, assessed_value, sale_date, sales_ratio, property_type
FROM state"""
    q["keep_first_by_key"] = W(*CITY) + f"""
SELECT zip_code, neighborhood AS neighborhood_name,
       CAST({borough_id('borough_name')} AS INTEGER) AS borough_id
FROM (SELECT DISTINCT ON (zip_code) * FROM city ORDER BY zip_code, _ord)"""
    q["surrogate_keys"] = W(*CITY, NY_ROWS, NY_PROPS) + "SELECT * FROM ny_props"
    q["sales_key_resolution"] = W(*CITY, NY_ROWS, NY_PROPS, NY_SALES) + """
SELECT transaction_id, property_id, CAST(round(sale_price * 100) AS BIGINT) / 100.0 AS sale_price,
       sale_date, price_per_sqft, CAST(NULL AS DOUBLE) AS assessed_value_at_sale,
       false AS sold_below_assessment
FROM ny_sales"""
    q["price_history"] = W(*CITY, NY_ROWS, NY_PROPS, NY_SALES) + """
SELECT transaction_id AS history_id, property_id,
       CAST(round(sale_price * 100) AS BIGINT) / 100.0 AS sale_price, sale_date,
       CAST(year(sale_date) AS INTEGER) AS source_year
FROM ny_sales"""
    q["sales_key_resolution_parity"] = W(*CITY) + """
SELECT address, zip_code, COUNT(*) AS feed_rows, COUNT(*) * COUNT(*) AS joined_rows
FROM city GROUP BY address, zip_code"""
    q["state_key_resolution_parity"] = W(*STATE) + """
SELECT address, COUNT(*) AS feed_rows, COUNT(*) * COUNT(*) AS joined_rows
FROM state GROUP BY address"""
    q["ingest_municipalities"] = W(*STATE, TOWNS) + "SELECT * FROM towns"
    q["assessment_history"] = W(*STATE, TOWNS, CT_ROWS, CT_PROPS) + """
SELECT * FROM (
  SELECT row_number() OVER (ORDER BY s._ord) AS assessment_id, p.property_id,
         CAST(TRY_CAST(s.assessed_value AS DECIMAL(15,2)) AS DOUBLE) AS assessed_value,
         CAST(CAST(s.sale_price AS DECIMAL(15,2)) AS DOUBLE) AS sale_price,
         CAST(TRY_CAST(s.sales_ratio AS DECIMAL(8,4)) AS DOUBLE) AS sales_ratio,
         CAST(year(s.sale_date) AS INTEGER) AS assessment_year, 'CT' AS region
  FROM state s JOIN ct_props p ON p.address = s.address AND p.town = s.town)
WHERE assessed_value IS NOT NULL"""
    q["union_regions"] = W(*CITY, NY_ROWS, *STATE, TOWNS,
                           CT_ROWS, f"""u AS (
  SELECT 0 AS o, address, zip_code, NULL AS town, CAST(NULL AS INTEGER) AS municipality_id,
         CAST({borough_id('borough_name')} AS INTEGER) AS borough_id, property_type, building_class,
         gross_sqft, land_sqft, year_built, residential_units, 'NY' AS region
  FROM ny_rows
  UNION ALL
  SELECT 1, r.address, NULL, r.town, t.municipality_id, 6, r.property_type, NULL,
         NULL, NULL, NULL, NULL, 'CT'
  FROM ct_rows r LEFT JOIN towns t ON t.town_name = r.town)""") + """
SELECT row_number() OVER (ORDER BY o, address, zip_code, town) AS property_id,
       address, zip_code, municipality_id, borough_id, property_type, building_class,
       CAST(gross_sqft AS INTEGER) AS gross_sqft, CAST(land_sqft AS INTEGER) AS land_sqft,
       CAST(year_built AS INTEGER) AS year_built,
       CAST(residential_units AS INTEGER) AS residential_units, region
FROM u"""
    dec6 = "CAST(TRY_CAST({} AS DECIMAL(10,6)) AS DOUBLE)"
    q["ingest_incidents"] = W(RAW["raw_viol"]) + f"""
SELECT * FROM (
  SELECT violationid AS violation_id, {czip('zip')} AS zip_code,
         CAST({borough_id('upper(' + strip('boro') + ')')} AS INTEGER) AS borough_id,
         housenumber AS house_number, streetname AS street_name, class AS violation_class,
         {pdate('inspectiondate')} AS inspection_date, currentstatus AS current_status,
         violationstatus AS violation_status, novdescription AS description,
         {dec6.format(pdouble('latitude'))} AS latitude,
         {dec6.format(pdouble('longitude'))} AS longitude
  FROM raw_viol)
WHERE violation_id IS NOT NULL AND inspection_date IS NOT NULL"""
    q["ingest_requests_311"] = W(RAW["raw_311"]) + f"""
SELECT unique_key AS request_id, {pts('created_date')} AS created_date, complaint_type, descriptor,
       {czip('incident_zip')} AS zip_code,
       CAST({borough_id('upper(' + strip('borough') + ')')} AS INTEGER) AS borough_id, status,
       {dec6.format(pdouble('latitude'))} AS latitude,
       {dec6.format(pdouble('longitude'))} AS longitude
FROM raw_311"""
    q["ingest_home_values"] = W(RAW["raw_home"], VIEWS["neighborhood"]) + """
SELECT zip_code, CAST(month AS DATE) AS stat_month,
       CAST(TRY_CAST(TRY_CAST(value AS DOUBLE) AS DECIMAL(15,2)) AS DOUBLE) AS median_home_value
FROM (SELECT CASE WHEN length(RegionName) < 5 THEN lpad(RegionName, 5, '0') ELSE RegionName END
             AS zip_code, month, value
      FROM raw_home
      WHERE StateName = 'NY' AND month LIKE '20%' AND month >= '2000')
WHERE zip_code IN (SELECT zip_code FROM neighborhood) AND value IS NOT NULL"""
    sch = """w AS (
  SELECT dbn,
    arg_min(school_name, _ord) FILTER (WHERE metric_variable_name = 'attendance_k8_all') AS school_name,
    arg_min(school_type, _ord) FILTER (WHERE metric_variable_name = 'attendance_k8_all') AS school_type,
    arg_min(metric_value, _ord) FILTER (WHERE metric_variable_name = 'attendance_k8_all') AS att,
    arg_min(metric_value, _ord) FILTER (WHERE metric_variable_name = 'chronic_absent_ems_all') AS ab,
    bool_or(metric_variable_name = 'attendance_k8_all') AS has_att
  FROM raw_sch GROUP BY dbn),
sch AS (
  SELECT dbn, school_name, school_type,
    CASE WHEN regexp_full_match(substr(dbn, 1, 2), '^[0-9]+$')
         THEN TRY_CAST(substr(dbn, 1, 2) AS INTEGER) END AS district_id,
    """ + f"""CAST(TRY_CAST({pdouble('att')} AS DECIMAL(5,3)) AS DOUBLE) AS attendance_rate,
    CAST(TRY_CAST({pdouble('ab')} AS DECIMAL(5,3)) AS DOUBLE) AS chronic_absent
  FROM w WHERE has_att)"""
    q["ingest_schools"] = W(RAW["raw_sch"], sch) + """
SELECT * FROM sch WHERE district_id IS NULL OR district_id BETWEEN 1 AND 32"""
    q["school_quarantine"] = W(RAW["raw_sch"], sch) + """
SELECT * FROM sch WHERE district_id IS NOT NULL AND district_id NOT BETWEEN 1 AND 32"""
    q["property_school_links"] = with_views("ps") + """
SELECT p.borough_id, COUNT(DISTINCT p.property_id) AS properties,
       COUNT(DISTINCT ps.dbn) AS schools, COUNT(*) AS links
FROM ps JOIN property p ON p.property_id = ps.property_id
GROUP BY p.borough_id"""
    q["semi_known_zips"] = W(VIOL30, VIEWS["neighborhood"]) + """
SELECT violation_id, zip_code FROM viol30
WHERE zip_code IN (SELECT zip_code FROM neighborhood)"""
    q["anti_orphans"] = W(VIOL30, VIEWS["neighborhood"]) + """
SELECT violation_id, zip_code FROM viol30
WHERE zip_code IS NOT NULL AND zip_code NOT IN (SELECT zip_code FROM neighborhood)"""
    q["distinct_on"] = """
SELECT DISTINCT ON (l_orderkey, l_linenumber) *
FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_extendedprice DESC, l_partkey, l_suppkey, l_quantity,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"""
    q["exact_median"] = """
SELECT l_returnflag, l_linestatus,
       quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.5) / 100.0 AS median_price
FROM lineitem GROUP BY 1, 2"""
    q["clean_int"] = W(RAW["raw_city"]) + "SELECT _ord AS src, " + ", ".join(
        f"{cint(c)} AS {c}" for c in ("gross_square_feet", "land_square_feet", "year_built",
                                      "residential_units")) + " FROM raw_city"
    q["clean_price"] = W(RAW["raw_city"]) + f"""
SELECT _ord AS src, sale_price, {cprice('sale_price')} AS price FROM raw_city"""
    q["clean_zip"] = W(RAW["raw_city"], RAW["raw_viol"]) + f"""
SELECT _ord AS src, 'city' AS feed, zip_code AS raw, {czip('zip_code')} AS zip FROM raw_city
UNION ALL
SELECT _ord, 'violation', zip, {czip('zip')} FROM raw_viol"""
    q["parse_dates_coerce"] = W(RAW["raw_city"], RAW["raw_state"]) + f"""
SELECT _ord AS src, 'city' AS feed, {pdate('sale_date')} AS d FROM raw_city
UNION ALL
SELECT _ord, 'state', {pdate('daterecorded')} FROM raw_state"""
    q["parse_numbers_coerce"] = W(RAW["raw_state"]) + f"""
SELECT _ord AS src, {pdouble('saleamount')} AS saleamount,
       {pdouble('assessedvalue')} AS assessedvalue, {pdouble('salesratio')} AS salesratio
FROM raw_state"""
    q["sold_below_flag"] = W(*STATE) + """
SELECT _ord AS src, sale_price, assessed_value,
       COALESCE(assessed_value IS NOT NULL AND sale_price < assessed_value, false) AS sold_below_assessment
FROM state"""
    q["price_per_sqft"] = W(*CITY) + """
SELECT _ord AS src, sale_price, gross_sqft, price_per_sqft FROM city"""
    q.update(_dq_queries())
    return q


# ---- data quality ----------------------------------------------------------
# Oracle views of the star tables with the column holding each declared key.
_DQ_VIEWS = {
    "borough": "borough",
    "neighborhood": "neighborhood",
    "municipality": "municipality",
    "property": "property",
    "sales_transaction": "sale",
    "price_history": "ph",
    "assessment_history": "ah",
    "housing_violation": "viol",
    "service_request_311": "req",
    "school_district": "school_district",
    "school": "school",
    "neighborhood_market_stat": "(SELECT NULL::BIGINT AS stat_id, zip_code FROM ms)",
    "neighborhood_quality_score": "(SELECT row_number() OVER () AS score_id, zip_code FROM score)",
}
_DQ_COLS = {  # star column -> oracle view column (where the names differ)
    "sales_transaction": {"transaction_id": "transaction_id", "property_id": "property_id"},
    "price_history": {"history_id": "transaction_id"},
    "assessment_history": {"assessment_id": "transaction_id"},
}
# Fixed values of the DDL, written here anew: keys of each table (the first is
# the primary key), columns that must be set, references, lengths.
_KEYS = {
    "borough": ["borough_id", "borough_name"],
    "neighborhood": ["zip_code"],
    "municipality": ["municipality_id", "town_name,state"],
    "property": ["property_id"],
    "sales_transaction": ["transaction_id"],
    "price_history": ["history_id"],
    "assessment_history": ["assessment_id"],
    "housing_violation": ["violation_id"],
    "service_request_311": ["request_id"],
    "school_district": ["district_id"],
    "school": ["dbn"],
    "neighborhood_market_stat": ["stat_id"],
    "neighborhood_quality_score": ["score_id"],
}
_REQUIRED = [("borough", "borough_name"), ("borough", "state"), ("municipality", "town_name")]
_REFERENCES = [
    ("neighborhood", "borough_id", "borough"),
    ("property", "zip_code", "neighborhood"),
    ("property", "municipality_id", "municipality"),
    ("property", "borough_id", "borough"),
    ("sales_transaction", "property_id", "property"),
    ("price_history", "property_id", "property"),
    ("assessment_history", "property_id", "property"),
    ("housing_violation", "borough_id", "borough"),
    ("housing_violation", "zip_code", "neighborhood"),
    ("service_request_311", "borough_id", "borough"),
    ("neighborhood_market_stat", "zip_code", "neighborhood"),
    ("school_district", "borough_id", "borough"),
    ("school", "district_id", "school_district"),
    ("neighborhood_quality_score", "zip_code", "neighborhood"),
]
_LENGTHS = [
    ("borough", "borough_name", 50), ("borough", "state", 5),
    ("neighborhood", "zip_code", 10), ("neighborhood", "neighborhood_name", 100),
    ("municipality", "town_name", 100), ("municipality", "state", 5),
    ("property", "address", 200), ("property", "zip_code", 10), ("property", "property_type", 50),
    ("property", "building_class", 100), ("property", "region", 5),
    ("assessment_history", "region", 5),
    ("housing_violation", "violation_id", 20), ("housing_violation", "zip_code", 10),
    ("housing_violation", "house_number", 20), ("housing_violation", "street_name", 100),
    ("housing_violation", "violation_class", 1), ("housing_violation", "current_status", 50),
    ("housing_violation", "violation_status", 20),
    ("service_request_311", "request_id", 20), ("service_request_311", "complaint_type", 100),
    ("service_request_311", "descriptor", 200), ("service_request_311", "zip_code", 10),
    ("service_request_311", "status", 50),
    ("school", "dbn", 10), ("school", "school_name", 200), ("school", "school_type", 50),
    ("neighborhood_market_stat", "zip_code", 10),
    ("neighborhood_quality_score", "zip_code", 10),
]
AH = """ah AS (
  SELECT s.*, 'CT' AS region FROM sale s JOIN property p ON p.property_id = s.property_id
  WHERE p.region = 'CT' AND s.assessed_c IS NOT NULL)"""


def _col(t: str, c: str) -> str:
    return _DQ_COLS.get(t, {}).get(c, c)


def _row(t: str, check: str, col: str, count_sql: str) -> str:
    return (f"SELECT '{t}' AS table_name, '{check}' AS check_name, '{col}' AS column_name, "
            f"CAST(({count_sql}) AS BIGINT) AS violations")


def _star_ctes() -> str:
    return with_views(*dict.fromkeys(["borough", "municipality", "ph", "ms", "school_district", "school", *SCORE_VIEWS]),
                      extra=AH + ",\n" + VIOL30 + ",\n" + SCORE_CTES)


def _doubles(t: str, check: str, key: str) -> str:
    """Key values that more than one row holds."""
    cols = [_col(t, c) for c in key.split(",")]
    return _row(t, check, key, f"SELECT COUNT(*) FROM (SELECT 1 FROM {_DQ_VIEWS.get(t, t)} WHERE "
                f"{' AND '.join(f'{c} IS NOT NULL' for c in cols)} GROUP BY {', '.join(cols)} HAVING COUNT(*) > 1)")


def _dq_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    rows = [_doubles("lineitem", "duplicate_key", "l_orderkey,l_linenumber"),
            _doubles("orders", "duplicate_unique", "o_custkey,o_orderdate")]
    for t, keys in _KEYS.items():
        rows += [_doubles(t, "duplicate_unique" if i else "duplicate_key", key) for i, key in enumerate(keys)]
        rows.append(_row(t, "null_key", keys[0],
                         f"SELECT COUNT(*) FROM {_DQ_VIEWS[t]} WHERE {_col(t, keys[0])} IS NULL"))
    q["dq_pk"] = _star_ctes() + "\nUNION ALL\n".join(rows)

    rows = [_row(t, "not_null", c, f"SELECT COUNT(*) FROM {_DQ_VIEWS[t]} WHERE {c} IS NULL") for t, c in _REQUIRED]
    rows.append(_row("orders", "not_null", "has_line",
                     "SELECT COUNT(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"))
    q["dq_not_null"] = _star_ctes() + "\nUNION ALL\n".join(rows)

    q["dq_fk"] = _star_ctes() + "\nUNION ALL\n".join(
        _row(child, f"fk->{parent}", col,
             f"SELECT COUNT(*) FROM {'viol30' if child == 'housing_violation' else _DQ_VIEWS[child]} c "
             f"WHERE c.{_col(child, col)} IS NOT NULL AND NOT EXISTS (FROM {_DQ_VIEWS[parent]} p "
             f"WHERE p.{_KEYS[parent][0]} = c.{_col(child, col)})")
        for child, col, parent in _REFERENCES)

    rows = [_row(t, f"length>{n}", c, f"SELECT COUNT(*) FROM {_DQ_VIEWS[t]} WHERE length({_col(t, c)}) > {n}")
            for t, c, n in _LENGTHS]
    rows.append(_row("part", "length>9", "p_type", "SELECT COUNT(*) FROM part WHERE len(p_type) >= 10"))
    q["dq_length"] = _star_ctes() + "\nUNION ALL\n".join(rows)

    specs = {"sale_price": (15, 2), "assessed_value": (15, 2), "sales_ratio": (8, 4)}
    rows = [_row("state_sales", f"numeric({p},{s})", c,
                 f"SELECT COUNT(*) FROM state WHERE {c} IS NOT NULL AND "
                 f"TRY_CAST({c} AS DECIMAL({p},{s})) IS NULL") for c, (p, s) in specs.items()]
    lat = pdouble("latitude")
    rows.append(_row("violations", "numeric(4,2)", "latitude",
                     f"SELECT COUNT(*) FROM raw_viol WHERE {lat} IS NOT NULL AND "
                     f"TRY_CAST({lat} AS DECIMAL(4,2)) IS NULL"))
    q["dq_decimal"] = W(*STATE, RAW["raw_viol"]) + "\nUNION ALL\n".join(rows)

    q["dq_duplicates"] = with_views("ph") + """
SELECT property_id, price_c / 100.0 AS sale_price, sale_date,
       SUM(if(transaction_id % 7 = 0, 2, 1))::BIGINT AS rows
FROM ph GROUP BY property_id, price_c, sale_date HAVING rows > 1"""

    bct, _, _, _ = _maps()
    ptype = case_map(strip("substr(building_class_category, 1, 2)"), bct)
    price = cprice("sale_price")
    reasons = {
        "price_missing": f"{price} IS NULL",
        "price_not_above_min": f"{price} IS NOT NULL AND {price} <= 50000",
        "type_unmapped": f"{ptype} IS NULL",
        "zip_invalid": f"{czip('zip_code')} IS NULL",
        "date_invalid": f"{pdate('sale_date')} IS NULL",
    }
    q["dq_rejects"] = W(RAW["raw_city"]) + "\nUNION ALL\n".join(
        f"SELECT '{r}' AS reason, CAST(COUNT(*) FILTER (WHERE {c}) AS BIGINT) AS rows FROM raw_city"
        for r, c in reasons.items())

    use_types = ("'Single Family', 'Two Family', 'Three Family', 'Condo', 'Apartment', 'Townhouse'")
    why = {
        "city_sales": ("raw_city", {**reasons, "price_not_above_min": f"{price} <= 50000",
                                    "address_missing": "address IS NULL"}),
        "state_sales": ("raw_state", {
            "price_missing": f"{pdouble('saleamount')} IS NULL",
            "price_not_above_min": f"{pdouble('saleamount')} <= 50000",
            "type_unmapped": f"coalesce(propertytype NOT IN ({use_types}), true)",
            "date_invalid": f"{pdate('daterecorded')} IS NULL",
            "address_missing": "address IS NULL", "town_missing": "town IS NULL"}),
        "violations": ("raw_viol", {"id_missing": "violationid IS NULL",
                                    "date_invalid": f"{pdate('inspectiondate')} IS NULL"}),
    }
    parts = []
    for feed, (view, rs) in why.items():
        bad = " OR ".join(f"coalesce({c}, false)" for c in rs.values())
        for name, cond in {"read": "true", "accepted": f"NOT ({bad})", "rejected": bad, **rs}.items():
            parts.append(f"SELECT '{feed}' AS feed, '{name}' AS reason, "
                         f"CAST(COUNT(*) FILTER (WHERE {cond}) AS BIGINT) AS rows FROM {view}")
    q["dq_reject_report"] = W(RAW["raw_city"], RAW["raw_state"], RAW["raw_viol"]) + "\nUNION ALL\n".join(parts)

    q["dq_unique_month"] = with_views("ms") + "\nUNION ALL\n".join(
        _row("neighborhood_market_stat", "duplicate_unique", key,
             f"SELECT COUNT(*) FROM (SELECT {key} FROM ms GROUP BY ALL HAVING COUNT(*) > 1)")
        for key in ("zip_code,stat_month", "zip_code"))

    q["dq_duplicate_days"] = with_views("ph") + """
SELECT property_id, sale_date, COUNT(*) AS rows FROM ph
GROUP BY property_id, sale_date HAVING COUNT(*) > 1"""

    q["dq_defaults_partial"] = """
SELECT CAST(n_nationkey AS INTEGER) AS municipality_id, n_name AS town_name,
       CASE WHEN n_nationkey % 2 = 0 AND n_regionkey <> 4 THEN 'NY' ELSE 'CT' END AS state
FROM nation"""

    big, dense = "_ord % 97 = 0", "_ord % 89 = 0 AND _ord % 97 <> 0"
    sqft = "TRY_CAST(replace(gross_square_feet, ',', '') AS DOUBLE)"
    q["dq_overflow"] = W(RAW["raw_city"], f"""odd AS (
  SELECT _ord, CASE WHEN {big} THEN 1e20 WHEN {dense} THEN 2e8 ELSE {price} END AS p,
         CASE WHEN _ord % 89 = 0 THEN 1 ELSE trunc({sqft}) END AS a, building_class_category, zip_code, sale_date
  FROM raw_city)""") + f"""
SELECT 'city_sales' AS table_name, 'numeric(15,2)' AS check_name, 'sale_price' AS column_name,
       COUNT(*) FILTER (WHERE p >= 1e13) AS violations FROM odd
UNION ALL
SELECT 'city_sales', 'numeric(10,2)', 'price_per_sqft',
       COUNT(*) FILTER (WHERE abs(p / a) >= 1e8 AND a <> 0) FROM odd
UNION ALL
SELECT 'city_sales', 'overflow_is_null', 'price_per_sqft',
       COUNT(*) FILTER (WHERE a = 1 AND p >= 1e8 AND p > 50000 AND {ptype} IS NOT NULL
                        AND {czip('zip_code')} IS NOT NULL AND {pdate('sale_date')} IS NOT NULL) FROM odd"""

    q["json_array_records"] = "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, props FROM events"

    q["csv_quoted_breaks"] = """
SELECT event_id::VARCHAR AS id, event_type, props || chr(10) || '"' || event_type || '",' || chr(10) || chr(10) || event_id AS note
FROM events"""
    q["csv_headers"] = """
SELECT o_orderkey::VARCHAR AS order_key, o_orderstatus AS order_status,
       if(o_orderkey % 2 = 0, o_orderpriority, NULL) AS priority FROM orders"""
    q["parse_date_forms"] = """
SELECT o_orderkey, if(o_orderkey % 12 = 11, NULL, o_orderdate::DATE) AS d FROM orders"""
    q["append_retried"] = "SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY ALL"
    q["keys_second_load"] = """
SELECT row_number() OVER (ORDER BY supply, zip, address) AS property_id, address, zip
FROM (SELECT c_name AS address, c_nationkey AS zip, 0 AS supply FROM customer
      UNION ALL SELECT s_name, s_nationkey, 1 FROM supplier)"""
    q["changes_applied"] = """
SELECT o_orderkey AS transaction_id, cents / 100.0 AS sale_price, newest / 100.0 AS assessed_value_at_sale,
       coalesce(cents < newest, false) AS sold_below_assessment
FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents,
             (SELECT max((l_shipdate, l_linenumber, round(l_extendedprice * 100)::BIGINT)) FROM lineitem
              WHERE l_orderkey = o_orderkey)[3] AS newest
      FROM orders)"""

    q["sketches_two_loads"] = """
SELECT l_returnflag, l_linestatus, count(*) AS rows, true AS distinct_within, true AS median_within
FROM lineitem GROUP BY ALL"""

    q["dq_defaults"] = W(*STATE) + """
SELECT DISTINCT town AS town_name, 'CT' AS state FROM state"""

    q["dq_outliers"] = with_views("ph") + """
SELECT property_id, MIN(price_c) / 100.0 AS low, MAX(price_c) / 100.0 AS high
FROM ph GROUP BY property_id HAVING MAX(price_c) > 20 * MIN(price_c)"""
    return q
