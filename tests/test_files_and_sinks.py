"""CSV/JSON sources, the ingest over a messy file, and the all-or-nothing sink."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

from hearth import schemas as S
from hearth.plans import ingest as I
from hearth.sinks import current_run, publish_star
from hearth.sources import files, literal

CITY_CSV = '''BOROUGH,NEIGHBORHOOD,BUILDING CLASS CATEGORY,ADDRESS,ZIP CODE,RESIDENTIAL UNITS,LAND SQUARE FEET,GROSS SQUARE FEET,YEAR BUILT,SALE PRICE,SALE DATE
1,CHELSEA,01 ONE FAMILY DWELLINGS,"10 MAIN ST, APT 1",10001,1,"2,000","1,500",1920,"$1,500,000",01/15/2025
1,CHELSEA,01 ONE FAMILY DWELLINGS,"10 MAIN ST, APT 1",10001.0,1,"2,000","1,500",1920,"$1,650,000",2025-06-02
3,PARK SLOPE,13 CONDOS - ELEVATOR,5 OAK AVE,11215,NA,,0,-,"$900,000",03/01/2025
2,FORDHAM,99 OTHER,1 ELM,10458,1,100,100,1950,"$500,000",03/01/2025
4,ASTORIA,02 TWO FAMILY,7 PINE,N/A,2,100,100,1950,"$700,000",03/01/2025
5,TOTTENVILLE,03 THREE FAMILY,9 BAY,10307,3,100,100,1950,"$10",03/01/2025
5,TOTTENVILLE,03 THREE FAMILY,9 BAY,10307,3,100,100,1950,"$800,000",not a date
'''


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_city_csv_round_trip(spark):
    tmp = tempfile.mkdtemp(prefix="hearth-csv-")
    _write(tmp, "NYC_Citywide_2025.csv", CITY_CSV)
    _write(tmp, "ignore_me.txt", "not,a,sales,file\n")
    raw = files.read_csv(spark, tmp, columns=S.RAW_CITY_SALES, glob="NYC_Citywide*.csv",
                         normalize=True)
    assert raw.count() == 7
    clean = I.clean_city_sales(raw)
    got = sorted((r["address"], r["zip_code"], r["property_type"], r["sale_price"], r["sale_date"],
                  r["gross_sqft"], r["land_sqft"], r["residential_units"])
                 for r in clean.collect())
    assert got == [
        ("10 MAIN ST, APT 1", "10001", "HOUSE", 1500000.0, dt.date(2025, 1, 15), 1500, 2000, 1),
        ("10 MAIN ST, APT 1", "10001", "HOUSE", 1650000.0, dt.date(2025, 6, 2), 1500, 2000, 1),
        ("5 OAK AVE", "11215", "CONDO", 900000.0, dt.date(2025, 3, 1), 0, None, None),
    ]
    # dedup mode: one property for the two sales of the same address/zip
    props = I.city_properties(clean, literal.boroughs(spark))
    assert props.count() == 2
    sales = I.number_sales(I.city_sales(clean, props))
    assert sorted(r["transaction_id"] for r in sales.collect()) == [1, 2, 3]
    # file order: the first neighbourhood seen for a zip wins
    nb = {r["zip_code"]: r["neighborhood_name"]
          for r in I.neighborhoods(clean, literal.boroughs(spark)).collect()}
    assert nb == {"10001": "CHELSEA", "11215": "PARK SLOPE"}
    rej = dict(map(tuple, I.city_rejects(raw).collect()))
    assert rej["type_unmapped"] == 1 and rej["zip_invalid"] == 1
    assert rej["price_not_above_min"] == 1 and rej["date_invalid"] == 1


def test_landed_json(spark):
    tmp = tempfile.mkdtemp(prefix="hearth-json-")
    with open(os.path.join(tmp, "v.json"), "w") as f:
        for i in range(3):
            f.write(json.dumps({"violationid": str(100 + i), "zip": "10001", "extra": 1}) + "\n")
    df = files.read_json(spark, tmp, ["violationid", "zip", "boro"])
    assert sorted(r["violationid"] for r in df.collect()) == ["100", "101", "102"]
    assert df.where("boro is not null").count() == 0


def test_csv_quoted_breaks_and_headers_per_file(spark):
    tmp = tempfile.mkdtemp(prefix="hearth-csv2-")
    _write(tmp, "hpd_a.csv", 'violationid,zip,novdescription\n1,10001,"line one\nline two"\n2,10002,x\n')
    _write(tmp, "hpd_b.csv", 'zip,violationid\n10003,3\n10004,4,5\n')
    df = files.read_csv(spark, tmp, columns=["violationid", "zip", "novdescription"], glob="hpd*.csv",
                        corrupt="_corrupt")
    rows = {r.violationid: r for r in df.collect()}
    assert set(rows) == {"1", "2", "3", "4"}
    assert rows["1"].novdescription == "line one\nline two" and rows["3"].zip == "10003"
    assert rows["3"].novdescription is None and rows["3"]._corrupt is None
    assert [r.violationid for r in rows.values() if r._corrupt is not None] == ["4"]


def test_json_array_layouts(spark):
    tmp = tempfile.mkdtemp(prefix="hearth-json2-")
    _write(tmp, "a.json", '[{"id":"1","z":"a]"}\n,{"id":"2","z":"b,"}\n,{"id":"3"}]\n')
    _write(tmp, "b.json", '[\n{"id":"4"},\n{"id":"5"}\n]\n')
    got = files.read_json(spark, tmp, ["id", "z"])
    assert sorted((r.id, r.z) for r in got.collect()) == [
        ("1", "a]"), ("2", "b,"), ("3", None), ("4", None), ("5", None)]
    doc = _write(tmp, "c.txt", '[{"id":\n"6"}, {"id": "7"}]')
    assert sorted(r.id for r in files.read_json(spark, doc, ["id"], document=True).collect()) == ["6", "7"]


def test_scopes_own_their_staged_folders(spark):
    from hearth.operators.blocks import stage, staging_scope
    with staging_scope(spark) as outer:
        kept = stage(spark.range(5), "a")
        with staging_scope(spark) as inner:
            stage(spark.range(3), "b")
        assert len(inner) == 1 and not os.path.exists(inner[0])
        assert kept.count() == 5
    assert not os.path.exists(outer[0])
    try:
        with staging_scope(spark) as failed:
            stage(spark.range(3), "c")
            raise ValueError
    except ValueError:
        assert not os.path.exists(failed[0])


def test_publish_star_is_all_or_nothing(spark):
    root = tempfile.mkdtemp(prefix="hearth-star-")
    b = literal.boroughs(spark)
    counts = publish_star(spark, root, {"borough": b, "school_district": literal.school_districts(spark)})
    assert counts == {"borough": 6, "school_district": 32}
    run = current_run(spark, root)
    star = files.read_star(spark, run)
    assert star.borough.count() == 6
    # a second load publishes a new run; the first stays readable until switched
    publish_star(spark, root, {"borough": b.limit(2)})
    assert current_run(spark, root) != run
    assert files.read_star(spark, run).borough.count() == 6


def test_districts_literal(spark):
    d = {r["district_id"]: r["borough_id"] for r in literal.school_districts(spark).collect()}
    assert len(d) == 32 and d[1] == 1 and d[7] == 2 and d[13] == 3 and d[24] == 4
    assert d[31] == 5 and d[32] == 5
