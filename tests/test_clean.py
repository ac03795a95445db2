"""Cleaners: the edge rows derived from the reference's value cleaners."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearth.functions import clean as C

INT_PRICE_CASES = [
    ("$1,234.50", None, 1234.5),
    ("  12.9 ", 12, 12.9),
    ("-3.7", -3, None),
    ("0", 0, None),
    ("1e3", 1000, 1000.0),
    ("$ 1,200", None, 1200.0),
    ("nan", None, None),
    ("", None, None),
    ("-", None, None),
    ("abc", None, None),
    (None, None, None),
    ("inf", None, None),
    ("1.5e400", None, None),
    ("12d", None, None),
    ("1_000", None, None),
    ("2147483648", None, 2147483648.0),
    ("\t7\n", 7, 7.0),
    ("1,000", 1000, 1000.0),
]

ZIP_CASES = [
    ("10001", "10001"), ("10001.0", "10001"), (" 10003 ", "10003"), ("501", "00501"),
    ("\t7", "00007"), ("0", "00000"), (".5", "00000"), ("", "00000"),
    ("10001-1234", None), ("123456", None), ("-12", None), ("nan", None), (None, None),
]


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_int_and_price(spark):
    raw = [c[0] for c in INT_PRICE_CASES]
    assert _one(spark, raw, C.clean_int) == [c[1] for c in INT_PRICE_CASES]
    assert _one(spark, raw, C.clean_price) == [c[2] for c in INT_PRICE_CASES]


def test_clean_zip(spark):
    assert _one(spark, [z[0] for z in ZIP_CASES], C.clean_zip) == [z[1] for z in ZIP_CASES]


def test_cleaners_are_idempotent(spark):
    zips = [z[1] for z in ZIP_CASES if z[1] is not None]
    assert _one(spark, zips, C.clean_zip) == zips
    vals = _one(spark, ["$1,234.50", "77", "5e2"], C.clean_price)
    assert _one(spark, [str(v) for v in vals], C.clean_price) == vals


def test_zero_fill_does_not_truncate(spark):
    assert _one(spark, ["7", "12345", "123456", None], C.zero_fill) == \
        ["00007", "12345", "123456", None]


def test_parse_date_formats(spark):
    got = _one(spark, ["2024-01-05", "01/05/2024", "1/5/2024", "2024-01-05 13:14:15",
                       "01/05/2024 01:14:15 PM", "2024-02-30", "junk", None], C.parse_date)
    d = dt.date(2024, 1, 5)
    assert got == [d, d, d, d, d, None, None, None]
    ts = _one(spark, ["01/05/2024 01:14:15 PM"], C.parse_timestamp)
    assert ts == [dt.datetime(2024, 1, 5, 13, 14, 15)]


JAN5 = dt.datetime(2025, 1, 5)


@pytest.mark.parametrize("text,want", [
    ("2025-01-05T10:30:00+00:00", JAN5.replace(hour=10, minute=30)),
    ("2025-01-05 10:30:00.123", JAN5.replace(hour=10, minute=30, microsecond=123000)),
    ("01/05/2025 10:30:00.000", JAN5.replace(hour=10, minute=30)),
    ("2025-01-05T10:30:00.123456789Z", JAN5.replace(hour=10, minute=30, microsecond=123456)),
    ("2025-01-05T10:30-0500", JAN5.replace(hour=10, minute=30)),
    ("2025-01-05 10:30:00 UTC", JAN5.replace(hour=10, minute=30)),
    ("05-Jan-25", JAN5), ("January 5 2025", JAN5), ("January 5, 2025", JAN5), ("5 January 2025", JAN5),
    ("Jan. 5, 2025", JAN5), ("JAN 5, 2025", JAN5), ("Sunday, January 5th, 2025", JAN5), ("2025.01.05", JAN5),
    ("2025/1/5", JAN5), ("20250105", JAN5), ("1-5-2025", JAN5), ("1/5/25", JAN5), ("1.5.2025", JAN5),
    ("1/5/70", dt.datetime(1970, 1, 5)), ("Sept 9, 2024", dt.datetime(2024, 9, 9)), ("1 may 2024", dt.datetime(2024, 5, 1)),
    ("\t1/5/2025 12:00 AM ", JAN5), ("1/5/2025 12:07 p.m.", JAN5.replace(hour=12, minute=7)),
    ("1/5/2025 1:07:09PM", JAN5.replace(hour=13, minute=7, second=9)),
    ("2025-13-05", None), ("2025-02-30", None), ("2025-01/05", None), ("1/5/2025 13:00 PM", None),
    ("2025-01-05 24:00", None), ("2025-01-05 10:61", None), ("2025-01-05 10:30:60", None), ("Janu 5 2025", None),
    ("5", None), ("", None), ("1/5/2025 x", None), ("2025-01-05\x01", None), ("20251", None), ("12/5", None)])
def test_date_grammar(spark, text, want):
    assert _one(spark, [text], C.parse_timestamp) == [want]


def test_code_maps(spark):
    assert _one(spark, ["01 ONE FAMILY", "28 X", " 4 odd", "99 NONE", None], C.building_type) == \
        ["HOUSE", "APARTMENT", None, None, None]
    assert _one(spark, ["1", "5", " 3 ", "9", "1.0"], C.borough_from_digit) == \
        ["MANHATTAN", "STATEN ISLAND", "BROOKLYN", None, None]
    assert _one(spark, ["Condo", "condo", "Townhouse"], C.state_use_type) == \
        ["CONDO", None, "TOWNHOUSE"]


def test_district_prefix(spark):
    assert _one(spark, ["07X123", "32K1", "75Q9", "ABX1", "7", None], C.district_from_dbn) == \
        [7, 32, 75, None, 7, None]


def test_null_tokens(spark):
    assert _one(spark, ["NA", "null", " N/A ", "value", ""], C.null_tokens) == \
        [None, None, None, "value", None]


@pytest.mark.parametrize("raw,expected", [
    (" Sale Price ", "sale_price"), ("BUILDING CLASS-CATEGORY", "building_class_category"),
    ("ZIP  CODE", "zip_code")])
def test_normalize_header(raw, expected):
    assert C.normalize_header(raw) == expected
