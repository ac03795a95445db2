"""Text cleaners for raw feeds, as native Column expressions (no Python UDF).

Each function maps a STRING column to a typed column; anything that does not
parse becomes NULL (``try_*`` casts, so ANSI mode never raises).

Behaviour that differs from a naive Spark cast, on purpose:

* surrounding whitespace (tabs too) is stripped, not only spaces;
* numbers must match a plain decimal/exponent pattern, so Spark-only forms
  such as ``12d``/``12f`` and ``NaN``/``Infinity`` are rejected;
* results that are not finite are NULL;
* double -> int truncates toward zero and is NULL when out of INTEGER range.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code maps of the source feeds (must equal the reference's).
# Building class category prefix -> property type.
BUILDING_CLASS_TYPES = {
    "01": "HOUSE", "02": "HOUSE", "03": "HOUSE", "04": "APARTMENT",
    "07": "APARTMENT", "09": "CONDO", "10": "CONDO", "12": "TOWNHOUSE",
    "13": "CONDO", "15": "CONDO", "28": "APARTMENT",
}
# Borough digit of the city feed -> borough name.
BOROUGH_DIGITS = {
    "1": "MANHATTAN", "2": "BRONX", "3": "BROOKLYN",
    "4": "QUEENS", "5": "STATEN ISLAND",
}
# Property use text of the state feed -> property type.
STATE_USE_TYPES = {
    "Single Family": "HOUSE", "Two Family": "HOUSE", "Three Family": "HOUSE",
    "Condo": "CONDO", "Apartment": "APARTMENT", "Townhouse": "TOWNHOUSE",
}
# Tokens pandas' CSV reader treats as missing by default (the reference's
# reader); Spark's CSV reader knows only one ``nullValue``.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

NUMBER_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DIGITS_RE = r"^[0-9]+$"
ZIP_BODY_RE = r"^[0-9]{0,5}$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters ``strip`` removes: ASCII whitespace (``trim`` alone drops only
# spaces).
WHITESPACE = " \t\n\r\f\x0b"


def strip_ws(c: Column | str) -> Column:
    """Remove leading/trailing whitespace of any kind."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def parse_double(c: Column | str) -> Column:
    """Guarded text -> double; NULL for non-numbers and non-finite values.

    ``regexp_extract`` returns the whole text when it matches the number
    pattern and '' otherwise (which casts to NULL), so the text is scanned
    once; CASE branches would hide repeated sub-expressions from Spark's
    common-subexpression elimination. The pattern admits no NaN/Infinity
    words, so only an out-of-range exponent (``1e400``) can give a
    non-finite value; it is dropped.
    """
    d = F.regexp_extract(strip_ws(c), NUMBER_RE, 0).try_cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def clean_int(c: Column | str) -> Column:
    """Drop commas, strip, parse as a number, truncate toward zero -> INT."""
    return parse_double(F.translate(_c(c), ",", "")).try_cast("int")


def clean_price(c: Column | str) -> Column:
    """Drop ``$`` and commas, strip, parse; positive values only -> DOUBLE."""
    d = F.regexp_extract(strip_ws(F.translate(_c(c), "$,", "")), NUMBER_RE, 0).try_cast("double")
    return F.when((d > 0) & (d < F.lit(float("inf"))), d)


def clean_zip(c: Column | str) -> Column:
    """Strip, keep the text before the first ``.``, left-pad to five digits.

    Valid only when the result is exactly five digits; longer or signed
    values are NULL rather than truncated.
    """
    head = F.substring_index(strip_ws(c), ".", 1)
    return F.when(head.rlike(ZIP_BODY_RE), F.lpad(head, 5, "0"))


def zero_fill(c: Column | str, width: int = 5) -> Column:
    """Left-pad with zeros to ``width`` without validating or truncating."""
    s = _c(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def parse_number(c: Column | str, to: str = "double") -> Column:
    """Coercing numeric parse (bad text -> NULL), then a checked cast."""
    d = parse_double(c)
    return d if to == "double" else d.try_cast(to)


# The grammar of dates and times: a date in one of five orders of its fields,
# a time, a fraction and an offset, each of the last three optional. All groups
# of one pattern, so a text is scanned once, whatever its form.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
_NAME = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + r")\.?"
_NAME = _NAME.replace("sep(", "sept?(")
_DAY_NAME = r"(?:(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+)?"
DATE_FORMS = (  # (pattern, order of its groups)
    (r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", "y-md"),
    (r"(\d{4})(\d{2})(\d{2})", "ymd"),
    (r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})", "m-dy"),
    (rf"(\d{{1,2}})(?:st|nd|rd|th)?[- ]{_NAME}[- ,]\s*(\d{{4}}|\d{{2}})", "dNy"),
    (rf"{_NAME}[- ](\d{{1,2}})(?:st|nd|rd|th)?[- ,]\s*(\d{{4}})", "Ndy"),
)
_TIME = r"(?:(?:t|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap])?(?:\.?m\.?)?"
_OFFSET = r"(?:\s*(?:z|utc|gmt|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?))?)?"
_MARK = "\x01"


def _date_pattern() -> tuple[str, dict[str, list[int]]]:
    """The pattern of all forms, and the groups that may hold each field."""
    forms, fields, at = [], {f: [] for f in "ymdN"}, 0
    for pattern, order in DATE_FORMS:
        for k, f in enumerate(order):
            if f != "-":
                fields[f].append(at + k + 1)
        forms.append(pattern.replace("\\2", f"\\{at + 2}"))
        at += len(order)
    fields |= {"time": [at + 1, at + 2, at + 3, at + 4, at + 5]}
    return rf"^{_DAY_NAME}(?:{'|'.join(forms)}){_TIME}{_OFFSET}$", fields


def parse_timestamp(c: Column | str) -> Column:
    """Text -> TIMESTAMP_NTZ by the grammar above; anything else is NULL.

    An offset is dropped: the time is kept as the feed wrote it. Fractions
    beyond microseconds are cut; two-digit years are 1969 to 2068; of two
    numbers with a separator the month comes first."""
    pattern, fields = _date_pattern()
    n = fields["time"][-1]
    text = F.lower(strip_ws(c))
    # One replacement writes all groups in order; those of other forms are empty.
    groups = F.split(F.regexp_replace(F.when(~text.contains(_MARK), text), pattern,
                                      _MARK + _MARK.join(f"${i}" for i in range(1, n + 1))), _MARK, -1)

    def build(g: Column) -> Column:
        # A text that is no date has no second element.
        get = lambda i: F.nullif(F.get(g, F.lit(i)), F.lit(""))
        field = lambda f: F.coalesce(*[get(i) for i in fields[f]])
        hour, minute, second, fraction, half = (get(i) for i in fields["time"])
        year = field("y").cast("int") + F.when(F.length(field("y")) == 4, 0).when(
            field("y").cast("int") > 68, 1900).otherwise(2000)
        month = F.coalesce(field("m").cast("int"), F.array_position(
            F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(field("N"), 1, 3)).cast("int"))
        h = hour.cast("int")
        clock = F.when(half.isNull(), h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
        seconds = F.concat(F.coalesce(second, F.lit("0")), F.lit("."), F.rpad(
            F.coalesce(fraction, F.lit("0")), 6, "0")).cast("decimal(8,6)")
        ok = hour.isNull() | (clock.between(0, 23) & (F.coalesce(second, F.lit("0")).cast("int") < 60))
        return F.when(ok, F.try_make_timestamp_ntz(
            year, month, field("d").cast("int"), F.coalesce(clock, F.lit(0)),
            F.coalesce(minute.cast("int"), F.lit(0)), seconds))

    # The groups are taken once and named for the whole expression.
    return F.transform(F.array(groups), build)[0]


def parse_date(c: Column | str) -> Column:
    return parse_timestamp(c).cast("date")


def code_map(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup; a code missing from the map gives NULL."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*kv), _c(c))


def class_prefix(c: Column | str) -> Column:
    """First two characters, stripped (``01 ONE FAMILY`` -> ``01``)."""
    return strip_ws(F.substring(_c(c).cast("string"), 1, 2))


def building_type(c: Column | str) -> Column:
    return code_map(class_prefix(c), BUILDING_CLASS_TYPES)


def borough_from_digit(c: Column | str) -> Column:
    return code_map(strip_ws(_c(c).cast("string")), BOROUGH_DIGITS)


def state_use_type(c: Column | str) -> Column:
    return code_map(c, STATE_USE_TYPES)


def district_from_dbn(c: Column | str) -> Column:
    """Two-character district prefix of a school id as INT, else NULL."""
    p = F.substring(_c(c), 1, 2)
    return F.when(p.rlike(DIGITS_RE), p.try_cast("int"))


def null_tokens(c: Column | str, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """Map reader missing-value tokens (``NA``, ``null``, ...) to NULL."""
    col = _c(c)
    return F.when(~strip_ws(col).isin(list(tokens)), col)


def normalize_header(name: str) -> str:
    """Header normalisation: strip, lower case, runs of blanks/dashes -> ``_``."""
    return re.sub(r"[\s\-]+", "_", name.strip().lower())
