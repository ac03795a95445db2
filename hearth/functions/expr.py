"""Derived-column expressions of the star model and the quality score."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearth import schemas as S


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """``a / NULLIF(b, 0)``: NULL instead of a division error."""
    return _c(a) / F.nullif(_c(b), F.lit(0))


def price_per_sqft(price: Column | str, sqft: Column | str) -> Column:
    """Price over area rounded to cents when the area is positive, else NULL.

    A quotient too large for the column is NULL too (``decimal_overflow``
    counts such rows); it must not abort the job."""
    sq = _c(sqft)
    return F.when(sq > 0, F.round(_c(price) / sq, 2)).try_cast(S.PPSF)


def sold_below_assessment(price: Column | str, assessed: Column | str) -> Column:
    """Row-trigger flag: TRUE only when assessed is known and price is below it."""
    a = _c(assessed)
    return F.coalesce(a.isNotNull() & (_c(price) < a), F.lit(False))


def pct(part: Column, whole: Column, digits: int) -> Column:
    """``ROUND(100.0 * part / NULLIF(whole, 0), digits)`` in exact decimals."""
    num = F.lit(100).cast("decimal(3,0)") * part.cast("decimal(20,0)")
    return F.round(num / F.nullif(whole.cast("decimal(20,0)"), F.lit(0)), digits)


def pct_change(start: Column | str, end: Column | str, digits: int = 1) -> Column:
    """``ROUND(100.0 * (end - start) / NULLIF(start, 0), digits)``."""
    s, e = _c(start), _c(end)
    return F.round(F.lit(100).cast("decimal(3,0)") * (e - s) / F.nullif(s, F.lit(0)), digits)


def month_start(as_of: str | _dt.date) -> Column:
    """First day of the month of a given date (a parameter, never 'today')."""
    return F.trunc(F.lit(str(as_of)).cast("date"), "month")


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (least/greatest alone would skip it)."""
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNotNull(), out)


# Weights of the composite neighbourhood score.
SCORE_BASE = 100
VIOLATION_WEIGHT = "0.5"
VIOLATION_CAP = 50
COMPLAINT_WEIGHT = "0.1"
COMPLAINT_CAP = 30
ATTENDANCE_WEIGHT = 30


def quality_score(violations: Column | str, complaints: Column | str,
                  attendance: Column | str) -> Column:
    """``clip(100 - min(0.5 v, 50) - min(0.1 c, 30) + 30 att, 0, 100)`` to cents.

    Missing counts count as 0, missing attendance as 0. Evaluated in exact
    decimals; the result is NUMERIC(5,2).
    """
    dec = "decimal(38,12)"
    v = F.coalesce(_c(violations), F.lit(0)).cast(dec)
    c = F.coalesce(_c(complaints), F.lit(0)).cast(dec)
    a = F.coalesce(_c(attendance).cast(dec), F.lit(0).cast(dec))
    raw = (F.lit(SCORE_BASE).cast(dec)
           - F.least(v * F.lit(VIOLATION_WEIGHT).cast("decimal(2,1)"), F.lit(VIOLATION_CAP).cast(dec))
           - F.least(c * F.lit(COMPLAINT_WEIGHT).cast("decimal(2,1)"), F.lit(COMPLAINT_CAP).cast(dec))
           + a * F.lit(ATTENDANCE_WEIGHT).cast("decimal(3,0)"))
    clipped = F.greatest(F.least(raw, F.lit(100).cast(dec)), F.lit(0).cast(dec))
    return F.round(clipped, 2).cast(S.PCT)
