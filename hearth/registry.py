"""Named queries over the test star: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry runs a library job on the star derived from the whole test tables
of ``sf_dir`` (see ``hearth.sources.testviews``) with the test parameters of
``hearth.oracle``. Decimal outputs are cast to DOUBLE so both engines hand
back the same value types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import oracle as P
from hearth.plans import reports as R
from hearth.plans import score as E
from hearth.sources.testviews import load_star

Query = Callable[[SparkSession, str], DataFrame]


def as_doubles(df: DataFrame) -> DataFrame:
    """Cast DECIMAL columns to DOUBLE (values are already rounded)."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal")
                       else F.col(c) for c, t in df.dtypes])


def _score(star):
    return E.quality_score(star, as_of=P.AS_OF)


def _q(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_doubles(fn(load_star(spark, sf_dir)))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


REPORTS: dict[str, Query] = {
    "avg_price_by_borough": _q(R.avg_price_by_borough),
    "top_zips_by_score": _q(lambda s: R.top_zips_by_score(_score(s))),
    "towns_below_assessment": _q(R.towns_below_assessment),
    "attendance_vs_price": _q(lambda s: R.attendance_vs_price(s, high_cut=P.ATTENDANCE_CUT)),
    "complaint_share_by_zip": _q(lambda s: R.complaint_share_by_zip(s, min_count=P.COMPLAINT_MIN)),
    "home_value_change": _q(R.home_value_change),
    "home_value_change_minby": _q(R.home_value_change_minby),
    "price_by_type": _q(R.price_by_type),
    "market_overview_by_type": _q(R.market_overview_by_type),
    "price_gain": _q(R.price_gain),
    "price_gain_dedup": _q(R.price_gain_dedup),
    "score_tiers": _q(lambda s: R.score_tiers(_score(s), high=P.SCORE_HIGH,
                                              medium=P.SCORE_MEDIUM)),
    "annual_trend": _q(lambda s: R.annual_trend(s, start_year=P.TREND_START_YEAR)),
    "annual_trend_city": _q(R.annual_trend_city),
    "sales_by_zip": _q(E.sales_by_zip),
    "attendance_by_zip": _q(E.attendance_by_zip),
    "quality_score": _q(_score),
}


def _ops() -> dict[str, Query]:
    from hearth import registry_ops
    return {name: _q(fn) for name, fn in registry_ops.OPS.items()}


def queries() -> dict[str, Query]:
    return {**REPORTS, **_ops()}


def oracle_sql() -> dict[str, str]:
    from hearth import oracle_ops
    reports = P.queries()
    # The same reports over co-located tables must give the same rows.
    colocated = {f"{n}_colocated": reports[n] for n in ("avg_price_by_borough", "price_by_type", "price_gain")}
    return {**reports, **oracle_ops.queries(), **colocated}
