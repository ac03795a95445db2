"""Command line: load a landing folder, run a report, check a published star.

    python -m hearth load   --data DIR --out ROOT [--as-of YYYY-MM-DD]
    python -m hearth report NAME --star ROOT [--rows 50]
    python -m hearth check  --star ROOT
"""

from __future__ import annotations

import argparse

from hearth.session import get_spark

REPORTS = {
    "avg_price_by_borough": ("star", "avg_price_by_borough"),
    "top_zips_by_score": ("score", "top_zips_by_score"),
    "towns_below_assessment": ("star", "towns_below_assessment"),
    "attendance_vs_price": ("star", "attendance_vs_price"),
    "complaint_share_by_zip": ("star", "complaint_share_by_zip"),
    "home_value_change": ("star", "home_value_change_minby"),
    "price_by_type": ("star", "price_by_type"),
    "market_overview_by_type": ("star", "market_overview_by_type"),
    "price_gain": ("star", "price_gain"),
    "price_gain_dedup": ("star", "price_gain_dedup"),
    "score_tiers": ("score", "score_tiers"),
    "annual_trend": ("star", "annual_trend"),
    "annual_trend_city": ("star", "annual_trend_city"),
}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="hearth")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("load")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--as-of")
    p.add_argument("--buckets", type=int, help="also write the tables of property_id co-located")
    p.add_argument("--sketches", help="append sketches of this load's sales to that table")
    p = sub.add_parser("report")
    p.add_argument("name", choices=sorted(REPORTS))
    p.add_argument("--star", required=True)
    p.add_argument("--rows", type=int, default=50)
    p = sub.add_parser("check")
    p.add_argument("--star", required=True)
    a = ap.parse_args(argv)

    spark = get_spark("hearth")
    from hearth.sinks import current_run
    from hearth.sources.files import read_star
    if a.cmd == "load":
        from hearth.plans.load import run_from_files
        print(run_from_files(spark, a.data, a.out, a.as_of, buckets=a.buckets, sketches=a.sketches))
    elif a.cmd == "report":
        from hearth.plans import reports as R
        from hearth.plans.colocate import run_star
        star = run_star(spark, current_run(spark, a.star))
        kind, fn_name = REPORTS[a.name]
        fn = getattr(R, fn_name)
        arg = star.neighborhood_quality_score if kind == "score" else star
        fn(arg).show(a.rows, truncate=False)
    else:
        from hearth.operators import quality as Q
        star = read_star(spark, current_run(spark, a.star))
        tables = ["borough", "neighborhood", "municipality", "property", "sales_transaction",
                  "price_history", "assessment_history", "housing_violation",
                  "service_request_311", "neighborhood_market_stat", "school_district",
                  "school", "neighborhood_quality_score"]
        for rep in (Q.primary_key_report, Q.not_null_report, Q.foreign_key_report,
                    Q.length_report):
            rep(star, tables).where("violations > 0").show(200, truncate=False)


if __name__ == "__main__":
    main()
