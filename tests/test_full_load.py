"""The whole load: six raw feeds -> star -> publish -> reports on the published star."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from hearth import schemas as S
from hearth.operators import quality as Q
from hearth.plans import ingest as I
from hearth.plans import reports as R
from hearth.plans import score as E
from hearth.sinks import current_run, publish_star
from hearth.sources import files, rawfeeds


def _feeds(star):
    return {
        "city_sales": rawfeeds.city_sales(star),
        "state_sales": rawfeeds.state_sales(star),
        "violations": rawfeeds.violations(star),
        "requests_311": rawfeeds.requests_311(star),
        "home_values": rawfeeds.home_values_wide(star),
        "school_metrics": rawfeeds.school_metrics(star),
    }


def test_build_publish_and_report(spark, star_small):
    tables = I.build_star(spark, _feeds(star_small), home_min="2000")
    root = tempfile.mkdtemp(prefix="hearth-load-")
    counts = publish_star(spark, root, tables)
    star = files.read_star(spark, current_run(spark, root))

    # declared columns and types of the star
    for name in ("borough", "neighborhood", "municipality", "property", "sales_transaction",
                 "school_district", "school"):
        got = {f.name: f.dataType for f in getattr(star, name).schema.fields}
        for f in S.STAR[name].fields:
            assert f.name in got, (name, f.name)
    # keys are unique and dense; every sale resolves to one property
    for name in ("property", "sales_transaction"):
        key = S.PRIMARY_KEYS[name][0]
        ids = sorted(r[0] for r in getattr(star, name).select(key).collect())
        assert ids == list(range(1, len(ids) + 1))
    assert Q.orphans(star.sales_transaction, "property_id", star.property, "property_id").count() == 0
    # city + state sales, no fan-out: one sale per cleaned feed row
    city = I.clean_city_sales(rawfeeds.city_sales(star_small)).count()
    st = I.clean_state_sales(rawfeeds.state_sales(star_small)).count()
    assert counts["sales_transaction"] == city + st
    # NY sales have no assessed value, so their flag is always FALSE
    ny = (star.sales_transaction.join(star.property.where("region = 'NY'"), "property_id")
          .where(F.col("sold_below_assessment")).count())
    assert ny == 0

    # the reports run on the published star
    assert R.avg_price_by_borough(star).count() > 0
    assert R.annual_trend_city(star).where("borough_name = 'CONNECTICUT'").count() == 0
    score = E.quality_score(star)
    assert score.count() == star.neighborhood.count()
    assert R.towns_below_assessment(star, min_sales=0).count() > 0


def _land_csv(spark, df, folder, name):
    """Write one feed as a single CSV file named ``name`` in ``folder`` (test helper)."""
    import glob
    import os
    import shutil
    tmp = tempfile.mkdtemp(prefix="hearth-csvout-")
    df.drop("_ord").coalesce(1).write.mode("overwrite").option("header", "true").csv(tmp)
    part = glob.glob(os.path.join(tmp, "part-*.csv"))[0]
    shutil.copy(part, os.path.join(folder, name))


def test_load_from_landed_files(spark, star_small):
    from hearth.plans.load import load, read_feeds
    land = tempfile.mkdtemp(prefix="hearth-landing-")
    names = {"city_sales": "NYC_Citywide_2025.csv", "state_sales": "ct_sales.csv",
             "violations": "hpd_violations.csv", "requests_311": "complaints_311.csv",
             "home_values": "Zip_zhvi_sm.csv", "school_metrics": "school_quality.csv"}
    for feed, df in _feeds(star_small).items():
        if feed == "city_sales":   # the city file has display headers
            df = df.toDF(*[c.upper().replace("_", " ") for c in df.columns])
        _land_csv(spark, df, land, names[feed])
    feeds = read_feeds(spark, land)
    root = tempfile.mkdtemp(prefix="hearth-root-")
    from hearth.session import checkpoint_dir
    before = set(os.listdir(checkpoint_dir(spark)))
    run = load(spark, feeds, root, as_of="2024-06-15", home_min="2000")
    assert current_run(spark, root) == run
    star = files.read_star(spark, run)
    score = star.neighborhood_quality_score
    assert score.count() == star.neighborhood.count() > 0
    assert {r[0].isoformat() for r in score.select("score_month").distinct().collect()} == \
        {"2024-06-01"}
    # the file load and the in-memory load agree on the cleaned city rows
    city = I.clean_city_sales(rawfeeds.city_sales(star_small)).count()
    ny = star.sales_transaction.join(star.property.where("region = 'NY'"), "property_id").count()
    assert ny == city
    assert star.neighborhood_market_stat.select("stat_id").distinct().count() == \
        star.neighborhood_market_stat.count()
    # no scratch is left, every feed's rows are accounted for
    from hearth.session import checkpoint_dir
    left = [f for f in os.listdir(checkpoint_dir(spark)) if f.startswith(("city_sales-", "state_sales-", "sales-"))]
    assert not set(left) - before
    rejected = {(r.feed, r.reason): r.rows for r in star.rejected_rows.collect()}
    for feed in ("city_sales", "state_sales", "violations"):
        assert rejected[feed, "read"] == rejected[feed, "accepted"] + rejected[feed, "rejected"]
        assert rejected[feed, "read"] == feeds[feed].count() and rejected[feed, "malformed"] == 0
    assert star.school_quarantine.columns == star.school.columns


def test_region_partition_is_pruned(spark, star_small):
    from hearth.plans.load import load
    root = tempfile.mkdtemp(prefix="hearth-root2-")
    run = load(spark, _feeds(star_small), root, as_of="2024-06-15", home_min="2000")
    star = files.read_star(spark, run)
    plan = star.property.where("region = 'CT'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan and "(region" in plan
    assert R.towns_below_assessment(star, min_sales=0).count() > 0
