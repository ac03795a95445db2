"""The whole load: raw files -> star -> quality score -> one publish."""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession

from hearth import schemas as S
from hearth.operators.blocks import staging_scope
from hearth.plans import ingest as I
from hearth.plans import score as E
from hearth.plans.colocate import colocated_root, write_colocated
from hearth.plans.sketched import append_load
from hearth.sinks import new_run, switch_to, write_run
from hearth.sources import files

# Source files of a load: feed -> (file glob, columns, normalise headers).
SOURCES = {
    "city_sales": ("NYC_Citywide*.csv", S.RAW_CITY_SALES, True),
    "state_sales": ("ct_sales*.csv", S.RAW_STATE_SALES, False),
    "violations": ("hpd_violations*.csv", S.RAW_VIOLATIONS, False),
    "requests_311": ("complaints_311*.csv", S.RAW_311, False),
    "home_values": ("Zip_zhvi*.csv", None, False),
    "school_metrics": ("school_quality*.csv", S.RAW_SCHOOL_METRICS, False),
}


def read_feeds(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """All six raw feeds from one landing folder (every matching file)."""
    out = {}
    for feed, (glob, cols, norm) in SOURCES.items():
        out[feed] = files.read_csv(spark, data_dir, columns=cols, glob=glob, normalize=norm,
                                   multiline=True, corrupt="_corrupt")
    return out


def load(spark: SparkSession, feeds: dict[str, DataFrame], root: str,
         as_of: str | _dt.date, home_min: str = "2020", buckets: int | None = None,
         sketches: str | None = None) -> str:
    """Write the star and its score into a fresh run folder, then publish it.

    ``buckets`` also writes the tables that meet on ``property_id`` co-located
    (``plans.colocate``), which ``colocate.run_star`` reads. ``sketches`` names a
    table of sketches (``plans.sketched``) to which this load's sales are
    appended; a load of sales that an earlier load had counts them again.

    The score is computed from the tables just written (read back), so no
    cleaning runs twice. Returns the published run folder.
    """
    run_dir = new_run(root)
    with staging_scope(spark):  # the published tables do not read the scratch
        # property is read per region by the state-feed reports: partition on it
        write_run(run_dir, I.build_star(spark, feeds, home_min=home_min),
                  partition_by={"property": ["region"]})
        star = files.read_star(spark, run_dir)
        write_run(run_dir, {"neighborhood_quality_score": E.quality_score(star, as_of=as_of)},
                  partition_by={"neighborhood_quality_score": ["score_month"]})
        if buckets:
            write_colocated(star, colocated_root(run_dir), buckets=buckets)
        if sketches:
            append_load(star, sketches, os.path.basename(run_dir))
    switch_to(spark, run_dir)
    return run_dir


def run_from_files(spark: SparkSession, data_dir: str, root: str,
                   as_of: str | _dt.date | None = None, **options) -> str:
    return load(spark, read_feeds(spark, data_dir), root,
                as_of or _dt.date.today().isoformat(), **options)


__all__ = ["SOURCES", "read_feeds", "load", "run_from_files"]
