"""hearth — property-market and neighbourhood-quality analytics on PySpark.

Layout:

* ``hearth.sources``   — raw CSV/JSON readers, literal dimension tables, the
  star model read from Parquet (or derived from the driver's test tables).
* ``hearth.functions`` — Column -> Column cleaners and scoring expressions.
* ``hearth.operators`` — reusable plan fragments: keys, dedup, reshape,
  joins, exact distributed quantiles, data-quality checks.
* ``hearth.plans``     — whole jobs: ingest (CSV -> star), quality score,
  reporting queries.
* ``hearth.sinks``     — Parquet writers with all-or-nothing publish.

Every job returns a lazy DataFrame built from native expressions; nothing is
collected to the driver.
"""

from hearth.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
