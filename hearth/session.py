"""SparkSession construction and cluster-shared locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces shuffle
# partitions from runtime statistics; skew join splits hot partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(app: str = "hearth", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the library's base settings.

    On a cluster ``master`` is left to spark-submit; locally pass
    ``local[N]``. ``shuffle_partitions`` defaults to Spark's own value unless
    given (tests use the core count).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # remote sessions have no SparkContext
        pass
    return spark


_LOCAL_SCRATCH: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster configures it. Only
    when it is unset (a local run) is one fresh scratch folder taken for the
    process.
    """
    global _LOCAL_SCRATCH
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    master = spark.conf.get("spark.master", "local")
    if not re.match(r"local(\[|$)", master):  # local-cluster is a cluster, too
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster "
                           "(intermediate tables are written there)")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="hearth-ckpt-")
    return _LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate."""
    return os.path.join(checkpoint_dir(spark), name)


def library_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it,
    for sessions that were started elsewhere and did not ship it."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), home])
