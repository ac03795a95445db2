"""Tables that meet on ``property_id``, written co-located (S3, J9 to J12).

Properties and their sales are written in the same number of buckets by
``property_id``, each sorted by it. A join or an aggregate by property then
needs no shuffle of the facts: bucket meets bucket.

A bucket is read by one task. So a property that holds a large share of the
sales must not be read so: after the write the largest bucket is compared with
the mean, and beyond ``MOST_SKEW`` times it the tables are read as plain files,
which split, and whose shuffle the adaptive join splits. Writing spreads each
bucket over ``SPREAD`` tasks, a hot property's rows, too.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.sinks import _fs
from hearth.sources.files import StarTables, read_star

KEY = "property_id"
TABLES = ["property", "sales_transaction", "price_history", "assessment_history"]
SPREAD = 4
MOST_SKEW = 4.0
_INFO = "colocated.json"


def colocated_root(run_dir: str) -> str:
    return os.path.join(run_dir, "colocated")


def _name(path: str) -> str:
    return "colocated_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_colocated(star, root: str, tables: list[str] | None = None, buckets: int | None = None,
                    key: str = KEY) -> None:
    """Write the tables of ``star`` under ``root`` in buckets by ``key``."""
    info = {}
    for t in tables or TABLES:
        df, path = getattr(star, t), os.path.join(root, t)
        spark = df.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        bucket = F.pmod(F.hash(key), F.lit(n))
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD))
        (df.repartition(n * SPREAD, bucket, salt).write.format("parquet").bucketBy(n, key).sortBy(key)
         .mode("overwrite").option("path", path).saveAsTable(_name(path)))
        info[t] = {"key": key, "buckets": n, "schema": [[f.name, f.dataType.simpleString()] for f in df.schema],
                   "skew": _skew(spark, path, n)}
        _put(spark, os.path.join(root, _INFO), json.dumps(info))


def _skew(spark: SparkSession, path: str, n: int) -> float:
    """Bytes of the largest bucket over the mean of all, from the file names."""
    fs, p, _ = _fs(spark, path)
    size = [0] * n
    for f in fs.listStatus(p):
        m = re.search(r"_(\d{5,})(\.c\d+)?\.", f.getPath().getName())
        if m:
            size[int(m.group(1))] += f.getLen()
    return max(size) * n / sum(size) if sum(size) else 1.0


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_colocated(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables under ``root``: by their buckets, or as plain files where one
    bucket is too large."""
    info = json.loads("".join(r["value"] for r in spark.read.text(os.path.join(root, _INFO)).collect()))
    even = all(i["skew"] <= MOST_SKEW for i in info.values())
    out = {}
    for t, i in info.items():
        path = os.path.join(root, t)
        if not even:
            out[t] = spark.read.parquet(path)
            continue
        columns = ", ".join(f"`{c}` {kind}" for c, kind in i["schema"])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({columns}) USING parquet CLUSTERED BY ({i['key']}) "
                  f"SORTED BY ({i['key']}) INTO {i['buckets']} BUCKETS LOCATION '{path}'")
        out[t] = spark.read.table(_name(path))
    return out


class ColocatedStar:
    """A star whose tables are the co-located ones where there are any."""

    def __init__(self, star, tables: dict[str, DataFrame]):
        self._star, self._tables = star, tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._tables[name] if name in self._tables else getattr(self._star, name)


def colocated_star(spark: SparkSession, star, root: str) -> ColocatedStar:
    return ColocatedStar(star, read_colocated(spark, root))


def run_star(spark: SparkSession, run_dir: str) -> StarTables | ColocatedStar:
    """The star of a run, co-located if its load wrote it so."""
    star, root = read_star(spark, run_dir), colocated_root(run_dir)
    fs, p, _ = _fs(spark, os.path.join(root, _INFO))
    return colocated_star(spark, star, root) if fs.exists(p) else star
