"""Skew check: one group holds a third of all rows.

    python tools/skew_check.py [rows]

Runs the exact median, DISTINCT ON and dense keys over generated rows where
group 0 holds 1/3 of the data, then reports how many range blocks the hot
group spans and the largest task (shuffle records read) of any stage from
the event log: tasks stay bounded by the block size, not by the group. Generated data is used only here, to shape the skew; the registered
queries all read the test tables.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from hearth.operators.blocks import BLOCK, range_blocks  # noqa: E402
from hearth.operators.dedup import Order, distinct_on  # noqa: E402
from hearth.operators.keys import dense_keys  # noqa: E402
from hearth.operators.quantile import percentile_cont  # noqa: E402
from hearth.session import get_spark  # noqa: E402


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 6_000_000
    ev = tempfile.mkdtemp(prefix="hearth-skew-ev-")
    spark = get_spark("skew", master="local[8]", shuffle_partitions=64,
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": ev,
                             "spark.eventLog.compress": "false",
                             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="hearth-skew-ck-")})
    df = (spark.range(n, numPartitions=16)
          .select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("g"),
                  (F.hash("id") % 100000).cast("double").alias("v"), F.col("id")))
    runs = {
        "percentile_cont": lambda: percentile_cont(df, ["g"], "v", 0.5, alias="m"),
        "distinct_on": lambda: distinct_on(df, ["g"], [Order("v", desc=True), Order("id")]),
        "dense_keys": lambda: dense_keys(df.select("id", "g"), ["g", "id"], key="k"),
    }
    for name, fn in runs.items():
        t0 = time.time()
        fn().write.format("noop").mode("overwrite").save()
        print(f"{name:16s} {time.time() - t0:6.1f}s", flush=True)
    blocks = range_blocks(df.select("g", "id"), ["g", "id"])
    per = blocks.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("rows"),
                                    F.count_if(F.col("g") == 0).alias("hot"))
    stats = per.agg(F.count(F.lit(1)).alias("blocks"), F.max("rows").alias("max_rows"),
                    F.count_if(F.col("hot") > 0).alias("blocks_with_hot_group")).first()
    print(json.dumps({"blocks": stats["blocks"], "max_rows_per_block": stats["max_rows"],
                      "blocks_spanned_by_hot_group": stats["blocks_with_hot_group"]}))
    spark.stop()
    worst, names = {}, {}
    for f in glob.glob(os.path.join(ev, "*", "*")) + glob.glob(os.path.join(ev, "*")):
        if os.path.isdir(f):
            continue
        for line in open(f):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                names[si["Stage ID"]] = (si["Stage Name"][:60], si["Number of Tasks"])
            if e.get("Event") == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                sid = e["Stage ID"]
                worst[sid] = max(worst.get(sid, 0), rec)
    for sid in sorted(worst):
        if worst[sid] > n // 30:
            print("stage", sid, names.get(sid), "max task records", worst[sid])
    top = max(worst.values()) if worst else 0
    print(json.dumps({"rows": n, "hot_group_rows": n // 3,
                      "max_shuffle_records_in_one_task": top}))


if __name__ == "__main__":
    main()
