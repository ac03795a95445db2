"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``uid, cls``: every end of the links ``(a, b)`` with the smallest uid of
    its component. Rows without links are not in the result.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so a component of any shape is done after about
    log2(diameter) rounds. The tables are staged before they are joined, so a
    node with a third of all links is a skewed key that the join can split.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("uid")).agg(
        F.least(F.min("b"), F.first("a")).alias("cls")), "labels")
    while True:
        around = (both.join(labels.select(F.col("uid").alias("b"), "cls"), "b")
                  .groupBy(F.col("a").alias("uid")).agg(F.min("cls").alias("near")))
        lower = stage(labels.join(around, "uid").select(
            "uid", F.col("cls").alias("was"), F.least("cls", "near").alias("cls")), "labels")
        jump = lower.select(F.col("uid").alias("cls"), F.col("cls").alias("next"))
        labels = stage(lower.join(jump, "cls").select(
            "uid", "was", F.least("cls", "next").alias("cls")), "labels")
        if labels.filter("was <> cls").limit(1).count() == 0:
            return labels.select("uid", "cls")
