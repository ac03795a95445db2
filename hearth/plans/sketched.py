"""The market overview from sketches that each load leaves behind (opt-in)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import sketches as K
from hearth.sinks import append_batch, read_batches

BY = ["property_type", "region"]


def sales_sketch(star) -> DataFrame:
    """Per property type and region: the properties sold and the prices."""
    p = star.property.select("property_id", *BY)
    sold = star.sales_transaction.select("property_id", "sale_price").join(p, "property_id")
    return K.sketch(sold, BY, {"properties": "property_id"}, {"price": "sale_price"})


def append_load(star, path: str, load: str) -> int | None:
    """Add a load's sketches to the table at ``path``; once, if it is retried."""
    return append_batch(sales_sketch(star), path, load)


def market_by_type(spark: SparkSession, path: str) -> DataFrame:
    """Per property type, over all loads: sales, properties sold and median
    price, within the errors that ``operators.sketches`` states. Its work grows
    with the number of loads, not with their sales."""
    merged = K.merge(read_batches(spark, path), ["property_type"])
    return (K.estimate(merged, ["property_type"], ["price"]).where(F.col("property_type").isNotNull())
            .select("property_type", F.col("price_n").alias("num_sales"),
                    F.col("properties_distinct").alias("num_properties"), F.col("price_median").alias("median_price"))
            .orderBy("property_type"))
