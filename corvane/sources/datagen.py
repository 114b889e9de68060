"""The benchmark's orders and customers, generated in parallel and the same for each seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The benchmark's domains.
STATUSES = ["PAID", "PENDING", "CANCELLED", "REFUNDED"]
REGIONS = ["US", "EU", "APAC", "LATAM", "MEA"]


def _uniform(salt: int, seed: int):
    """In [0, 1), a function of the row's id, so that it does not depend on partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "id"), 11).cast("double") / float(1 << 53)


def _pick(values: list[str], salt: int, seed: int):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(_uniform(salt, seed) * len(values)) + 1).cast("int"))


def orders(spark: SparkSession, n: int = 2_000_000, customers: int = 2_000, seed: int = 42) -> DataFrame:
    return spark.range(n).select(
        F.col("id").alias("order_id"),
        F.floor(_uniform(1, seed) * customers).cast("long").alias("customer_id"),
        F.round(5 + _uniform(2, seed) * 1995, 2).alias("amount"),
        (F.floor(_uniform(3, seed) * 20) + 1).cast("long").alias("quantity"),
        _pick(STATUSES, 4, seed).alias("status"),
        _pick(REGIONS, 5, seed).alias("region"),
    )


def customers(spark: SparkSession, n: int = 2_000, seed: int = 99) -> DataFrame:
    return spark.range(n).select("id", F.concat(F.lit("customer_"), F.col("id").cast("string")).alias("name"), _pick(REGIONS, 1, seed).alias("region"))
