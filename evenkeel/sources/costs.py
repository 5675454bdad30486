"""Work-item costs: from a text file of integers, or drawn at random."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """One integer per text line as `cost_ms`; a line that is none is an error, with or without ANSI mode."""
    line = F.col("value")
    cost = line.try_cast("long")
    bad = F.raise_error(F.concat(F.lit("not an integer cost: "), line)).cast("long")
    return spark.read.text(path).select(F.when(cost.isNotNull(), cost).otherwise(bad).alias("cost_ms"))


def gen_work_items(spark: SparkSession, n: int, bound: int = 200, seed: int = 0) -> DataFrame:
    """n pool items with costs spread evenly over the integers `[0, bound)`.

    A cost depends on the seed and the item alone, on no partition: the same on every cluster.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 12)
    return spark.range(n).select(
        F.col("id").alias("item_id"),
        F.lit(None).cast("long").alias("queue_id"),
        (F.col("id") + 1).alias("pos"),
        (F.conv(digits, 16, 10).cast("long") % bound).alias("cost_ms"),
    )
