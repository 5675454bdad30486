"""Who has most work left, and who should take work from whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.ordinals import assign_ids


def with_work_left(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("remaining") > 0)


def top_remaining(latest: DataFrame, k: int = 2) -> DataFrame:
    """The k executors with most work left; equal ones by id."""
    left = with_work_left(latest).select("executor_id", "remaining")
    return left.orderBy(F.desc("remaining"), "executor_id").limit(k)


def top_rate(latest: DataFrame, k: int = 2) -> DataFrame:
    """The k fastest executors with work left, one per distinct rate (the largest id of that rate)."""
    per_rate = with_work_left(latest).groupBy("avg_rate").agg(F.max("executor_id").alias("executor_id"))
    return per_rate.select("executor_id", "avg_rate").orderBy(F.desc("avg_rate")).limit(k)


def pick_victim(latest: DataFrame, k: int = 2) -> DataFrame:
    """For each executor the best of the top k by remaining work that is not itself; null if none.

    Nobody is ever sent past the second candidate, so two rows are enough. They enter the plan as one
    constant: no join, and no shuffle of `latest`.
    """
    ranked = F.struct((-F.col("remaining")).alias("rank"), "executor_id")
    top = top_remaining(latest, min(k, 2))
    best = top.agg(F.sort_array(F.collect_list(ranked)).alias("best")).scalar()
    first = F.get(best, F.lit(0)).getField("executor_id")
    second = F.get(best, F.lit(1)).getField("executor_id")
    victim = F.when(first != F.col("executor_id"), first).otherwise(second)
    return latest.select("executor_id", "remaining", victim.alias("victim"))


def match_by_rank(
    latest: DataFrame, is_thief: Column, gave: DataFrame | None = None, rows_per_block: int | None = None
) -> DataFrame:
    """Pair those who ask for work with those who have most of it, each at most once: a round of moves.

    `latest(executor_id, remaining)` has a row per executor; `is_thief` says who asks. The others with work
    left can be robbed. The thief with least left takes from the victim with most, the second from the
    second, and so on; equal ones rank by id, and whoever is over on either side waits. Executors in
    `gave(executor_id)` have just handed work over and don't take now, nor are they robbed as long as they
    ask. Columns: victim_id, thief_id, rank (from 1).

    Both sides are numbered in their order and joined on the number: no executor is compared with all
    others, and none comes twice.
    """
    rows = latest.select("executor_id", "remaining", F.coalesce(is_thief, F.lit(False)).alias("_asks"))
    asks = rows.where("_asks")
    if gave is not None:
        asks = asks.join(gave.select("executor_id").distinct(), "executor_id", "left_anti")
    has = with_work_left(rows.where("NOT _asks")).withColumn("_most", -F.col("remaining"))
    thieves = assign_ids(asks, ["remaining", "executor_id"], 1, "rank", rows_per_block)
    victims = assign_ids(has, ["_most", "executor_id"], 1, "rank", rows_per_block)
    return victims.select(F.col("executor_id").alias("victim_id"), "rank").join(
        thieves.select(F.col("executor_id").alias("thief_id"), "rank"), "rank"
    ).select("victim_id", "thief_id", "rank")
