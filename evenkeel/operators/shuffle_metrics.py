"""Per-dependency shuffle reads merged into one record per task, and task metrics with their stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUMMED = ("fetch_wait_ms", "local_blocks", "remote_blocks", "remote_bytes")
# Fixed value: finish time of a task that has finished no shuffle read.
NOT_FINISHED = -1


def with_total_blocks(shuffle: DataFrame) -> DataFrame:
    return shuffle.withColumn("total_blocks", F.col("remote_blocks") + F.col("local_blocks"))


def merge_shuffle_reads(deps: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Counters summed, finish time the latest (at least -1). With `tasks`, those without deps too."""
    merged = deps.groupBy("task_id").agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _SUMMED],
        F.greatest(F.lit(NOT_FINISHED), F.max("shuffle_finish_ms")).cast("long").alias("shuffle_finish_ms"),
    )
    if tasks is None:
        return merged
    zeros = dict.fromkeys(_SUMMED, 0) | {"shuffle_finish_ms": NOT_FINISHED}
    return tasks.select("task_id").join(merged, "task_id", "left").fillna(zeros)


def merge_shuffle_reads_nested(task_metrics: DataFrame, deps: str = "deps") -> DataFrame:
    """The same over an array column of dependency records, row by row without a shuffle."""

    def summed(name: str) -> Column:
        zero = F.lit(0).cast("long")
        total = F.aggregate(F.col(f"{deps}.{name}"), zero, lambda a, b: a + F.coalesce(b, zero))
        return F.coalesce(total, zero)

    finish = F.array_max(F.col(f"{deps}.shuffle_finish_ms"))
    return task_metrics.withColumns(
        {name: summed(name) for name in _SUMMED}
        | {"shuffle_finish_ms": F.greatest(F.lit(NOT_FINISHED), finish).cast("long")}
    )


def enrich_task_metrics(metrics: DataFrame, tasks: DataFrame, task_sets: DataFrame) -> DataFrame:
    """Attach task set, stage and attempt; metrics of an unknown task or inactive task set go.

    `task_sets(task_set_id, stage_id, attempt)` holds the active sets. The two small-to-middling sides
    meet first; no side is hinted, so Spark broadcasts one only if its measured size allows.
    """
    known = tasks.select("task_id", "task_set_id").join(task_sets, "task_set_id")
    return metrics.join(known, "task_id")
