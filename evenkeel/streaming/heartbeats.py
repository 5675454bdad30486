"""Streams of heartbeats and metrics: latest state, alerts, and tables kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.ranking import top_remaining, with_work_left
from evenkeel.operators.shuffle_metrics import enrich_task_metrics, merge_shuffle_reads
from evenkeel.operators.telemetry import latest_heartbeat, refill_due
from evenkeel.operators.topology import unknown_executors
from evenkeel.streaming.batches import per_batch, run_batches
from evenkeel.streaming.keyed_table import KeyedTable

def stream_latest(heartbeats: DataFrame) -> DataFrame:
    """The latest record per executor, kept up to date. Use output mode `update` or `complete`."""
    return latest_heartbeat(heartbeats)


def stream_refill_alerts(heartbeats: DataFrame, rule: str = "sqrt") -> DataFrame:
    """Heartbeats `(…, remaining, batch_size, pool_size)` whose queue should be refilled now."""
    return refill_due(heartbeats, rule, "_due").where("_due").drop("_due")


def latest_table(heartbeats: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Take in what the stream has now, and read the latest record per executor so far.

    The records are a `KeyedTable` under `path`: a batch rewrites only the buckets of its executors, and a
    run that breaks off at any point loses nothing and counts nothing twice.
    """
    table = KeyedTable(
        heartbeats.sparkSession, f"{path}/table", heartbeats.schema, ["executor_id"], ["hb_ts", "hb_seq"], buckets
    )
    run_batches(heartbeats, table.merge, path)
    return table.read()


def candidates(k: int) -> Callable[[DataFrame], DataFrame]:
    """The k executors of each bucket with most work left; whoever is `gone` is not among them."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("remaining"), "executor_id"))

    def derive(latest: DataFrame) -> DataFrame:
        here = latest.where("NOT coalesce(gone, false)") if "gone" in latest.columns else latest
        left = with_work_left(here).select("executor_id", "remaining", "bucket")
        return left.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")

    return derive


def top_table(heartbeats: DataFrame, path: str, k: int = 2, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Take in what the stream has now; the k executors with most work left, and the latest records.

    `heartbeats(executor_id, hb_ts, hb_seq, remaining, …)`; a record with a true `gone`, if there is such a
    column, takes its executor out. Each bucket of the latest records has its k best beside it, made again
    only when the bucket changes, so the best of all are found among `k * buckets` rows, whatever the number
    of executors, and whether work grew, fell or left.
    """
    table = KeyedTable(
        heartbeats.sparkSession,
        f"{path}/table",
        heartbeats.schema,
        ["executor_id"],
        ["hb_ts", "hb_seq"],
        buckets,
        derive=candidates(k),
    )
    run_batches(heartbeats, table.merge, path)
    return top_remaining(table.read_derived(), k), table.read()


def unknown_senders(heartbeats: DataFrame, executors: Callable[[], DataFrame], path: str) -> DataFrame:
    """Per batch, the senders that are not registered when it is read: (executor_id, batch).

    `executors` opens the registered executors; it is called for each batch, so whoever registers meanwhile
    is not reported again.
    """
    return per_batch(heartbeats, lambda batch: unknown_executors(batch, executors()), path)


def enriched_metrics(
    metrics: DataFrame, tasks: Callable[[], DataFrame], task_sets: Callable[[], DataFrame], path: str
) -> DataFrame:
    """Task metrics with their task set, stage and attempt, as these tables are when each batch is read.

    Metrics of tasks that are not known then, or of a task set that is not active, go. Adds `batch`.
    """
    return per_batch(metrics, lambda batch: enrich_task_metrics(batch, tasks(), task_sets()), path)


def merged_reads_table(deps: DataFrame, path: str, order: Sequence[str] = ("update_seq",), buckets: int = 64) -> DataFrame:
    """Take in what a stream of shuffle reads has now, and read the merged record of each task so far.

    `deps(task_id, dep_id, …, update_seq)`: later records of a dependency correct earlier ones, late and
    repeated ones count once. The newest record of each (task, dependency) is kept in buckets by task; the
    sums of a bucket are made again from them when it changes.
    """

    def sums(newest: DataFrame) -> DataFrame:
        # A task has one bucket, so the bucket is that of its records.
        return merge_shuffle_reads(newest).withColumn("bucket", table.bucket())

    table = KeyedTable(
        deps.sparkSession,
        f"{path}/table",
        deps.schema,
        ["task_id", "dep_id"],
        list(order),
        buckets,
        spread=["task_id"],
        derive=sums,
    )
    run_batches(deps, table.merge, path)
    return table.read_derived()
