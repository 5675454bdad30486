"""Expected results at sf0.01 (FIXTURES.md, section 4)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evenkeel.operators import telemetry

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def run(spark):
    return lambda name: entry.queries()[name](spark, FOLDER)


@pytest.mark.parametrize(
    "name, count",
    [
        ("heartbeat_progress", 1982),
        ("latest_heartbeat", 150),
        ("pick_victim", 150),
        ("merge_shuffle_reads", 14_743),
        ("merge_shuffle_reads_all_tasks", 15_000),
        ("take_fraction", 7120),
        ("take_fraction_as_coded", 14_998),
        ("executors_on_host", 42),
        ("hosts_alive", 20),
        ("racks_alive", 3),
        ("executors_alive", 48),
        ("enrich_task_metrics", 11_930),
        ("unknown_executors", 50),
    ],
)
def test_row_counts(run, name, count):
    assert run(name).count() == count


def test_top_remaining(run):
    assert [tuple(r) for r in run("top_remaining").collect()] == [(16, 33), (6, 29)]


def test_completion_report(spark, run):
    largest = F.max("total_seconds")
    assert run("completion_report").agg(largest).first()[0] == 2590687.083202
    # With every event of the log as a finish, heartbeats included.
    finishes = spark.read.parquet(f"{FOLDER}/events.parquet").select(
        F.col("user_id").alias("executor_id"), F.col("ts").alias("finish_ts")
    )
    report = telemetry.completion_report(finishes)
    assert report.count() == 150
    assert report.agg(largest).first()[0] == 2591825.014487


@pytest.mark.parametrize(
    "name, moved, kept, pending",
    [("split_head", 4685, 10_313, 2), ("split_head_large_queues", 3754, 11_246, 0)],
)
def test_split(run, name, moved, kept, pending):
    by_status = {r.status: r["count"] for r in run(name).groupBy("status").count().collect()}
    assert by_status == {k: v for k, v in zip(("moved", "kept", "pending"), (moved, kept, pending)) if v}


def test_chunks(run):
    assert run("guided_chunks").agg(F.count_distinct("chunk_id")).first()[0] == 30


def test_steal(run):
    sizes = {r.queue_id: r["count"] for r in run("steal_move").groupBy("queue_id").count().collect()}
    assert [sizes[q] for q in range(8)] == [1382, 1454, 1405, 1428, 2358, 2360, 2295, 2318]


def test_move_log(run):
    assert run("steal_counts").agg(F.sum("stolen_by"), F.sum("stolen_from")).first()[:] == (13_125, 13_125)
