import datetime as dt

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import ranking, telemetry

# One log per executor: h is a heartbeat, c a completion.
LOGS = {"A": (4, "hchcch"), "B": (2, "hcch"), "C": (3, "h"), "D": (5, "h")}
START = dt.datetime(2024, 1, 1)


def logs(spark, which=LOGS):
    beats, done = [], []
    for name, (_, text) in which.items():
        for i, kind in enumerate(text):
            (beats if kind == "h" else done).append((name, START + dt.timedelta(seconds=i)))
    counts = [(name, n) for name, (n, _) in which.items()]
    return (
        spark.createDataFrame(counts, "executor_id string, assigned long"),
        spark.createDataFrame(done, "executor_id string, finish_ts timestamp"),
        spark.createDataFrame(beats, "executor_id string, hb_ts timestamp"),
    )


STATES = {
    ("A", 1): (0, 4, 0, 0.0),
    ("A", 2): (1, 3, 1, 0.5),
    ("A", 3): (3, 1, 2, 1.0),
    ("B", 1): (0, 2, 0, 0.0),
    ("B", 2): (2, 0, 2, 1.0),
    ("C", 1): (0, 3, 0, 0.0),
    ("D", 1): (0, 5, 0, 0.0),
}


@pytest.mark.parametrize("rows_per_block", [None, 1, 2, 3, 5])
def test_progress(spark, rows_per_block):
    progress = telemetry.heartbeat_progress(*logs(spark), rows_per_block=rows_per_block)
    got = {
        (r.executor_id, r.hb_seq): (r.processed, r.remaining, r.delta, r.avg_rate)
        for r in progress.collect()
    }
    assert got == STATES


def test_heartbeat_counts_item_in_progress(spark):
    """A completion at the very time of a heartbeat comes after it."""
    assigned, done, beats = logs(spark, {"A": (2, "hch")})
    done = done.withColumn("finish_ts", F.lit(START))
    first = telemetry.heartbeat_progress(assigned, done, beats).where("hb_seq = 1").first()
    assert (first.processed, first.remaining) == (0, 2)


def test_progress_with_moves(spark):
    times = [START + dt.timedelta(milliseconds=500 + 1000 * i) for i in range(2)]
    moves = spark.createDataFrame(
        [("D", "A", times[0]), ("D", "A", times[1])],
        "victim_id string, thief_id string, move_ts timestamp",
    )
    progress = telemetry.heartbeat_progress(*logs(spark), moves)
    got = {
        (r.executor_id, r.hb_seq): (r.remaining, r.stolen_by, r.stolen_from) for r in progress.collect()
    }
    assert got["A", 1] == (4, 0, 0)
    assert got["A", 2] == (5, 2, 0)
    assert got["A", 3] == (3, 2, 0)
    assert got["D", 1] == (5, 0, 0)


def test_latest_first_and_late_rows(spark):
    log = telemetry.heartbeat_progress(*logs(spark))
    latest = {r.executor_id: r.hb_seq for r in telemetry.latest_heartbeat(log).collect()}
    assert latest == {"A": 3, "B": 2, "C": 1, "D": 1}
    first = {r.executor_id: r.hb_seq for r in telemetry.first_heartbeat(log).collect()}
    assert set(first.values()) == {1}
    once = telemetry.latest_heartbeat(log)
    shuffled = once.unionByName(log.orderBy(F.desc("hb_ts")))
    assert sorted(telemetry.latest_heartbeat(shuffled).collect()) == sorted(once.collect())


def test_history(spark):
    log = telemetry.heartbeat_progress(*logs(spark))
    flat = telemetry.heartbeat_history(log)
    assert all(r.history_pos == r.hb_seq for r in flat.collect())
    paged = telemetry.heartbeat_history(log, page=2).where("executor_id = 'A'")
    pages = {r.page_no: [h.processed for h in r.history] for r in paged.collect()}
    assert pages == {0: [0, 1], 1: [3]}


def test_completion_report(spark):
    _, done, _ = logs(spark)
    report = {r.executor_id: r.total_seconds for r in telemetry.completion_report(done).collect()}
    assert report == {"A": 3.0, "B": 1.0}
    report = telemetry.completion_report(done, F.lit(START)).collect()
    assert {r.executor_id: r.total_seconds for r in report} == {"A": 4.0, "B": 2.0}


def test_refill_due(spark):
    cases = [
        (3, 9, 5, True, True, False),
        (4, 9, 5, False, False, False),
        (6, 25, 1, False, True, False),
        (0, 9, 1, True, True, True),
        (0, 9, 0, False, False, False),
    ]
    df = spark.createDataFrame(
        cases, "remaining long, batch_size long, pool_size long, sqrt boolean, third boolean, empty boolean"
    )
    for rule in ("sqrt", "third", "empty"):
        wrong = telemetry.refill_due(df, rule, "due").where(F.col("due") != F.col(rule))
        assert wrong.count() == 0
    with pytest.raises(ValueError):
        telemetry.refill_due(df, "never")


def test_ranking(spark):
    latest = telemetry.latest_heartbeat(telemetry.heartbeat_progress(*logs(spark)))
    assert [tuple(r) for r in ranking.top_remaining(latest).collect()] == [("D", 5), ("C", 3)]
    assert [tuple(r) for r in ranking.top_rate(latest).collect()] == [("A", 1.0), ("D", 0.0)]

    def victims(df, k=2):
        return {r.executor_id: r.victim for r in ranking.pick_victim(df, k).collect()}

    assert victims(latest) == {"A": "D", "B": "D", "C": "D", "D": "C"}
    assert victims(latest, 1) == {"A": "D", "B": "D", "C": "D", "D": None}
    assert victims(latest, 5) == victims(latest)
    assert victims(latest.where("executor_id = 'A'")) == {"A": None}
    assert victims(latest.where("executor_id = 'B'")) == {"B": None}


def test_ties_by_id(spark):
    latest = spark.createDataFrame(
        [(i, 7, 0.5) for i in (3, 1, 2)], "executor_id long, remaining long, avg_rate double"
    )
    assert [r.executor_id for r in ranking.top_remaining(latest).collect()] == [1, 2]
    assert [r.executor_id for r in ranking.top_rate(latest).collect()] == [3]


def test_raw_logs_are_not_sorted_for_their_extremes(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(1, t0, 1, 5), (1, t0, 2, 6), (1, t0 - dt.timedelta(days=1), 9, 7), (2, dt.datetime(1960, 1, 1), 3, 8), (2, None, 4, 9)],
        "executor_id long, hb_ts timestamp, hb_seq long, remaining long",
    )
    for pick, expected in ((telemetry.latest_heartbeat, {1: 6, 2: 8}), (telemetry.first_heartbeat, {1: 7, 2: 8})):
        chosen = pick(log)
        assert {r.executor_id: r.remaining for r in chosen.collect()} == expected
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
