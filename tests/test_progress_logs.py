"""Progress carried on from saved totals, and the items that each heartbeat reports."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import telemetry
from evenkeel.session import stored

START = dt.datetime(2024, 3, 1)


def a_log(spark, seed: int, n: int = 300):
    """(assigned, completions, heartbeats, moves) over four executors, one with most of the log."""
    rng = random.Random(seed)
    times = [START + dt.timedelta(seconds=k) for k in range(n)]
    who = [rng.choice([1, 1, 1, 1, 2, 3, 4]) for _ in times]
    kind = [rng.choice("hhccm") for _ in times]
    done = [(100 + k, w, t) for k, (w, t, x) in enumerate(zip(who, times, kind)) if x == "c"]
    beats = [(w, t) for w, t, x in zip(who, times, kind) if x == "h"]
    moves = [(w % 4 + 1, w, t) for w, t, x in zip(who, times, kind) if x == "m"]
    return (
        spark.createDataFrame([(w, 500) for w in (1, 2, 3, 4, 5)], "executor_id long, assigned long"),
        spark.createDataFrame(done, "item_id long, executor_id long, finish_ts timestamp"),
        spark.createDataFrame(beats, "executor_id long, hb_ts timestamp"),
        spark.createDataFrame(moves, "victim_id long, thief_id long, move_ts timestamp"),
    )


def part(log, since: int, until: int):
    """What the logs have from second `since` to before `until`; items are assigned at the start."""
    assigned, done, beats, moves = log

    def between(df, column):
        low, high = (F.lit(START + dt.timedelta(seconds=s)) for s in (since, until))
        return df.where((F.col(column) >= low) & (F.col(column) < high))

    given = assigned if since == 0 < until else assigned.limit(0)
    return given, between(done, "finish_ts"), between(beats, "hb_ts"), between(moves, "move_ts")


@pytest.mark.parametrize("cuts", [[0, 150, 300], [0, 1, 2, 90, 299, 300], [0, 0, 300, 400]])
@pytest.mark.parametrize("rows_per_block", [None, 20])
def test_parts_give_the_rows_of_the_whole(spark, rows, cuts, rows_per_block):
    log = a_log(spark, 4)
    whole = telemetry.heartbeat_progress(*log, rows_per_block=rows_per_block)
    found, totals = None, None
    for since, until in zip(cuts, cuts[1:]):
        logs = part(log, since, until)
        new = telemetry.heartbeat_progress(*logs, carried=totals, rows_per_block=rows_per_block)
        found = new if found is None else found.unionByName(new)
        totals = stored(telemetry.progress_totals(*logs, carried=totals, rows_per_block=rows_per_block), "totals")
    assert rows(found) == rows(whole)
    assert rows(totals) == rows(telemetry.progress_totals(*log).select(totals.columns))


def test_later_parts_do_not_read_earlier_logs(spark, tmp_path):
    log, paths = a_log(spark, 5), {}
    for name, (since, until) in {"old": (0, 200), "new": (200, 300)}.items():
        paths[name] = [f"{tmp_path}/{name}-{k}" for k in range(4)]
        for df, path in zip(part(log, since, until), paths[name]):
            df.write.parquet(path)
    old, new = ([spark.read.parquet(p) for p in paths[name]] for name in ("old", "new"))
    totals = stored(telemetry.progress_totals(*old), "totals")
    second = telemetry.heartbeat_progress(*new, carried=totals)
    assert second.count() == part(log, 200, 300)[2].count()
    assert not [f for f in second.inputFiles() if "/old-" in f]
    assert [f for f in second.inputFiles() if "/new-2" in f]


def test_totals_without_heartbeats(spark):
    assigned, done, beats, _ = a_log(spark, 6)
    totals = telemetry.progress_totals(assigned, done, beats.limit(0))
    assert {(r.hb_seq, r.processed_reported, r.stolen_by) for r in totals.collect()} == {(0, 0, 0)}
    first = telemetry.heartbeat_progress(assigned.limit(0), done.limit(0), beats, carried=totals)
    start = {r.executor_id: r.delta for r in first.where("hb_seq = 1").collect()}
    assert start == {r.executor_id: r["count"] for r in done.groupBy("executor_id").count().collect()}


def expected_reports(done, beats):
    """hb_seq and place of each item, by walking each executor's log."""
    out, steps = {}, {}
    for r in done.collect():
        steps.setdefault(r.executor_id, []).append((r.finish_ts, 1, r.item_id))
    for r in beats.collect():
        steps.setdefault(r.executor_id, []).append((r.hb_ts, 0, None))
    for executor, log in steps.items():
        seq, waiting = 0, []
        for _, is_done, item in sorted(log, key=lambda x: x[:2]):
            if is_done:
                waiting.append(item)
                continue
            seq += 1
            out |= {item: (executor, seq, k) for k, item in enumerate(waiting, 1)}
            waiting = []
        out |= {item: (executor, None, k) for k, item in enumerate(waiting, 1)}
    return out


@pytest.mark.parametrize("rows_per_block", [None, 1, 30])
def test_items_are_matched_with_the_next_heartbeat(spark, rows_per_block):
    _, done, beats, _ = a_log(spark, 7)
    reported = telemetry.reported_items(done, beats, rows_per_block=rows_per_block)
    got = {r.item_id: (r.executor_id, r.hb_seq, r.place) for r in reported.collect()}
    assert got == expected_reports(done, beats)


@pytest.mark.parametrize("page", [1, 2, 1000])
def test_ids_of_all_heartbeats_are_the_completions(spark, page):
    assigned, done, beats, _ = a_log(spark, 8)
    reported = telemetry.reported_items(done, beats)
    pages = telemetry.processed_ids(reported, page).collect()
    assert max(len(r.processed_ids) for r in pages) <= page
    listed = sorted((r.executor_id, i) for r in pages for i in r.processed_ids)
    assert listed == sorted((r.executor_id, r.item_id) for r in done.collect())
    sizes = {}
    for r in pages:
        sizes[r.executor_id, r.hb_seq] = sizes.get((r.executor_id, r.hb_seq), 0) + len(r.processed_ids)
    for r in telemetry.heartbeat_progress(assigned, done, beats).collect():
        assert sizes.get((r.executor_id, r.hb_seq), 0) == r.delta


def test_remaining_ids_are_those_not_yet_processed(spark):
    assigned, done, beats, _ = a_log(spark, 9)
    items = done.select("item_id", "executor_id").union(spark.createDataFrame([(k, 2) for k in range(5)], "i long, e long"))
    counts = items.groupBy("executor_id").agg(F.count("*").alias("assigned"))
    progress = telemetry.heartbeat_progress(counts, done, beats)
    reported = telemetry.reported_items(done, beats)
    pages = telemetry.remaining_ids(items, reported, progress.select("executor_id", "hb_seq"), page=7, rows_per_block=50).collect()
    listed = {}
    for r in pages:
        listed.setdefault((r.executor_id, r.hb_seq), []).extend(r.remaining_ids)
    known = expected_reports(done, beats)
    for r in progress.collect():
        ids = listed.get((r.executor_id, r.hb_seq), [])
        assert len(ids) == len(set(ids)) == r.remaining
        assert all(known.get(i, (0, None))[1] is None or known[i][1] > r.hb_seq for i in ids)
