"""Stream progress against a walk over the log, with losses, repeats and crashes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.session import scratch_dir
from evenkeel.streaming import progress
from evenkeel.streaming.keyed_table import KeyedTable

START = dt.datetime(2024, 1, 1)
LOG = "executor_id long, hb_seq long, hb_ts timestamp, processed long"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def take_in(spark, source, target, watermark=None, run=7):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    return progress.progress_table(stream, target, watermark, buckets=4, run=run)


def reports(df):
    return sorted((r.executor_id, r.hb_seq, r.delta is None, r.delta or 0, r.gap) for r in df.collect())


def a_log(rng, executors=3, n=30, lost=0.0):
    rows = []
    for e in range(executors):
        done = 0
        for seq in range(1, n + 1):
            done += rng.randrange(5)
            if rng.random() >= lost:
                rows.append((e, seq, START + dt.timedelta(minutes=seq, seconds=e), done))
    return rows


class Walk:
    """The rules, one heartbeat at a time."""

    def __init__(self, delay=None):
        self.delay, self.newest, self.known, self.out = delay, None, {}, {}

    def batch(self, rows):
        horizon = self.newest - self.delay if self.delay and self.newest else None
        for e, seq, ts, done in rows:
            known = self.known.setdefault(e, {})
            late = horizon is not None and ts < horizon
            # What lies before a gap that was closed is not waited for.
            if not late and seq not in known and not any(a < seq < b for a, b in self.closed(e)):
                known[seq] = (ts, done)
        for e, known in self.known.items():
            for seq, (_, done) in known.items():
                if (e, seq) in self.out:
                    continue
                if seq == 1 or seq - 1 in known:
                    self.out[e, seq] = (done - (known[seq - 1][1] if seq > 1 else 0), False)
            for seq in sorted(known):
                if (e, seq) not in self.out and horizon is not None and known[seq][0] < horizon:
                    earlier = [s for s in known if s < seq]
                    delta = known[seq][1] - known[max(earlier)][1] if earlier else None
                    self.out[e, seq] = (delta, True)
        if rows:
            last = max(r[2] for r in rows)
            self.newest = max(last, self.newest or last)

    def closed(self, e):
        known = self.known[e]
        for (x, seq), (_, gap) in self.out.items():
            earlier = [s for s in known if s < seq]
            if x == e and gap and earlier:
                yield max(earlier), seq

    def reports(self):
        return sorted((e, seq, d is None, d or 0, gap) for (e, seq), (d, gap) in self.out.items())


@pytest.mark.parametrize("run", [3, 1000])
def test_shuffled_repeated_logs(spark, run):
    rng = random.Random(run)
    log = a_log(rng)
    rng.shuffle(log)
    source, target, walk = scratch_dir(spark, "in"), scratch_dir(spark, "out"), Walk()
    for k in range(0, len(log), 30):
        part = log[k : k + 30] + rng.sample(log[: k + 1], min(k, 9)) + log[k : k + 3]
        arrive(spark, source, part)
        walk.batch(part)
        assert reports(take_in(spark, source, target, run=run)) == walk.reports()
    assert len(walk.out) == len(log)
    table = KeyedTable(spark, f"{target}/segments", progress._STATE, ["executor_id"], ["version"], 4)
    assert {(r.executor_id, r.n) for r in table.read().select("executor_id", F.size("segments").alias("n")).collect()} == {
        (0, 1), (1, 1), (2, 1)
    }


@pytest.mark.parametrize("seed", range(3))
def test_losses_with_a_watermark(spark, seed):
    rng = random.Random(seed)
    log = a_log(rng, n=40, lost=0.15)
    log.sort(key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(9)))
    source, target, walk = scratch_dir(spark, "in"), scratch_dir(spark, "out"), Walk(dt.timedelta(minutes=5))
    for k in range(0, len(log), 25):
        part = log[k : k + 25] + log[max(0, k - 2) : k]
        arrive(spark, source, part)
        walk.batch(part)
        got = take_in(spark, source, target, "5 minutes")
    assert reports(got) == walk.reports()
    assert any(gap for *_, gap in walk.reports())


@pytest.mark.parametrize("step", ["_write", "_publish", "_clean"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_that_breaks_off_reports_once(spark, monkeypatch, step, when):
    rng = random.Random(f"{step}{when}")
    log = a_log(rng, n=20)
    rng.shuffle(log)
    source, target, walk = scratch_dir(spark, "in"), scratch_dir(spark, "out"), Walk()
    real, broken = getattr(KeyedTable, step), []

    def once(self, *args):
        if when == "after":
            real(self, *args)
        if not broken:
            broken.append(step)
            raise RuntimeError("broken off")
        if when == "before":
            real(self, *args)

    for k in range(0, len(log), 20):
        arrive(spark, source, log[k : k + 20])
        walk.batch(log[k : k + 20])
        if k == 20:
            with monkeypatch.context() as patch:
                patch.setattr(KeyedTable, step, once)
                with pytest.raises(Exception, match="broken off"):
                    take_in(spark, source, target)
    assert reports(take_in(spark, source, target)) == walk.reports() and len(walk.out) == len(log)


def test_no_python_worker_and_no_rows(spark):
    rows = spark.createDataFrame([], LOG)
    segments = spark.createDataFrame([], progress._SEGMENT).withColumn("executor_id", F.lit(1).cast("long"))
    found, after = progress.advance(rows, segments, F.lit(START))
    assert found.count() == after.count() == 0
    for df in (found, after):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    source = scratch_dir(spark, "in")
    rows.write.parquet(source)
    assert take_in(spark, source, scratch_dir(spark, "out")).count() == 0


def test_null_and_odd_numbers_do_not_count(spark):
    source, target = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    arrive(spark, source, [(1, None, START, 5), (1, 0, START, 5), (1, 1, START, 4), (1, -3, START, 1), (1, 2, START, None)])
    assert reports(take_in(spark, source, target)) == [(1, 1, False, 4, False), (1, 2, True, 0, False)]
