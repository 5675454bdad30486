"""Tables that streams keep up to date: after every batch as a batch job would have them, and after crashes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import ranking, shuffle_metrics, telemetry
from evenkeel.plans import catalog
from evenkeel.session import scratch_dir
from evenkeel.streaming import heartbeats as live
from evenkeel.streaming.keyed_table import KeyedTable

START = dt.datetime(2024, 1, 1)
LOG = "executor_id long, hb_ts timestamp, hb_seq long, remaining long, gone boolean"
DEPS = (
    "task_id long, dep_id long, fetch_wait_ms long, local_blocks long, remote_blocks long, remote_bytes long, "
    "shuffle_finish_ms long, update_seq long"
)


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def beats(rng, n, executors=12):
    out = []
    for _ in range(n):
        e, seq = rng.randrange(executors), rng.randint(1, 40)
        out.append((e, START + dt.timedelta(minutes=seq), seq, rng.choice([0, 0, 5, rng.randrange(1000)]), rng.random() < 0.1))
    # One record for each number of an executor, as in a log.
    return list({r[:3]: r for r in out}.values())


class Broken(Exception):
    pass


def breaking(monkeypatch, step, when):
    """The step of a merge fails once, before or after it is done."""
    real, left = getattr(KeyedTable, step), [True]

    def once(self, *args):
        if when == "after":
            real(self, *args)
        if left:
            left.pop()
            raise Broken(step)
        if when == "before":
            real(self, *args)

    monkeypatch.setattr(KeyedTable, step, once)


@pytest.mark.parametrize("step", ["_write", "_publish", "_clean"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_merge_that_breaks_off_keeps_every_executor(spark, rows, monkeypatch, step, when):
    rng = random.Random(f"{step}{when}")
    source, target = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    log = LOG.rpartition(",")[0]
    seen = []
    for k in range(3):
        seen += [r[:4] for r in beats(rng, 15)]
        arrive(spark, source, seen[-15:] if k else seen, log)
        if k == 1:
            with monkeypatch.context() as patch:
                breaking(patch, step, when)
                with pytest.raises(Exception, match="Broken"):
                    live.latest_table(stream(spark, source, log), target, buckets=4)
            table = KeyedTable(spark, f"{target}/table", stream(spark, source, log).schema, ["executor_id"], ["hb_ts", "hb_seq"], 4)
            assert table.read().count() >= before  # whatever is published is whole
        latest = live.latest_table(stream(spark, source, log), target, buckets=4)
        expected = telemetry.latest_heartbeat(spark.read.schema(log).parquet(source))
        assert rows(latest) == rows(expected.select(*latest.columns))
        before = latest.count()


def test_half_written_files_are_not_read(spark, rows):
    """Folders and lists that were never published, as a lost driver leaves them."""
    source, target = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    arrive(spark, source, beats(random.Random(1), 20), LOG)
    latest = live.latest_table(stream(spark, source, LOG), target, buckets=4)
    whole = rows(latest)
    spark.createDataFrame([(99, START, 1, 1, False)], LOG).write.parquet(f"{target}/table/data/batch=1/bucket=0/_temporary/x")
    spark.createDataFrame([(98, START, 1, 1, False)], LOG).write.parquet(f"{target}/table/data/batch=1/bucket=2")
    table = KeyedTable(spark, f"{target}/table", latest.schema, ["executor_id"], ["hb_ts", "hb_seq"], 4)
    table._folder().write_aside("lists/1.json.part", '{"batch": 1, "fold')
    assert rows(live.latest_table(stream(spark, source, LOG), target, buckets=4)) == whole
    arrive(spark, source, [(97, START, 1, 1, False)], LOG)
    ids = [r[0] for r in rows(live.latest_table(stream(spark, source, LOG), target, buckets=4))]
    assert 97 in ids and 98 not in ids and 99 not in ids and len(ids) == len(whole) + 1


def test_only_changed_buckets_are_written(spark):
    path = scratch_dir(spark, "table")
    every = spark.range(100).select("id", F.lit(1).cast("long").alias("v"), F.lit("x").alias("s"))
    table = KeyedTable(spark, path, every.schema, ["id"], ["v"], 8)
    table.merge(every, 0)
    table.merge(spark.createDataFrame([(7, 2, "y"), (7, 0, "z"), (7, 2, "a")], "id long, v long, s string"), 1)
    folders = table.current()["data"]
    assert sorted(folders.values()) == [0] * 7 + [1]
    assert {(r.v, r.s) for r in table.read().where("id = 7").collect()} == {(2, "y")}
    table.merge(every.limit(0), 2)
    table.merge(every.withColumn("v", F.lit(5).cast("long")), 1)  # is in already
    assert table.read().agg(F.sum("v")).first()[0] == 101
    for k in range(3, 6):
        table.merge(every.withColumn("v", F.lit(k).cast("long")), k)
    assert table._folder().names("data") == ["batch=4", "batch=5"]
    assert table._folder().names("lists") == ["4.json", "5.json"]


def test_best_are_those_of_the_batch_job_after_every_batch(spark, rows):
    """Work grows and falls, records come late and twice, executors leave."""
    rng = random.Random(3)
    source, target = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    log = beats(rng, 60)
    sizes = set()
    for k in range(0, len(log), 9):
        arrive(spark, source, log[k : k + 9] + log[:2], LOG)
        top, latest = live.top_table(stream(spark, source, LOG), target, k=3, buckets=4)
        batch = telemetry.latest_heartbeat(spark.read.schema(LOG).parquet(source).distinct()).where("NOT gone")
        expected = ranking.top_remaining(batch, 3)
        assert [tuple(r) for r in top.collect()] == [tuple(r) for r in expected.collect()]
        sizes.add(latest.count())
    assert len(sizes) > 1
    picked = ranking.pick_victim(latest.where("NOT gone"))
    assert rows(picked) == rows(ranking.pick_victim(batch))


def test_merged_reads_of_late_repeated_and_corrected_records(spark, rows):
    rng = random.Random(5)
    source, target = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    log = []
    for seq in range(90):
        finish = rng.choice([-1, None, rng.randrange(500)])
        log.append((rng.randrange(6), rng.randrange(3), *(rng.choice([None, 0, rng.randrange(9)]) for _ in range(4)), finish, seq))
    rng.shuffle(log)
    for k in range(0, 90, 30):
        arrive(spark, source, log[k : k + 30] + log[: k // 2], DEPS)
        merged = live.merged_reads_table(stream(spark, source, DEPS), target, buckets=4)
        newest = {}
        for r in sorted(log[: k + 30], key=lambda r: r[-1]):
            newest[r[:2]] = r
        batch = shuffle_metrics.merge_shuffle_reads(spark.createDataFrame(list(newest.values()), DEPS))
        assert rows(merged.select(*batch.columns)) == rows(batch)


def test_a_sender_is_reported_until_it_registers(spark):
    source, target, known = (scratch_dir(spark, x) for x in ("in", "out", "known"))
    arrive(spark, known, [(1,)], "executor_id long")

    def run(*senders):
        arrive(spark, source, [(e, START, 1, 1, False) for e in senders], LOG)
        found = live.unknown_senders(stream(spark, source, LOG), lambda: spark.read.parquet(known), target)
        return sorted((r.batch, r.executor_id) for r in found.collect())

    assert run(1, 2, 2, 3) == [(0, 2), (0, 3)]
    arrive(spark, known, [(2,)], "executor_id long")
    assert run(2, 3) == [(0, 2), (0, 3), (1, 3)]
    arrive(spark, known, [(3,)], "executor_id long")
    assert run(1, 2, 3) == [(0, 2), (0, 3), (1, 3)]


def test_metrics_meet_the_tasks_of_their_time(spark):
    source, target, tasks, sets = (scratch_dir(spark, x) for x in ("in", "out", "tasks", "sets"))
    arrive(spark, tasks, [(10, 1)], "task_id long, task_set_id long")
    arrive(spark, sets, [(1, 4, 0)], "task_set_id long, stage_id long, attempt long")

    def run(*ids):
        arrive(spark, source, [(i, 7) for i in ids], "task_id long, run_ms long")
        found = live.enriched_metrics(
            stream(spark, source, "task_id long, run_ms long"),
            lambda: spark.read.parquet(tasks), lambda: spark.read.parquet(sets), target,
        )
        return sorted((r.batch, r.task_id, r.stage_id) for r in found.collect())

    assert run(10, 11) == [(0, 10, 4)]
    arrive(spark, tasks, [(11, 1)], "task_id long, task_set_id long")
    assert run(10, 11) == [(0, 10, 4), (1, 10, 4), (1, 11, 4)]


def test_nothing_has_come_yet(spark):
    source = scratch_dir(spark, "in")
    spark.createDataFrame([], LOG).write.parquet(source)
    top, latest = live.top_table(stream(spark, source, LOG), scratch_dir(spark, "out"))
    assert top.count() == latest.count() == 0
    known = spark.createDataFrame([], "executor_id long")
    assert live.unknown_senders(stream(spark, source, LOG), lambda: known, scratch_dir(spark, "out")).count() == 0
    deps = scratch_dir(spark, "deps")
    spark.createDataFrame([], DEPS).write.parquet(deps)
    assert live.merged_reads_table(stream(spark, deps, DEPS), scratch_dir(spark, "out")).count() == 0


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, rows):
    table = KeyedTable(spark, str(tmp_path), spark.createDataFrame([], "k long, v long").schema, ["k"], ["v"], 1)
    small = {"advisoryPartitionSizeInBytes": "4k", "coalescePartitions.minPartitionSize": "4k"}
    before = {f"spark.sql.adaptive.{k}": spark.conf.get(f"spark.sql.adaptive.{k}") for k in small}
    for name, value in small.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        table.merge(spark.range(20_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v")), 0)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list(tmp_path.glob("data/batch=0/bucket=0/*.parquet"))) > 1
    assert table.read().count() == table.read().distinct().count() == 20_000


def test_a_part_of_a_large_stream_has_several_files(spark, monkeypatch, rows):
    paths, written = [], catalog._written
    monkeypatch.setattr(catalog, "_FILE_BYTES", 10_000, raising=False)
    monkeypatch.setattr(catalog, "_written", lambda *args: paths.append(written(*args)) or paths[-1])
    folder = "/root/testdata/sf0.001"
    merged = rows(catalog.QUERIES["stream_merged_reads"](spark, folder))
    assert merged == rows(catalog.QUERIES["merge_shuffle_reads"](spark, folder))
    assert len(spark.read.parquet(paths[0]).inputFiles()) > 3
