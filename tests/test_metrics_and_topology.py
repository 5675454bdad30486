import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenkeel import schemas
from evenkeel.operators import shuffle_metrics, topology
from evenkeel.session import scratch_dir
from evenkeel.sources import costs, tables

DEP = "fetch_wait_ms long, local_blocks long, remote_blocks long, remote_bytes long, shuffle_finish_ms long"
DEPS = {1: [(10, 2, 3, 100, 1000), (5, 1, 0, 50, 900)], 2: [], 3: [(7, 0, 1, 10, -1)]}
MERGED = {1: (15, 3, 3, 150, 1000), 2: (0, 0, 0, 0, -1), 3: (7, 0, 1, 10, -1)}


def merged(df):
    names = ("fetch_wait_ms", "local_blocks", "remote_blocks", "remote_bytes", "shuffle_finish_ms")
    return {r.task_id: tuple(r[n] for n in names) for r in df.collect()}


def test_merge(spark):
    flat = [(task, *dep) for task, deps in DEPS.items() for dep in deps]
    deps = spark.createDataFrame(flat, f"task_id long, {DEP}")
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "task_id long")
    everything = shuffle_metrics.merge_shuffle_reads(deps, tasks)
    assert merged(everything) == MERGED
    assert merged(shuffle_metrics.merge_shuffle_reads(deps)) == {k: MERGED[k] for k in (1, 3)}
    totals = shuffle_metrics.with_total_blocks(everything)
    assert {r.task_id: r.total_blocks for r in totals.collect()} == {1: 6, 2: 0, 3: 1}
    nested = spark.createDataFrame(list(DEPS.items()), f"task_id long, deps array<struct<{DEP}>>")
    assert merged(shuffle_metrics.merge_shuffle_reads_nested(nested)) == MERGED


def test_counters_are_wide(spark):
    deps = spark.createDataFrame([(1, 0, 2**31 - 1, 2**31 - 1, 0, 5)] * 2, f"task_id long, {DEP}")
    assert merged(shuffle_metrics.merge_shuffle_reads(deps))[1][1] == 2**32 - 2


def test_enrich(spark):
    metrics = spark.createDataFrame([(1, 5), (2, 6), (9, 7)], "task_id long, run long")
    known = spark.createDataFrame([(1, "a"), (2, "b")], "task_id long, task_set_id string")
    sets = spark.createDataFrame([("a", 4, 0)], "task_set_id string, stage_id long, attempt long")
    got = shuffle_metrics.enrich_task_metrics(metrics, known, sets).collect()
    assert [(r.task_id, r.run, r.stage_id, r.attempt) for r in got] == [(1, 5, 4, 0)]


@pytest.fixture
def executors(spark):
    data = [("e1", "h1", "r1", True), ("e2", "h1", "r1", False), ("e3", "h2", None, True)]
    return spark.createDataFrame(data, "executor_id string, host string, rack string, active boolean")


def ids(spark, name, *values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_lookups(spark, executors):
    on_host = topology.executors_on_host(executors, "h1").collect()
    assert [(r.host, r.page_no, r.executor_ids) for r in on_host] == [("h1", 0, ["e1", "e2"])]
    paged = topology.executors_on_host(executors, page=1).collect()
    assert sorted((r.host, r.page_no, *r.executor_ids) for r in paged) == [
        ("h1", 0, "e1"),
        ("h1", 1, "e2"),
        ("h2", 0, "e3"),
    ]
    hosts = topology.hosts_alive(ids(spark, "host", "h1", "h3"), executors)
    assert [r.host for r in hosts.collect()] == ["h1"]
    racks = topology.racks_alive(ids(spark, "rack", "r1", "r2"), executors)
    assert [r.rack for r in racks.collect()] == ["r1"]
    alive = topology.executors_alive(ids(spark, "executor_id", "e1", "e2", "e9"), executors)
    assert [r.executor_id for r in alive.collect()] == ["e1"]
    unknown = topology.unknown_executors(ids(spark, "executor_id", "e1", "e9", "e9"), executors)
    assert [r.executor_id for r in unknown.collect()] == ["e9"]
    left = topology.drop_lost_executors(executors, ids(spark, "executor_id", "e3"))
    assert topology.hosts_alive(ids(spark, "host", "h2"), left).count() == 0
    assert topology.executors_on_host(left, "h2").count() == 0


def test_with_rack(spark, executors):
    hosts = ids(spark, "host", "h1", "h2", "h3")
    assert {r.rack for r in topology.with_rack(hosts).collect()} == {None}
    got = {r.host: r.rack for r in topology.with_rack(hosts, executors).collect()}
    assert got == {"h1": "r1", "h2": None, "h3": None}


def test_read_costs(spark):
    path = scratch_dir(spark, "costs")
    ids(spark, "value", "5", "120", "0").write.text(path)
    assert sorted(r.cost_ms for r in costs.read_costs(spark, path).collect()) == [0, 5, 120]
    path = scratch_dir(spark, "costs")
    ids(spark, "value", "5", "many").write.text(path)
    with pytest.raises(PySparkException, match="many"):
        costs.read_costs(spark, path).collect()


def test_gen_work_items(spark):
    items = costs.gen_work_items(spark, 1500, seed=3)
    assert items.dtypes == [(f.name, "bigint") for f in schemas.WORK_ITEMS]
    values = [r.cost_ms for r in items.collect()]
    assert len(values) == 1500 and min(values) >= 0 and max(values) == 199
    again = costs.gen_work_items(spark, 1500, seed=3).repartition(7)
    assert sorted((r.item_id, r.cost_ms) for r in again.collect()) == list(enumerate(values))
    counts = costs.gen_work_items(spark, 20_000, bound=10).groupBy("cost_ms").count().collect()
    assert len(counts) == 10 and all(1800 < r["count"] < 2200 for r in counts)


def test_misnamed_columns_are_an_error(spark):
    path = scratch_dir(spark, "items")
    spark.createDataFrame([(1, 2, 3, 4)], "id long, queue_id long, pos long, cost_ms long").write.parquet(path)
    with pytest.raises(ValueError, match="item_id"):
        tables.load_work_items(spark, path)


def test_read_method_domain(spark):
    method = F.when(F.col("id") == 2, "Tape").otherwise("Disk")
    metrics = spark.range(3).select(
        F.col("id").alias("task_id"), F.struct(method.alias("read_method"), F.col("id").alias("bytes_read")).alias("input")
    )
    missing = [f for f in schemas.TASK_METRICS if f.name not in metrics.columns]
    metrics = metrics.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    path = scratch_dir(spark, "metrics")
    metrics.write.parquet(path)
    loaded = tables.load_task_metrics(spark, path)
    assert loaded.schema.fieldNames() == schemas.TASK_METRICS.fieldNames()
    good = loaded.where("task_id < 2").select("input.read_method").distinct()
    assert [r.read_method for r in good.collect()] == ["Disk"]
    with pytest.raises(PySparkException, match="Tape"):
        loaded.select("input").collect()
