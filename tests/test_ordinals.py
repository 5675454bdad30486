import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.functions.search import rank_among, with_rank_among
from evenkeel.operators import ordinals

SCHEMA = "key long, name string, time timestamp, seq long, step long, mark boolean"


def table(n, seed=1, hot=0.4):
    """Rows with one hot key, null keys, and equal times."""
    pick = random.Random(seed)
    keys = lambda: 1 if pick.random() < hot else pick.choice([None, *range(n // 20 + 2)])
    start = dt.datetime(2024, 1, 1)
    data = [
        (
            keys(),
            pick.choice(["x", "y", None]),
            start + dt.timedelta(microseconds=pick.randrange(n // 3 + 1)),
            i,
            pick.randrange(3),
            pick.random() < 0.3,
        )
        for i in range(n)
    ]
    pick.shuffle(data)
    return data


def reference(data, keys):
    """The same by a plain loop."""
    names = SCHEMA.replace(" long", "").replace(" string", "").replace(" timestamp", "")
    names = names.replace(" boolean", "").split(", ")
    state, out = {}, {}
    for row in sorted(data, key=lambda r: (r[2], r[3])):
        record = dict(zip(names, row))
        key = tuple(record[k] for k in keys)
        count, total, at_mark = state.get(key, (0, 0, None))
        count, total = count + 1, total + record["step"]
        out[record["seq"]] = (key, count, total, at_mark)
        state[key] = (count, total, total if record["mark"] else at_mark)
    return {
        seq: (count, total, at_mark, state[key][0]) for seq, (key, count, total, at_mark) in out.items()
    }


@pytest.mark.parametrize("keys", [["key"], ["key", "name"]])
@pytest.mark.parametrize("rows_per_block", [None, 7, 60, 10_000])
def test_running_totals(spark, keys, rows_per_block):
    data = table(700)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    result = ordinals.running_totals(
        df,
        keys,
        ["time", "seq"],
        totals={"count": F.lit(1), "total": F.col("step")},
        at_last={"at_mark": ("total", F.col("mark"))},
        finals={"size": "count"},
        rows_per_block=rows_per_block,
    )
    got = {r.seq: (r["count"], r.total, r.at_mark, r.size) for r in result.collect()}
    assert got == reference(data, keys)


@pytest.mark.parametrize("keys", [[], ["key"], ["key", "name"]])
def test_running_totals_in_many_blocks(spark, keys, monkeypatch):
    """More blocks than ranges: only the bounds of the ranges are constants of the plan."""
    constants, constant_array = [], ordinals._constant_array
    monkeypatch.setattr(ordinals, "CUT_FANOUT", 6, raising=False)
    monkeypatch.setattr(ordinals, "_constant_array", lambda t: constants.append(t.count()) or constant_array(t))
    data = table(500)
    order = ["time", "seq"] if keys else ["seq"]
    result = ordinals.running_totals(
        spark.createDataFrame(data, SCHEMA).repartition(5),
        keys,
        order,
        totals={"count": F.lit(1), "total": F.col("step")},
        at_last={"at_mark": ("total", F.col("mark"))},
        finals={"size": "count"},
        rows_per_block=7,
    )
    got = {r.seq: (r["count"], r.total, r.at_mark, r.size) for r in result.collect()}
    by_seq = [(*r[:2], dt.datetime(2024, 1, 1), *r[3:]) for r in data]
    assert got == reference(data if keys else by_seq, keys)
    assert constants and max(constants) < 6


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 300), st.integers(1, 50), st.integers(0, 10**6))
def test_running_totals_any_cut(spark, n, rows_per_block, seed):
    data = table(n, seed)
    df = spark.createDataFrame(data, SCHEMA)
    result = ordinals.running_totals(
        df, ["key"], ["time", "seq"], {"count": F.lit(1)}, finals={"size": "count"},
        rows_per_block=rows_per_block,
    )
    expected = {seq: (v[0], v[3]) for seq, v in reference(data, ["key"]).items()}
    assert {r.seq: (r["count"], r.size) for r in result.collect()} == expected


@pytest.mark.parametrize("rows_per_block", [None, 9, 100])
@pytest.mark.parametrize("order", [["seq"], ["time", "seq"], ["name", "time", "seq"]])
def test_assign_ids(spark, order, rows_per_block):
    df = spark.createDataFrame(table(400), SCHEMA).repartition(3)
    result = ordinals.assign_ids(df, order, start=5, rows_per_block=rows_per_block)
    by_id = sorted(result.collect(), key=lambda r: r.id)
    assert [r.id for r in by_id] == list(range(5, 405))
    place = [[(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in order] for r in by_id]
    assert place == sorted(place)


def test_numbered_range_reads_only_its_blocks(spark):
    df = spark.range(1000)
    order = ordinals.GlobalOrder(df, ["id"], rows_per_block=50)
    assert order.count == 1000
    part = order.numbered("ord", 100, 320)
    assert sorted(r.ord for r in part.collect()) == list(range(100, 320))
    assert all(r.ord == r.id for r in part.collect())
    assert order.numbered("ord", 5, 5).count() == 0


@pytest.mark.parametrize("fanout", [2, 4, 30])
@pytest.mark.parametrize("order", [["seq"], ["time", "seq"], ["name", "time", "seq"]])
def test_nested_blocks(spark, order, fanout):
    """More blocks than ranges: every range is cut again, and positions stay dense and in order."""
    df = spark.createDataFrame(table(400), SCHEMA).repartition(3)
    cut = ordinals.GlobalOrder(df, order, rows_per_block=9, fanout=fanout)
    assert cut._nested and len(cut._starts) <= fanout and cut.count == 400
    assert cut._inner.count() > fanout
    rows = sorted(cut.numbered("ord").collect(), key=lambda r: r.ord)
    assert [r.ord for r in rows] == list(range(400))
    place = [[(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in order] for r in rows]
    assert place == sorted(place)
    seqs = [r.seq for r in rows]
    for low, high in ((0, 1), (37, 222), (399, 400), (10, 10)):
        assert sorted(r.seq for r in cut.numbered("ord", low, high).collect()) == sorted(seqs[low:high])
        assert sorted(r.seq for r in cut.beyond(low).collect()) == sorted(seqs[low:])


@pytest.mark.parametrize("rows_per_block", [None, 9, 100])
def test_beyond(spark, rows_per_block):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    cut = ordinals.GlobalOrder(df, ["x"], rows_per_block)
    for low in (0, 1, 99, 100, 101, 499, 500):
        assert sorted(r.x for r in cut.beyond(low).collect()) == list(range(low, 500))


def test_equal_order_values_and_nulls_in_nested_blocks(spark):
    rows = [(None,)] * 30 + [(5,)] * 300 + [(k,) for k in range(100)]
    cut = ordinals.GlobalOrder(spark.createDataFrame(rows, "x long"), ["x"], rows_per_block=10, fanout=3)
    got = sorted((r.ord, r.x) for r in cut.numbered("ord").collect())
    assert [o for o, _ in got] == list(range(430))
    assert [x for _, x in got] == [None] * 30 + sorted(x for x, in rows[30:])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ordinals.assign_ids(df, ["seq"]).collect() == []
    assert ordinals.running_totals(df, ["key"], ["seq"], {"c": F.lit(1)}, rows_per_block=1).collect() == []


@pytest.mark.parametrize("size", [0, 1, 2, 5, 8, 13])
def test_rank_among(spark, size):
    bounds = [10 * i for i in range(1, size + 1)]
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    df = with_rank_among(spark.range(0, 160), "rank", F.col("id"), array, size)
    assert all(r["rank"] == sum(b <= r.id for b in bounds) for r in df.collect())


def test_size_estimate_is_there(spark):
    path = "/root/testdata/sf0.001/orders.parquet"
    assert 0 < ordinals.estimated_bytes(spark.read.parquet(path)) < ordinals.ONE_TASK_BYTES


@pytest.mark.parametrize("size", [0, 1, 2, 5, 8, 13])
def test_rank_by_tree(spark, size):
    bounds = [10 * i for i in range(1, size + 1)]
    df = spark.range(0, 160).select("id", rank_among(F.col("id"), bounds).alias("rank"))
    assert all(r["rank"] == sum(b <= r.id for b in bounds) for r in df.collect())


def test_draw_is_a_range_of_the_scan(spark):
    """Only the blocks that are needed are read: the bound reaches the scan as a simple comparison."""
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey")
    part = ordinals.GlobalOrder(orders, ["o_orderkey"], rows_per_block=1000).numbered("ord", 0, 1500)
    assert sorted(r.ord for r in part.collect()) == list(range(1500))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderkey" in plan


@pytest.mark.parametrize("hot, blocks", [(0.0, False), (0.5, True)])
def test_only_a_hot_key_is_cut(spark, monkeypatch, hot, blocks):
    """Where no key is hot, a large input takes the plain window; either way the result is the same."""
    monkeypatch.setattr(ordinals, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(ordinals, "ONE_TASK_BYTES", 0)
    data = table(2000, hot=hot)
    df = spark.createDataFrame(data, SCHEMA)
    result = ordinals.running_totals(df, ["key"], ["time", "seq"], {"count": F.lit(1)})
    assert ("_block" in result._jdf.queryExecution().analyzed().toString()) == blocks
    expected = {seq: v[0] for seq, v in reference(data, ["key"]).items()}
    assert {r.seq: r["count"] for r in result.collect()} == expected
