import random

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.sizing import split_size
from evenkeel.operators import rebalance
from evenkeel.plans import flows

ITEMS = "item_id long, queue_id long, pos long, cost_ms long"


def queue(spark, *queues):
    """`queues` are (queue_id, item ids in order)."""
    data = [(item, q, pos + 1, 10) for q, items in queues for pos, item in enumerate(items)]
    return spark.createDataFrame(data, ITEMS)


def contents(df):
    queues = {}
    for r in sorted(df.collect(), key=lambda r: (r.queue_id is None, r.queue_id, r.pos)):
        queues.setdefault(r.queue_id, []).append((r.pos, r.item_id))
    for items in queues.values():
        assert [pos for pos, _ in items] == list(range(1, len(items) + 1))
    return {q: [item for _, item in items] for q, items in queues.items()}


def taken_by_loop(n, keep_on, max_items=None):
    taken = 0
    while n > 0 and (max_items is None or taken < max_items) and keep_on(n - taken, taken):
        taken += 1
    return taken


@pytest.mark.parametrize("max_items", [None, 0, 1, 5, 40])
def test_split_size_is_the_loop(spark, max_items):
    rules = {"quarter": lambda rest, taken: rest >= 3 * taken, "square": lambda rest, taken: rest >= taken**2}
    df = spark.range(0, 700).select(
        "id", *[split_size(F.col("id"), rule, max_items).alias(rule) for rule in rules]
    )
    for row in df.collect():
        for rule, keep_on in rules.items():
            assert row[rule] == taken_by_loop(row.id, keep_on, max_items), (rule, row.id)


def test_split_sizes_golden(spark):
    n = [0, 1, 2, 3, 4, 5, 7, 8, 10, 12, 100]
    golden = {
        "quarter": [0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 26],
        "square": [0, 1, 2, 2, 2, 2, 3, 3, 3, 4, 10],
        "one": [0] + [1] * 10,
    }
    df = spark.createDataFrame([(i,) for i in n], "n long")
    for rule, sizes in golden.items():
        got = {r.n: r.k for r in df.select("n", split_size(F.col("n"), rule).alias("k")).collect()}
        assert [got[i] for i in n] == sizes
    with pytest.raises(ValueError):
        split_size(F.col("n"), "half")


@pytest.mark.parametrize("rows_per_block", [None, 2])
def test_split_head(spark, rows_per_block):
    items = queue(
        spark, (1, [1, 2, 3, 4, 5, 6, 7, 8]), (2, [9])
    )
    got = {
        r.item_id: (r.status, r.batch_pos)
        for r in rebalance.split_head(items, rows_per_block=rows_per_block).collect()
    }
    assert [got[i] for i in (1, 2, 3)] == [("moved", 3), ("moved", 2), ("moved", 1)]
    assert {got[i] for i in range(4, 9)} == {("kept", None)}
    assert got[9] == ("pending", 1)
    capped = {
        r.item_id: (r.status, r.batch_pos)
        for r in rebalance.split_head(items, max_items=2, rows_per_block=rows_per_block).collect()
    }
    assert [capped[i] for i in (1, 2, 3)] == [("moved", 2), ("moved", 1), ("kept", None)]
    square = rebalance.split_head(queue(spark, (1, [1, 2])), "square", rows_per_block=rows_per_block)
    assert {r.status for r in square.collect()} == {"pending"}


@pytest.mark.parametrize("n, sizes", [(10, [3, 2, 2, 1, 1, 1]), (100, [26, 19, 14, 11, 8, 6, 5, 3, 3, 2, 1, 1, 1])])
@pytest.mark.parametrize("rows_per_block", [None, 7])
def test_guided_chunks(spark, n, sizes, rows_per_block):
    pool = spark.range(n).select((F.col("id") * 3).alias("item_id"), F.lit(5).alias("cost_ms"))
    rows = rebalance.guided_chunks(pool, rows_per_block=rows_per_block).collect()
    chunks = {}
    for r in sorted(rows, key=lambda r: r.item_id):
        chunks.setdefault(r.chunk_id, []).append(r.batch_pos)
    assert [len(chunks[i + 1]) for i in range(len(sizes))] == sizes
    assert all(places == list(range(len(places), 0, -1)) for places in chunks.values())


def test_chunk_starts():
    for n in [*range(200), 1491, 10**9, 10**13]:
        starts = rebalance.chunk_starts(n)
        sizes = [b - a for a, b in zip(starts, starts[1:])]
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True)
    assert len(rebalance.chunk_starts(1491)) - 1 == 22
    assert len(rebalance.chunk_starts(10**13)) - 1 == 101


@pytest.mark.parametrize("rows_per_block", [None, 7])
def test_draw_from_pool(spark, rows_per_block):
    pool = spark.range(100).select(F.col("id").alias("item_id"))

    def draw(*args):
        rows = rebalance.draw_from_pool(pool, *args, rows_per_block=rows_per_block).collect()
        return [r.item_id for r in sorted(rows, key=lambda r: r.batch_pos)]

    assert draw() == list(range(25, -1, -1))
    assert draw("one") == [0]
    assert draw("quarter", True) == list(range(74, 100))
    assert draw("one", True) == [99]
    assert rebalance.draw_from_pool(pool.where("item_id < 0")).count() == 0


def test_draw_keeps_the_rest(spark):
    pool = spark.range(100).select(F.col("id").alias("item_id"))
    for policy, tail, taken in (("quarter", False, range(26)), ("one", True, [99]), ("quarter", True, range(74, 100))):
        rows = rebalance.draw_from_pool(pool, policy, tail, keep_rest=True).collect()
        assert sorted(r.item_id for r in rows) == list(range(100))
        assert sorted(r.item_id for r in rows if r.status == "taken") == list(taken)
        assert all((r.batch_pos is None) == (r.status == "left") for r in rows)


@pytest.mark.parametrize("rows_per_block", [None, 4])
def test_deal_initial(spark, rows_per_block):
    pool = spark.range(20).select((F.col("id") * 2).alias("item_id"))
    rows = rebalance.deal_initial(pool, 3, 3, rows_per_block).collect()
    dealt = {r.item_id: r.executor_id for r in rows}
    assert [dealt[2 * i] for i in range(20)] == [1, 1, 1, 2, 2, 2, 3, 3, 3] + [None] * 11


@pytest.mark.parametrize("k", [1, 2, 5])
def test_deal_keeps_equal_ids_apart(spark, k):
    pool = spark.createDataFrame([(1,), (1,), (2,), (3,)], "item_id long")
    for dealt in (rebalance.deal_initial(pool, 1, k), rebalance.deal_and_chunk(pool, 1, k)):
        rows = dealt.collect()
        assert sorted(r.item_id for r in rows) == [1, 1, 2, 3]
        assert [r.executor_id for r in sorted(rows, key=lambda r: r.item_id)].count(1) == min(k, 4)


def test_pool_rows_are_in_no_queue(spark):
    items = queue(spark, (1, [9, 8, 7]), (None, [3, 4, 5]))
    assert {r.queue_id for r in rebalance.queue_sizes(items).collect()} == {1}
    assert {r.queue_id for r in rebalance.queue_heads(items).collect()} == {1}
    assert {r.queue_id for r in rebalance.split_head(items).collect()} == {1}
    kept = rebalance.take_fraction(items, keep_rest=True).collect()
    assert sorted((r.item_id, r.status) for r in kept) == [(7, "left"), (8, "left"), (9, "taken")]
    moves = spark.createDataFrame([(1, 2)], "victim_id long, thief_id long")
    after = contents(rebalance.steal_move(items, moves))
    assert after == {1: [8, 7], 2: [9], None: [3, 4, 5]}


def test_heads_of_equal_places(spark):
    items = spark.createDataFrame([(5, 1, 1, 50), (4, 1, 1, 40), (6, 1, 2, 60)], ITEMS)
    head = rebalance.queue_heads(items).first()
    split = rebalance.split_head(items).where("status = 'moved'").first()
    assert head.item_id == split.item_id == 4 and head.cost_ms == 40


def test_refill_round(spark):
    items = queue(spark, (1, [100, 101]), (2, [102]), (3, [103] + list(range(110, 120))))
    pool = spark.range(10).select(F.col("id").alias("item_id"), F.lit(1).cast("long").alias("cost_ms"))
    state = spark.createDataFrame([(1, 2, 9), (2, 1, 4), (3, 11, 12), (4, 0, 5)], "executor_id long, remaining long, batch_size long")
    queues, rest = flows.refill_round(state, items, pool)
    after = contents(queues)
    assert after[1] == [100, 101, 2, 1, 0] and after[2] == [102, 4, 3] and after[4] == [6, 5]
    assert after[3] == [103, *range(110, 120)]
    assert sorted(r.item_id for r in rest.collect()) == [7, 8, 9]


def test_take_fraction(spark):
    items = queue(spark, (1, [1]), (2, [2, 3]), (5, [4, 5, 6, 7, 8]))
    for mode, expected in (("documented", [0, 1, 2]), ("as_coded", [0, 2, 5])):
        got = [r.queue_id for r in rebalance.take_fraction(items, 0.5, mode).collect()]
        assert [got.count(q) for q in (1, 2, 5)] == expected
    first = sorted(r.item_id for r in rebalance.take_fraction(items).collect())
    assert first == [2, 4, 5]


def test_heads_and_sizes(spark):
    items = queue(spark, (1, [9, 8]), (2, [3]))
    assert {r.queue_id: r.item_id for r in rebalance.queue_heads(items).collect()} == {1: 9, 2: 3}
    assert {r.queue_id: r["size"] for r in rebalance.queue_sizes(items).collect()} == {1: 2, 2: 1}
    wanted = spark.createDataFrame([(2,), (7,), (2,)], "executor_id long")
    assert [r.item_id for r in rebalance.lookup_executor(items, wanted).collect()] == [3]


def test_append_keeps_duplicates(spark):
    items = queue(spark, (1, [1, 2]), (2, [3]))
    new = spark.createDataFrame([(1, 1, 8, 5), (7, 1, 3, 5), (8, 4, 1, 5)], ITEMS)
    assert contents(rebalance.append_items(items, new)) == {1: [1, 2, 7, 1], 2: [3], 4: [8]}


def test_append_to_pool(spark):
    items = spark.createDataFrame([(1, None, 1, 5)], ITEMS)
    new = spark.createDataFrame([(2, None, 1, 5)], ITEMS)
    assert sorted(r.pos for r in rebalance.append_items(items, new).collect()) == [1, 2]


def test_steal_golden(spark):
    items = queue(spark, (1, [1, 2, 3, 4, 5, 6, 7, 8]), (2, [20]))
    moves = spark.createDataFrame([(1, 2)], "victim_id long, thief_id long")
    moved = rebalance.steal_move(items, moves)
    assert contents(moved) == {1: [4, 5, 6, 7, 8], 2: [20, 3, 2, 1]}
    log = rebalance.moved_items(items, moves)
    assert {tuple(r) for r in log.collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2)}
    counts = {r.executor_id: (r.stolen_by, r.stolen_from) for r in rebalance.steal_counts(log).collect()}
    assert counts == {1: (0, 3), 2: (3, 0)}


def loop_round(queues, moves):
    """One round by hand: all victims split first, then the thieves append."""
    chosen = {}
    for victim, thief in moves:
        if victim != thief:
            chosen[victim] = min(thief, chosen.get(victim, thief))
    after = {q: list(items) for q, items in queues.items()}
    batches = []
    for victim in sorted(chosen):
        items = after.get(victim, [])
        k = len(items) // 4 + 1 if items else 0
        if 0 < k < len(items):
            batches.append((chosen[victim], items[:k][::-1]))
            after[victim] = items[k:]
    for thief, batch in batches:
        after.setdefault(thief, []).extend(batch)
    return {q: items for q, items in after.items() if items}


@pytest.mark.parametrize("rows_per_block", [None, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_steal_round_is_the_loop(spark, seed, rows_per_block):
    pick = random.Random(seed)
    ids = iter(range(10_000))
    queues = {q: [next(ids) for _ in range(pick.choice([0, 1, 2, 3, 9, 40]))] for q in range(8)}
    moves = [(pick.randrange(9), pick.randrange(10)) for _ in range(12)]
    frame = spark.createDataFrame(moves, "victim_id long, thief_id long")
    items = queue(spark, *queues.items())
    moved = rebalance.steal_move(items, frame, rows_per_block=rows_per_block)
    assert contents(moved) == loop_round(queues, moves)


def test_receive_items(spark):
    items = queue(spark, (1, [4, 5, 6]), (2, [20]))
    parts = spark.createDataFrame(
        [(1, 1, 2, 3, 10), (2, 1, 2, 2, 10), (3, 1, 2, 1, 10)],
        "item_id long, victim_id long, thief_id long, pos long, cost_ms long",
    )
    log = spark.createDataFrame([(9, 2, 1)], "item_id long, victim_id long, thief_id long")
    queues, log = rebalance.receive_items(items, parts, log)
    assert contents(queues) == {1: [4, 5, 6], 2: [20, 3, 2, 1]}
    counts = {r.executor_id: (r.stolen_by, r.stolen_from) for r in rebalance.steal_counts(log).collect()}
    assert counts == {1: (1, 3), 2: (3, 1)}
