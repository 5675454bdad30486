"""Rounds in which every thief has a victim of its own."""

import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import ranking
from evenkeel.plans import flows

ASKS = "remaining < 4"


def state(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "executor_id long, remaining long")


def queues(spark, sizes):
    rows = [(100 * q + k, q, k + 1, 5) for q, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "item_id long, queue_id long, pos long, cost_ms long")


def matched(sizes, gave=()):
    victims = sorted((q for q, n in sizes.items() if n >= 4), key=lambda q: (-sizes[q], q))
    thieves = sorted((q for q, n in sizes.items() if n < 4 and q not in gave), key=lambda q: (sizes[q], q))
    return list(zip(victims, thieves))


@pytest.mark.parametrize("rows_per_block", [None, 5])
@pytest.mark.parametrize("seed", range(3))
def test_each_is_matched_once(spark, seed, rows_per_block):
    rng = random.Random(seed)
    sizes = {q: rng.choice([0, 0, 1, 3, 4, rng.randrange(60)]) for q in range(40)}
    gave = rng.sample(sorted(sizes), 10)
    given = spark.createDataFrame([(g,) for g in gave * 2], "executor_id long")
    got = ranking.match_by_rank(state(spark, sizes), F.expr(ASKS), given, rows_per_block)
    pairs = [(r.victim_id, r.thief_id) for r in got.orderBy("rank").collect()]
    assert pairs == matched(sizes, gave)
    both = [x for p in pairs for x in p]
    assert len(both) == len(set(both))


def test_nobody_asks_or_has_work(spark):
    assert ranking.match_by_rank(state(spark, {1: 9, 2: 8}), F.expr(ASKS)).count() == 0
    assert ranking.match_by_rank(state(spark, {1: 0, 2: 1}), F.expr(ASKS)).count() == 0
    assert ranking.match_by_rank(state(spark, {1: 0, 2: 1, 3: None}), F.expr(ASKS)).count() == 0


def played(sizes, rounds):
    """The queues and moves round by round, with lists."""
    lists = {q: [100 * q + k for k in range(n)] for q, n in sizes.items()}
    gave, moves = (), []
    for number in range(1, rounds + 1):
        pairs = matched({q: len(x) for q, x in lists.items()}, gave)
        gave = []
        for victim, thief in pairs:
            k = len(lists[victim]) // 4 + 1
            if k == len(lists[victim]):
                continue
            head, lists[victim] = lists[victim][:k], lists[victim][k:]
            lists[thief] += head[::-1]
            gave.append(victim)
            moves.append((victim, thief, number))
    return lists, moves


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds(spark, rounds):
    rng = random.Random(rounds)
    sizes = {q: rng.choice([0, 1, 2, 4, 5, 30]) for q in range(14)}
    after, moves = flows.steal_rounds(state(spark, sizes), queues(spark, sizes), F.expr(ASKS), rounds)
    lists, expected = played(sizes, rounds)
    assert sorted((r.victim_id, r.thief_id, r["round"]) for r in moves.collect()) == sorted(expected)
    got = {}
    for r in after.orderBy("queue_id", "pos").collect():
        got.setdefault(r.queue_id, []).append(r.item_id)
    assert got == {q: x for q, x in lists.items() if x}
    takers = {(t, n) for _, t, n in expected}
    assert not any((v, n + 1) in takers for v, _, n in expected)  # who just gave does not take
