"""The flows from logs to decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.sizing import split_size
from evenkeel.operators.ordinals import GlobalOrder, assign_ids
from evenkeel.operators.ranking import match_by_rank, pick_victim
from evenkeel.operators.rebalance import (
    append_items,
    chunk_starts,
    chunked,
    deal_and_chunk,
    queue_sizes,
    steal_move,
)
from evenkeel.operators.telemetry import heartbeat_progress, latest_heartbeat, refill_due
from evenkeel.session import stored


def current_state(
    assigned: DataFrame,
    completions: DataFrame,
    heartbeats: DataFrame,
    tie_break: str | None = None,
    columns: Sequence[str] | None = None,
    store: bool = False,
) -> DataFrame:
    """Logs to the latest state of each executor, all of it or just the named `columns`.

    With `store` the state, a row per executor, is computed now and written out. Use it where the state is
    read more than once, as `pick_victim` does: the log is sorted once then, not once per use.
    """
    progress = heartbeat_progress(assigned, completions, heartbeats, tie_break=tie_break)
    latest = latest_heartbeat(progress, columns=columns)
    return stored(latest, "latest") if store else latest


def pool_schedule(pool: DataFrame, executors: int = 3, k: int = 3) -> DataFrame:
    """A shared pool to batches: the first items dealt (`chunk_id` 0), the rest in guided chunks."""
    return deal_and_chunk(pool, executors, k)


def refill_round(state: DataFrame, work_items: DataFrame, pool: DataFrame, rule: str = "sqrt") -> tuple:
    """Every executor whose queue is due draws once from the shared pool, in order of its id.

    `state(executor_id, remaining, batch_size)`; `work_items` and `pool` as everywhere. The first executor
    due gets the first chunk of the pool, the next one the second, and so on while there are chunks; a
    chunk goes to the tail of its queue, newest item first. Returns the queues and the pool after it.

    The executors due are counted first, and the pool is cut where their chunks end: only what is handed out
    is numbered and joined, and the rest stays as it lies. A chunk is as large as a quarter of the pool, so
    the executors, a row each, are looked up rather than the items shuffled to them.
    """
    order = GlobalOrder(pool, ["item_id"])
    due = refill_due(state.withColumn("pool_size", F.lit(order.count)), rule, "_due").where("_due")
    takers = stored(
        assign_ids(due.select("executor_id").distinct(), ["executor_id"], start=1, name="_turn"), "takers"
    )
    starts = chunk_starts(order.count)
    end = starts[min(takers.count(), len(starts) - 1)]
    chunks = chunked(order, 0, 0, end)
    # No more takers than chunks, and these are as many as the logarithm of the pool.
    turns = F.broadcast(takers.where(F.col("_turn") < len(starts)))
    given = chunks.join(turns, F.col("chunk_id") == F.col("_turn"))
    new = given.select(
        *[
            {"queue_id": F.col("executor_id"), "pos": F.col("batch_pos")}.get(c, F.col(c)).alias(c)
            for c in work_items.columns
        ]
    )
    return append_items(work_items, new), order.beyond(end).select(*pool.columns)


def steal_round(latest: DataFrame, work_items: DataFrame, k: int = 2, policy: str = "quarter") -> DataFrame:
    """The queues after every executor asked its best victim for work once.

    The decisions, a row per executor, are written out first: the items are moved by a small table, and
    the heartbeat log behind `latest` is read only once.
    """
    picked = pick_victim(latest, k).where("victim IS NOT NULL")
    moves = picked.select(F.col("victim").alias("victim_id"), F.col("executor_id").alias("thief_id"))
    return steal_move(work_items, stored(moves, "moves"), policy)


def steal_rounds(
    latest: DataFrame, work_items: DataFrame, is_thief: Column, rounds: int = 2, policy: str = "quarter"
) -> tuple[DataFrame, DataFrame]:
    """Rounds in which every thief takes from a victim of its own (`match_by_rank`).

    `is_thief` is an expression over `remaining`, which each round takes from the sizes of the queues;
    `latest(executor_id, remaining)` names the executors, and counts for the first round. Whoever gave in a
    round does not take in the next. A victim whose split would empty it hands nothing over, and has not
    given. Returns the queues after all rounds and the moves, with their `round`.

    The pairs of a round, a row per executor at most, and the queues after it are written out: the next
    round decides by them.
    """
    queues, gave, moves = work_items, None, None
    state = latest.select("executor_id", "remaining")
    for number in range(1, rounds + 1):
        pairs = stored(match_by_rank(state, is_thief, gave), "pairs")
        after = stored(steal_move(queues, pairs, policy), "queues") if number < rounds else steal_move(queues, pairs, policy)
        sizes = queue_sizes(queues).select(F.col("queue_id").alias("victim_id"), "size")
        able = pairs.join(sizes, "victim_id").where(split_size(F.col("size"), policy) < F.col("size"))
        new = able.select("victim_id", "thief_id", F.lit(number).cast("long").alias("round"))
        moves = new if moves is None else moves.unionByName(new)
        gave = new.select(F.col("victim_id").alias("executor_id"))
        left = queue_sizes(after).select(F.col("queue_id").alias("executor_id"), F.col("size").alias("remaining"))
        state = state.select("executor_id").join(left, "executor_id", "left").fillna(0, ["remaining"])
        queues = after
    return queues, moves
