"""Splitting, drawing, dealing and moving ordered work items.

`work_items(item_id, queue_id, pos, cost_ms)`: rows sharing `queue_id` are a queue in order of `pos`; a
pool is a table of items in order of `item_id`. Rows with a null `queue_id` are a pool among queues: they are
in no queue, so splits and sizes leave them out, and moves leave them where they are. A batch is handed over newest first: `batch_pos` counts
from 1 at the item that was taken last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.search import rank_among, with_rank_among
from evenkeel.functions.sizing import split_size
from evenkeel.operators.ordinals import GlobalOrder, running_totals

_IN_QUEUE = ["pos", "item_id"]


def _queued(work_items: DataFrame) -> DataFrame:
    """Items in a queue: rows without a `queue_id` are the pool."""
    return work_items.where(F.col("queue_id").isNotNull())


def queue_sizes(work_items: DataFrame) -> DataFrame:
    """Items per queue; the pool is not a queue."""
    return _queued(work_items).groupBy("queue_id").agg(F.count(F.lit(1)).alias("size"))


def lookup_executor(work_items: DataFrame, wanted: DataFrame) -> DataFrame:
    """The queues of the `wanted(executor_id)` executors."""
    ids = wanted.select(F.col("executor_id").alias("queue_id")).distinct()
    return work_items.join(ids, "queue_id", "left_semi").select(*work_items.columns)


def queue_heads(work_items: DataFrame) -> DataFrame:
    """The next item of each queue, in order of `(pos, item_id)`; an empty queue gives no row.

    Like everywhere here, items without a queue (the pool) are not a queue.
    """
    others = [name for name in work_items.columns if name not in ("queue_id", *_IN_QUEUE)]
    first = F.min(F.struct(*_IN_QUEUE, *others)).alias("first")
    return _queued(work_items).groupBy("queue_id").agg(first).select("queue_id", "first.*")


def _ranked(work_items: DataFrame, rows_per_block: int | None) -> DataFrame:
    """Items in queues with `_r`, the place in the queue from 1, and `_n`, the size of the queue."""
    return running_totals(
        _queued(work_items),
        ["queue_id"],
        _IN_QUEUE,
        totals={"_r": F.lit(1)},
        finals={"_n": "_r"},
        rows_per_block=rows_per_block,
    )


def split_head(
    work_items: DataFrame,
    policy: str = "quarter",
    max_items: int | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Mark what each queue would hand over from its head: `moved`, `kept`, or `pending`.

    A split that would empty its queue hands nothing over; its items are `pending`.
    """
    rank, size = F.col("_r"), F.col("_n")
    split = _ranked(work_items, rows_per_block).withColumn("_k", split_size(size, policy, max_items))
    taken = rank <= F.col("_k")
    status = (
        F.when(~taken, "kept").when(F.col("_k") == size, "pending").otherwise("moved").alias("status")
    )
    batch_pos = F.when(taken, F.col("_k") - rank + 1).alias("batch_pos")
    return split.select(*work_items.columns, status, batch_pos)


def take_fraction(
    work_items: DataFrame,
    frac: float = 0.5,
    mode: str = "documented",
    rows_per_block: int | None = None,
    keep_rest: bool = False,
) -> DataFrame:
    """The first `floor(frac * n)` items of each queue of n.

    With `mode='as_coded'` the whole queue goes as soon as that number is at least one. With `keep_rest`
    all items come, with `status` `taken` or `left`.
    """
    if mode not in ("documented", "as_coded"):
        raise ValueError(f"mode must be documented or as_coded: {mode!r}")
    share = F.floor(frac * F.col("_n"))
    take = F.col("_r") <= share if mode == "documented" else share >= 1
    ranked = _ranked(work_items, rows_per_block)
    if keep_rest:
        status = F.when(take, "taken").otherwise("left").alias("status")
        return ranked.select(*work_items.columns, status)
    return ranked.where(take).select(*work_items.columns)


def draw_from_pool(
    pool: DataFrame,
    policy: str = "quarter",
    from_tail: bool = False,
    rows_per_block: int | None = None,
    keep_rest: bool = False,
) -> DataFrame:
    """One draw from the pool: a `quarter` of it or just `one` item, from the head or the tail.

    The drawn items come with `batch_pos`; blocks of the pool that the draw does not reach are left out
    before the shuffle. With `keep_rest` all items come, with `status` `taken` or `left`: what is left is
    the pool after the draw.
    """
    if policy not in ("quarter", "one"):
        raise ValueError(f"policy must be quarter or one: {policy!r}")
    if policy == "one" and not keep_rest:
        first = pool.orderBy(F.desc("item_id") if from_tail else F.asc("item_id")).limit(1)
        return first.withColumn("batch_pos", F.lit(1).cast("long"))
    order = GlobalOrder(pool, ["item_id"], rows_per_block)
    size = min(order.count, 1 if policy == "one" else order.count // 4 + 1)
    low = order.count - size if from_tail else 0
    batch_pos = (F.col("_ord") - low + 1 if from_tail else size - F.col("_ord")).cast("long")
    if not keep_rest:
        drawn = order.numbered("_ord", low, low + size)
        return drawn.select(*pool.columns, batch_pos.alias("batch_pos"))
    taken = (F.col("_ord") >= low) & (F.col("_ord") < low + size)
    return order.numbered("_ord").select(
        *pool.columns,
        F.when(taken, "taken").otherwise("left").alias("status"),
        F.when(taken, batch_pos).alias("batch_pos"),
    )


def chunk_starts(count: int) -> list[int]:
    """Start position of each draw until a pool of `count` is empty, and the end: O(log count) numbers."""
    starts = [0]
    while starts[-1] < count:
        starts.append(starts[-1] + (count - starts[-1]) // 4 + 1)
    return starts


def guided_chunks(pool: DataFrame, skip: int = 0, rows_per_block: int | None = None) -> DataFrame:
    """Cut the pool into the sequence of quarter draws: `chunk_id` from 1, shrinking sizes.

    The first `skip` items are gone already (dealt) and left out.
    """
    order = GlobalOrder(pool, ["item_id"], rows_per_block)
    return chunked(order, skip, skip).select(*pool.columns, "chunk_id", "batch_pos")


def chunked(order: GlobalOrder, skip: int, low: int, high: int | None = None) -> DataFrame:
    """Items with positions in `[low, high)` and their chunk; those before `skip` are in chunk 0."""
    starts = [skip + start for start in chunk_starts(max(order.count - skip, 0))]
    chunk_id = F.when(F.col("_ord") < skip, F.lit(0)).otherwise(rank_among(F.col("_ord"), starts))
    cut = order.numbered("_ord", low, high).withColumn("chunk_id", chunk_id.cast("long"))
    end = F.get(F.lit(np.array(starts, "int64")), F.col("chunk_id").cast("int"))
    return cut.withColumn("batch_pos", F.when(F.col("chunk_id") > 0, end - F.col("_ord")))


def deal_initial(
    pool: DataFrame, executors: int = 3, k: int = 3, rows_per_block: int | None = None
) -> DataFrame:
    """Deal the first `executors * k` items in blocks of k: `executor_id` from 1, null for the rest.

    Only the ids of the first items are looked up, in one pass; all items stay where they are, without a
    shuffle. Items are dealt by place, so items with equal ids stay separate items: if there are such among
    the first ones, the pool is numbered.
    """
    n = executors * k
    ids = [r[0] for r in pool.select("item_id").orderBy("item_id").limit(n + 1).collect()]
    if None in ids or len(set(ids)) < len(ids):
        numbered = GlobalOrder(pool, ["item_id"], rows_per_block).numbered("_ord")
        return numbered.select(*pool.columns, _dealt_to(executors, k).alias("executor_id"))
    ranked = with_rank_among(pool, "_ord", F.col("item_id"), F.array(*[F.lit(i) for i in ids]), len(ids))
    # The rank counts the item itself, and is n + 1 beyond the first n.
    dealt = ranked.withColumn("_ord", F.col("_ord") - 1)
    dealt = dealt.withColumn("_ord", F.when(F.col("_ord") < len(ids[:n]), F.col("_ord")))
    return dealt.select(*pool.columns, _dealt_to(executors, k).cast("long").alias("executor_id"))


def _dealt_to(executors: int, k: int) -> Column:
    return F.when(F.col("_ord") < executors * k, F.call_function("div", F.col("_ord"), F.lit(k)) + 1)


def deal_and_chunk(
    pool: DataFrame, executors: int = 3, k: int = 3, rows_per_block: int | None = None
) -> DataFrame:
    """`deal_initial`, and the rest in `guided_chunks`, from one numbering of the pool.

    Dealt items have `chunk_id` 0 and no `batch_pos`.
    """
    order = GlobalOrder(pool, ["item_id"], rows_per_block)
    return chunked(order, executors * k, 0).select(
        *pool.columns, _dealt_to(executors, k).alias("executor_id"), "chunk_id", "batch_pos"
    )


def append_items(
    work_items: DataFrame, new_items: DataFrame, rows_per_block: int | None = None
) -> DataFrame:
    """Append `new_items` (same columns; `pos` is their arrival order) at the tails; duplicates stay."""
    tails = work_items.groupBy(F.col("queue_id").alias("_queue")).agg(F.max("pos").alias("_tail"))
    ranked = running_totals(
        new_items, ["queue_id"], _IN_QUEUE, {"_r": F.lit(1)}, rows_per_block=rows_per_block
    )
    placed = ranked.join(tails, F.col("queue_id").eqNullSafe(F.col("_queue")), "left")
    pos = F.coalesce("_tail", F.lit(0)) + F.col("_r")
    return work_items.unionByName(placed.withColumn("pos", pos).select(*work_items.columns))


def _grants(work_items: DataFrame, moves: DataFrame, policy: str, max_items: int | None) -> DataFrame:
    """Per victim: its thief, how many items go, and how many items are ahead of them at the thief.

    All of this is on tables with a row per queue, never per item.
    """
    pairs = (
        moves.where(F.col("victim_id") != F.col("thief_id"))
        .groupBy("victim_id")
        .agg(F.min("thief_id").alias("thief_id"))
    )
    sizes = queue_sizes(work_items)
    k = split_size(F.col("size"), policy, max_items)
    given = pairs.join(sizes.withColumnRenamed("queue_id", "victim_id"), "victim_id").select(
        "victim_id", "thief_id", F.when(k == F.col("size"), 0).otherwise(k).alias("taken")
    )
    in_line = running_totals(
        given, ["thief_id"], ["victim_id"], {"_upto": F.col("taken")}, no_larger_than=moves
    )
    thief_size = sizes.select(F.col("queue_id").alias("thief_id"), F.col("size").alias("_size"))
    thief_gave = given.select(F.col("victim_id").alias("thief_id"), F.col("taken").alias("_gave"))
    ahead = (
        F.coalesce("_size", F.lit(0)) - F.coalesce("_gave", F.lit(0)) + F.col("_upto") - F.col("taken")
    )
    return (
        in_line.join(thief_size, "thief_id", "left")
        .join(thief_gave, "thief_id", "left")
        .select("victim_id", "thief_id", "taken", ahead.alias("ahead"))
    )


def _with_grants(work_items, moves, policy, max_items, rows_per_block) -> DataFrame:
    ranked = running_totals(
        work_items, ["queue_id"], _IN_QUEUE, {"_r": F.lit(1)}, rows_per_block=rows_per_block
    )
    grants = _grants(work_items, moves, policy, max_items)
    return ranked.join(grants, F.col("queue_id") == F.col("victim_id"), "left")


def _is_moved() -> Column:
    return F.coalesce(F.col("_r") <= F.col("taken"), F.lit(False))


def steal_move(
    work_items: DataFrame,
    moves: DataFrame,
    policy: str = "quarter",
    max_items: int | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """One round of `moves(victim_id, thief_id)`: each victim's head goes to the tail of its thief.

    A victim with several thieves serves the one with the lowest id this round. A split that would empty
    the victim moves nothing. Several victims of one thief line up by victim id. No item is lost or
    doubled, and every queue comes out numbered from 1 without gaps.
    """
    items = _with_grants(work_items, moves, policy, max_items, rows_per_block)
    arrival = F.col("ahead") + F.col("taken") - F.col("_r") + 1
    stay = F.when(F.col("queue_id").isNull(), F.col("pos")).otherwise(F.col("_r") - F.coalesce("taken", F.lit(0)))
    changed = {
        "queue_id": F.when(_is_moved(), F.col("thief_id")).otherwise(F.col("queue_id")),
        "pos": F.when(_is_moved(), arrival).otherwise(stay),
    }
    return items.select(*[changed.get(c, F.col(c)).alias(c) for c in work_items.columns])


def moved_items(
    work_items: DataFrame,
    moves: DataFrame,
    policy: str = "quarter",
    max_items: int | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """What `steal_move` hands over, as a move log `(item_id, victim_id, thief_id)`."""
    items = _with_grants(work_items, moves, policy, max_items, rows_per_block)
    return items.where(_is_moved()).select("item_id", "victim_id", "thief_id")


def receive_items(
    work_items: DataFrame,
    parts: DataFrame,
    move_log: DataFrame,
    rows_per_block: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Append stolen `parts(item_id, victim_id, thief_id, pos, cost_ms)` at their thieves and log them.

    Returns the new queues and the new move log, which feeds `steal_counts`.
    """
    arriving = parts.withColumn("queue_id", F.col("thief_id")).select(*work_items.columns)
    log = move_log.unionByName(parts.select("item_id", "victim_id", "thief_id"))
    return append_items(work_items, arriving, rows_per_block), log


def steal_counts(move_log: DataFrame) -> DataFrame:
    """Items stolen by and from each executor so far: one pass and one pre-aggregated shuffle."""
    sides = F.array(
        F.struct(F.col("thief_id").alias("executor_id"), F.lit(1).alias("by"), F.lit(0).alias("lost")),
        F.struct(F.col("victim_id").alias("executor_id"), F.lit(0).alias("by"), F.lit(1).alias("lost")),
    )
    return (
        move_log.select(F.inline(sides))
        .groupBy("executor_id")
        .agg(F.sum("by").alias("stolen_by"), F.sum("lost").alias("stolen_from"))
    )
