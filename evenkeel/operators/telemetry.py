"""Heartbeat logs: progress, latest and first state, history, completion times, refill need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.sizing import needs_refill
from evenkeel.operators.ordinals import running_totals

# Kinds of log steps. At equal times they count in this order. The first three stand for what a saved state
# has counted: items done at its last heartbeat, its heartbeats, and items done after the last of them.
_OLD_DONE, _OLD_HEARTBEATS, _OLD_LATER, _HEARTBEAT, _DONE, _ASSIGNED, _GAINED, _LOST = range(8)
_COUNTERS = {
    "hb_seq": (_OLD_HEARTBEATS, _HEARTBEAT),
    "processed": (_OLD_DONE, _OLD_LATER, _DONE),
    "assigned": (_ASSIGNED,),
    "stolen_by": (_GAINED,),
    "stolen_from": (_LOST,),
}


def _counted(
    assigned: DataFrame,
    completions: DataFrame,
    heartbeats: DataFrame,
    moves: DataFrame | None,
    carried: DataFrame | None,
    tie_break: str | None,
    rows_per_block: int | None,
    others: Sequence[str] = (),
) -> DataFrame:
    """Every step of all logs with the counters up to it; `others` are columns of `completions` to keep."""
    extra = [tie_break] if tie_break else []
    time_type = heartbeats.schema["hb_ts"].dataType
    kept = {name: completions.schema[name].dataType for name in others}

    def steps(log: DataFrame, executor: str, kind: int, time: str) -> DataFrame:
        return log.select(
            F.col(executor).alias("executor_id"),
            F.col(time).cast(time_type).alias("hb_ts"),
            *extra,
            F.lit(kind).alias("kind"),
            F.lit(1).cast("long").alias("amount"),
            *[F.col(name) if kind == _DONE else F.lit(None).cast(t).alias(name) for name, t in kept.items()],
        )

    def untimed(rows: DataFrame, kind: Column, amount: Column) -> DataFrame:
        return rows.select(
            "executor_id",
            F.lit(None).cast(time_type).alias("hb_ts"),
            *[F.lit(None).cast(heartbeats.schema[name].dataType).alias(name) for name in extra],
            kind.alias("kind"),
            amount.cast("long").alias("amount"),
            *[F.lit(None).cast(t).alias(name) for name, t in kept.items()],
        )

    # Steps without a time share one place in the order, so they are summed before the shuffle.
    given = assigned.groupBy("executor_id").agg(F.sum("assigned").alias("amount"))
    log = (
        steps(heartbeats, "executor_id", _HEARTBEAT, "hb_ts")
        .unionByName(steps(completions, "executor_id", _DONE, "finish_ts"))
        .unionByName(untimed(given, F.lit(_ASSIGNED), F.col("amount")))
    )
    counters = dict(list(_COUNTERS.items())[: 5 if moves is not None or carried is not None else 3])
    if moves is not None:
        log = log.unionByName(steps(moves, "thief_id", _GAINED, "move_ts")).unionByName(
            steps(moves, "victim_id", _LOST, "move_ts")
        )
    if carried is not None:
        before = {
            _OLD_DONE: F.col("processed_reported"),
            _OLD_HEARTBEATS: F.col("hb_seq"),
            _OLD_LATER: F.col("processed") - F.col("processed_reported"),
            _ASSIGNED: F.col("assigned"),
            _GAINED: F.col("stolen_by"),
            _LOST: F.col("stolen_from"),
        }
        entries = F.array(*[F.struct(F.lit(k).alias("k"), c.cast("long").alias("c")) for k, c in before.items()])
        old = carried.select("executor_id", F.inline(entries))
        log = log.unionByName(untimed(old, F.col("k"), F.col("c")))
    return running_totals(
        log,
        ["executor_id"],
        ["hb_ts", *extra, "kind"],
        totals={
            name: F.when(F.col("kind").isin(*kinds), F.col("amount")).otherwise(0)
            for name, kinds in counters.items()
        },
        at_last={"processed_before": ("processed", F.col("kind").isin(_OLD_HEARTBEATS, _HEARTBEAT))},
        finals={"heartbeats": "hb_seq"} if others else None,
        rows_per_block=rows_per_block,
    )


def heartbeat_progress(
    assigned: DataFrame,
    completions: DataFrame,
    heartbeats: DataFrame,
    moves: DataFrame | None = None,
    tie_break: str | None = None,
    rows_per_block: int | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """State of each executor at each of its heartbeats.

    `assigned(executor_id, assigned)`, `completions(executor_id, finish_ts)`,
    `heartbeats(executor_id, hb_ts)` and optionally `moves(victim_id, thief_id, move_ts)` are logs of
    counter steps; their union is read in time order per executor, in one shuffle. `tie_break` names a log
    sequence column present in all timed logs; at equal times without it, a heartbeat comes before the
    completion of the item in progress, so that item still counts as remaining.

    With `carried`, the `progress_totals` of all earlier logs, the counters go on from there: the logs given
    need only what came since, and the result has only their heartbeats. The totals enter as steps before
    all others, so it stays one shuffle without a join.

    Columns: executor_id, hb_ts, [tie_break,] hb_seq (from 1), processed, remaining, delta (processed
    since the previous heartbeat), avg_rate (processed per heartbeat), stolen_by, stolen_from.
    """
    extra = [tie_break] if tie_break else []
    counted = _counted(assigned, completions, heartbeats, moves, carried, tie_break, rows_per_block)
    counted = counted.where(F.col("kind") == _HEARTBEAT)
    if "stolen_by" not in counted.columns:
        none = F.lit(0).cast("long")
        counted = counted.withColumns({"stolen_by": none, "stolen_from": none})
    delta = F.col("processed") - F.coalesce("processed_before", F.lit(0))
    held = F.col("assigned") + F.col("stolen_by") - F.col("stolen_from")
    return counted.select(
        "executor_id",
        "hb_ts",
        *extra,
        "hb_seq",
        "processed",
        (held - F.col("processed")).alias("remaining"),
        delta.alias("delta"),
        (F.col("processed") / F.col("hb_seq")).alias("avg_rate"),
        "stolen_by",
        "stolen_from",
    )


def progress_totals(
    assigned: DataFrame,
    completions: DataFrame,
    heartbeats: DataFrame,
    moves: DataFrame | None = None,
    tie_break: str | None = None,
    rows_per_block: int | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """What each executor's counters have come to at the end of the logs, to carry on from.

    The arguments are those of `heartbeat_progress`. Columns: executor_id, hb_seq, processed,
    processed_reported (up to the last heartbeat), assigned, stolen_by, stolen_from: a row per executor,
    whatever the length of the logs. Save it with the logs' end, and later logs need no earlier ones.
    """
    counted = _counted(assigned, completions, heartbeats, moves, carried, tie_break, rows_per_block)
    # No counter ever falls, so the greatest value is the last one.
    reported = F.when(F.col("kind").isin(_OLD_HEARTBEATS, _HEARTBEAT), F.col("processed"))
    totals = counted.groupBy("executor_id").agg(
        F.max("hb_seq").alias("hb_seq"),
        F.max("processed").alias("processed"),
        F.coalesce(F.max(reported), F.lit(0)).alias("processed_reported"),
        F.max("assigned").alias("assigned"),
        *[
            (F.max(name) if name in counted.columns else F.max(F.lit(0).cast("long"))).alias(name)
            for name in ("stolen_by", "stolen_from")
        ],
    )
    return totals


def reported_items(
    completions: DataFrame,
    heartbeats: DataFrame,
    tie_break: str | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Each completion with the heartbeat that reports it: the executor's next one.

    `completions(item_id, executor_id, finish_ts)` and `heartbeats(executor_id, hb_ts)`; `tie_break` as in
    `heartbeat_progress`. Columns: executor_id, item_id, finish_ts, hb_seq, place (from 1 within that
    heartbeat, in order of finishing). A completion after the last heartbeat has a null `hb_seq`: the next
    heartbeat to come will report it. The match is read off running counters, so it needs no join, and an
    executor with most of the log is spread like everywhere else.
    """
    none = heartbeats.select("executor_id", F.lit(0).cast("long").alias("assigned")).limit(0)
    counted = _counted(none, completions, heartbeats, None, None, tie_break, rows_per_block, ["item_id"])
    next_seq = F.col("hb_seq") + 1
    return counted.where(F.col("kind") == _DONE).select(
        "executor_id",
        "item_id",
        F.col("hb_ts").alias("finish_ts"),
        F.when(next_seq <= F.col("heartbeats"), next_seq).alias("hb_seq"),
        (F.col("processed") - F.coalesce("processed_before", F.lit(0))).alias("place"),
    )


def processed_ids(reported: DataFrame, page: int = 10_000) -> DataFrame:
    """The items of `reported_items` per heartbeat: executor_id, hb_seq, page_no (from 0), processed_ids.

    The ids come in order of finishing, in arrays of at most `page`, one row for each page: a heartbeat
    after very many completions does not end up in one row. Items that no heartbeat reports yet come with
    a null `hb_seq`; heartbeats that report nothing have no row.
    """
    page_no = F.call_function("div", F.col("place") - 1, F.lit(page)).alias("page_no")
    listed = F.sort_array(F.collect_list(F.struct("place", "item_id")))
    return reported.groupBy("executor_id", "hb_seq", page_no).agg(
        F.transform(listed, lambda x: x["item_id"]).alias("processed_ids")
    )


def remaining_ids(
    items: DataFrame, reported: DataFrame, at: DataFrame, page: int = 10_000, rows_per_block: int | None = None
) -> DataFrame:
    """The items that were open at the heartbeats `at(executor_id, hb_seq)`, in order of their ids.

    `items(item_id, executor_id)` are all items assigned, `reported` the `reported_items` of the log. An
    item is open up to the heartbeat before the one that reports it. Columns: executor_id, hb_seq, page_no,
    remaining_ids; arrays as in `processed_ids`. Ask for as many heartbeats as are needed: each lists all
    its open items, so all heartbeats of a log would list an item once for each that it waited through.
    """
    done = reported.select("executor_id", "item_id", F.coalesce("hb_seq", F.lit(2**62)).alias("_done"))
    waiting = items.select("executor_id", "item_id").join(done, ["executor_id", "item_id"], "left")
    open_at = waiting.join(at.select("executor_id", "hb_seq").distinct(), "executor_id").where(
        F.col("_done").isNull() | (F.col("_done") > F.col("hb_seq"))
    )
    numbered = running_totals(
        open_at.select("executor_id", "hb_seq", "item_id"),
        ["executor_id", "hb_seq"],
        ["item_id"],
        {"_n": F.lit(1)},
        rows_per_block=rows_per_block,
    )
    page_no = F.call_function("div", F.col("_n") - 1, F.lit(page)).alias("page_no")
    return numbered.groupBy("executor_id", "hb_seq", page_no).agg(
        F.sort_array(F.collect_list("item_id")).alias("remaining_ids")
    )


# Numbers and times are kept in place while a hash aggregation runs.
_FIXED_WIDTH = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)


def _place(df: DataFrame, order: Sequence[str]) -> Column:
    """The order columns as one value; for a time and a sequence number a decimal.

    With a decimal, Spark takes the extreme by a hash aggregation. Records would be sorted on the map side.
    """
    kinds = [df.schema[c].dataType for c in order]
    times = (T.TimestampType, T.TimestampNTZType)
    if len(order) == 2 and isinstance(kinds[0], times) and isinstance(kinds[1], T.LongType):
        micros = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("decimal(19,0)")
        whole = micros * F.lit(10**18).cast("decimal(19,0)") + F.col(order[1])
        return whole.cast("decimal(38,0)")
    return F.struct(*order)


def _pick(heartbeats: DataFrame, pick, order: Sequence[str], columns: Sequence[str] | None) -> DataFrame:
    kept = [c for c in heartbeats.columns if c != "executor_id" and (columns is None or c in columns)]
    rows = heartbeats.withColumn("_place", _place(heartbeats, order))
    fixed = all(isinstance(heartbeats.schema[c].dataType, _FIXED_WIDTH) for c in kept)
    if fixed and isinstance(rows.schema["_place"].dataType, T.DecimalType):
        return rows.groupBy("executor_id").agg(*[pick(c, "_place").alias(c) for c in kept])
    chosen = rows.groupBy("executor_id").agg(pick(F.struct(*kept), "_place").alias("chosen"))
    return chosen.select("executor_id", "chosen.*")


def latest_heartbeat(
    heartbeats: DataFrame,
    order: Sequence[str] = ("hb_ts", "hb_seq"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The last record per executor; a late older record does not win.

    Name the `columns` that are needed, and only those and `order` are read from the log.
    """
    return _pick(heartbeats, F.max_by, order, columns)


def first_heartbeat(
    heartbeats: DataFrame,
    order: Sequence[str] = ("hb_ts", "hb_seq"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The first record per executor; `columns` as in `latest_heartbeat`."""
    return _pick(heartbeats, F.min_by, order, columns)


def heartbeat_history(
    heartbeats: DataFrame,
    order: Sequence[str] = ("hb_ts", "hb_seq"),
    page: int | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Each executor's records in order, numbered from 1 in `history_pos`.

    The flat form is the default. With `page`, the records of an executor come as arrays of at most that
    many, one row per `page_no`, so no row grows with the log.
    """
    flat = running_totals(
        heartbeats, ["executor_id"], list(order), {"history_pos": F.lit(1)}, rows_per_block=rows_per_block
    )
    if page is None:
        return flat
    record = F.struct("history_pos", *[c for c in heartbeats.columns if c != "executor_id"])
    page_no = F.call_function("div", F.col("history_pos") - 1, F.lit(page)).alias("page_no")
    return flat.groupBy("executor_id", page_no).agg(
        F.sort_array(F.collect_list(record)).alias("history")
    )


def completion_report(completions: DataFrame, start: Column | None = None) -> DataFrame:
    """Seconds from the common start (by default the earliest completion) to each executor's last one."""
    if start is None:
        start = completions.agg(F.min("finish_ts").alias("start")).scalar()
    last = completions.groupBy("executor_id").agg(F.max("finish_ts").alias("last"))
    micros = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return last.select("executor_id", (micros / 1e6).alias("total_seconds"))


def refill_due(df: DataFrame, rule: str = "sqrt", name: str = "refill_due") -> DataFrame:
    """Mark rows `(remaining, batch_size, pool_size)` whose queue should be refilled from the pool."""
    due = needs_refill(F.col("remaining"), F.col("batch_size"), F.col("pool_size"), rule)
    return df.withColumn(name, due)
