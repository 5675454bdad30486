"""Every operator as a query over the test tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import ordinals, ranking, rebalance, shuffle_metrics, telemetry, topology
from evenkeel.plans import flows
from evenkeel.plans.bindings import Tables
from evenkeel.session import scratch_dir, stored
from evenkeel.sources import costs, tables
from evenkeel.streaming import batches, progress
from evenkeel.streaming import heartbeats as live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        SQL[build.__name__] = sql
        return build

    return register


def _written(t: Tables, df: DataFrame, label: str) -> str:
    """Write a table derived from the test tables, so that it can be loaded or streamed."""
    path = scratch_dir(t.spark, label)
    df.write.parquet(path)
    return path


#: Bytes of a test table for each file of a stream made from it, about.
_FILE_BYTES = 32 << 20


def _stream(t: Tables, df: DataFrame, label: str, table: str, by: list[str], parts: int, per_batch: int = 1) -> DataFrame:
    """`df`, which is derived from the rows of a test table, as a stream of so many parts.

    A part of a large table has many files, so that a batch of `per_batch` parts is not one task's work.
    """
    files = max(1, -(-(ordinals.estimated_bytes(t.table(table)) or 0) // (parts * _FILE_BYTES)))
    path = _written(t, df.repartition(parts * files, *by), label)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch * files).parquet(path)


# Telemetry -------------------------------------------------------------------------------------------

_PROGRESS_SQL = """
log AS (
  SELECT user_id, event_id, ts, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS hb
  FROM events),
assigned AS (SELECT user_id, count(*) AS assigned FROM events GROUP BY user_id),
counted AS (
  SELECT user_id, event_id, ts, hb,
    CAST(sum(hb) OVER w AS BIGINT) AS hb_seq, CAST(sum(1 - hb) OVER w AS BIGINT) AS processed
  FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
progress AS (
  SELECT c.user_id AS executor_id, event_id, ts, hb_seq, processed,
    coalesce(assigned, 0) - processed AS remaining,
    processed - lag(processed, 1, 0) OVER (PARTITION BY c.user_id ORDER BY event_id) AS delta,
    CAST(processed AS DOUBLE) / hb_seq AS avg_rate
  FROM counted c LEFT JOIN assigned a ON a.user_id = c.user_id WHERE hb = 1)"""
_FULL_SQL = "WITH " + _PROGRESS_SQL
_SNAPSHOT_SQL = (
    _FULL_SQL
    + """,
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY executor_id ORDER BY hb_seq DESC) AS rn FROM progress) x
  WHERE rn = 1)"""
)
_STATE = ["executor_id", "hb_seq", "processed", "remaining", "delta", "avg_rate"]
_STATE_SQL = ", ".join(_STATE)


# The `_in_blocks` queries force the cut that large inputs take.
_BLOCK_ROWS = 1000


def _progress(t: Tables, rows_per_block: int | None = None) -> DataFrame:
    return telemetry.heartbeat_progress(
        t.assigned(),
        t.completions(),
        t.heartbeats(),
        tie_break="event_id",
        rows_per_block=rows_per_block,
    )


def _latest(t: Tables, *columns: str, store: bool = False) -> DataFrame:
    return flows.current_state(
        t.assigned(),
        t.completions(),
        t.heartbeats(),
        tie_break="event_id",
        columns=columns or None,
        store=store,
    )


@_query(f"{_FULL_SQL} SELECT event_id, {_STATE_SQL} FROM progress")
def heartbeat_progress(t: Tables) -> DataFrame:
    return _progress(t).select("event_id", *_STATE)


@_query(f"{_FULL_SQL} SELECT event_id, {_STATE_SQL} FROM progress")
def heartbeat_progress_in_blocks(t: Tables) -> DataFrame:
    return _progress(t, _BLOCK_ROWS).select("event_id", *_STATE)


@_query(
    """
WITH moved AS (
  SELECT event_id, user_id AS thief_id, event_id % 150 AS victim_id FROM events
  WHERE event_type = 'signup' AND user_id <> event_id % 150),
assigned AS (SELECT user_id, count(*) AS assigned FROM events GROUP BY user_id),
log AS (
  SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS hb,
    CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS done, 0 AS gained, 0 AS lost FROM events
  UNION ALL SELECT thief_id, event_id, 0, 0, 1, 0 FROM moved
  UNION ALL SELECT victim_id, event_id, 0, 0, 0, 1 FROM moved),
counted AS (
  SELECT user_id, event_id, hb, CAST(sum(hb) OVER w AS BIGINT) AS hb_seq,
    CAST(sum(done) OVER w AS BIGINT) AS processed, CAST(sum(gained) OVER w AS BIGINT) AS stolen_by,
    CAST(sum(lost) OVER w AS BIGINT) AS stolen_from
  FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id, 1 - hb ROWS UNBOUNDED PRECEDING))
SELECT c.user_id AS executor_id, hb_seq, processed,
  coalesce(assigned, 0) + stolen_by - stolen_from - processed AS remaining,
  processed - lag(processed, 1, 0) OVER (PARTITION BY c.user_id ORDER BY hb_seq) AS delta,
  CAST(processed AS DOUBLE) / hb_seq AS avg_rate, stolen_by, stolen_from
FROM counted c LEFT JOIN assigned a ON a.user_id = c.user_id WHERE hb = 1
"""
)
def heartbeat_progress_with_moves(t: Tables) -> DataFrame:
    progress = telemetry.heartbeat_progress(
        t.assigned(), t.completions(), t.heartbeats(), t.timed_moves(), tie_break="event_id"
    )
    return progress.select(*_STATE, "stolen_by", "stolen_from")


@_query(f"{_FULL_SQL} SELECT event_id, {_STATE_SQL} FROM progress")
def heartbeat_progress_carried(t: Tables) -> DataFrame:
    """The log in two parts: the second one starts from the saved totals of the first."""
    middle = t.table("events").agg((F.max("event_id") / 2).alias("m")).scalar()
    done, beats = t.completions(), t.heartbeats()
    old = (t.assigned(), done.where(F.col("event_id") <= middle), beats.where(F.col("event_id") <= middle))
    new = (t.assigned().limit(0), done.where(F.col("event_id") > middle), beats.where(F.col("event_id") > middle))
    first = telemetry.heartbeat_progress(*old, tie_break="event_id")
    totals = stored(telemetry.progress_totals(*old, tie_break="event_id"), "totals")
    second = telemetry.heartbeat_progress(*new, tie_break="event_id", carried=totals)
    return first.unionByName(second).select("event_id", *_STATE)


@_query(
    f"""{_FULL_SQL},
beats AS (SELECT executor_id, max(hb_seq) AS last FROM progress GROUP BY executor_id)
SELECT user_id AS executor_id, last AS hb_seq, processed, coalesce(reported, 0) AS processed_reported, assigned
FROM (SELECT user_id, count(*) AS assigned, count(*) FILTER (event_type <> 'view') AS processed
  FROM events GROUP BY user_id) a
LEFT JOIN beats ON beats.executor_id = user_id
LEFT JOIN (SELECT executor_id, max(processed) AS reported FROM progress GROUP BY executor_id) r
  ON r.executor_id = user_id"""
)
def progress_totals(t: Tables) -> DataFrame:
    totals = telemetry.progress_totals(t.assigned(), t.completions(), t.heartbeats(), tie_break="event_id")
    return totals.drop("stolen_by", "stolen_from")


# Each completion with the number of the next heartbeat; null after the last one.
_REPORTED_SQL = """
WITH log AS (
  SELECT user_id AS executor_id, event_id AS item_id, event_type <> 'view' AS is_done,
    sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id
      ROWS UNBOUNDED PRECEDING) + 1 AS next,
    sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS n
  FROM events),
reported AS (
  SELECT executor_id, item_id, CAST(CASE WHEN next <= n THEN next END AS BIGINT) AS hb_seq,
    row_number() OVER (PARTITION BY executor_id, next ORDER BY item_id) AS place
  FROM log WHERE is_done)"""


def _reported(t: Tables, rows_per_block: int | None = None) -> DataFrame:
    return telemetry.reported_items(t.completions(), t.heartbeats(), "event_id", rows_per_block)


@_query(f"{_REPORTED_SQL} SELECT * FROM reported")
def reported_items(t: Tables) -> DataFrame:
    return _reported(t).drop("finish_ts")


@_query(f"{_REPORTED_SQL} SELECT * FROM reported")
def reported_items_in_blocks(t: Tables) -> DataFrame:
    return _reported(t, _BLOCK_ROWS).drop("finish_ts")


@_query(
    f"""{_REPORTED_SQL}
SELECT executor_id, hb_seq, (place - 1) // 3 AS page_no,
  string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY place) AS processed_ids
FROM reported GROUP BY ALL"""
)
def processed_ids(t: Tables) -> DataFrame:
    ids = F.concat_ws(",", F.col("processed_ids").cast("array<string>"))
    return telemetry.processed_ids(_reported(t), page=3).withColumn("processed_ids", ids)


@_query(
    f"""{_REPORTED_SQL},
asked AS (
  SELECT DISTINCT executor_id, unnest([1, (n + 1) // 2, n]) AS hb_seq FROM log WHERE n > 0),
still AS (
  SELECT a.executor_id, CAST(a.hb_seq AS BIGINT) AS hb_seq, l.item_id,
    row_number() OVER (PARTITION BY a.executor_id, a.hb_seq ORDER BY l.item_id) AS place
  FROM asked a JOIN log l ON l.executor_id = a.executor_id
  LEFT JOIN reported r ON r.item_id = l.item_id
  WHERE r.item_id IS NULL OR r.hb_seq IS NULL OR r.hb_seq > a.hb_seq)
SELECT executor_id, hb_seq, (place - 1) // 20 AS page_no,
  string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY place) AS remaining_ids
FROM still GROUP BY ALL"""
)
def remaining_ids(t: Tables) -> DataFrame:
    """Open items at the first, the middle and the last heartbeat of each executor."""
    items = t.table("events").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("executor_id"))
    beats = t.heartbeats().groupBy("executor_id").agg(F.count("*").alias("n"))
    wanted = F.array(F.lit(1).cast("long"), F.expr("(n + 1) div 2"), F.col("n"))
    at = beats.select("executor_id", F.explode(F.array_distinct(wanted)).alias("hb_seq"))
    ids = F.concat_ws(",", F.col("remaining_ids").cast("array<string>"))
    return telemetry.remaining_ids(items, _reported(t), at, page=20).withColumn("remaining_ids", ids)


@_query(f"{_SNAPSHOT_SQL} SELECT event_id, {_STATE_SQL} FROM latest")
def latest_heartbeat(t: Tables) -> DataFrame:
    return _latest(t).select("event_id", *_STATE)


@_query(
    """
SELECT user_id AS executor_id, min(event_id) AS event_id FROM events WHERE event_type = 'view'
GROUP BY user_id
"""
)
def first_heartbeat(t: Tables) -> DataFrame:
    return telemetry.first_heartbeat(t.heartbeats(), ["hb_ts", "event_id"]).select("executor_id", "event_id")


@_query(
    """
SELECT user_id AS executor_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS history_pos
FROM events WHERE event_type = 'view'
"""
)
def heartbeat_history(t: Tables) -> DataFrame:
    history = telemetry.heartbeat_history(t.heartbeats(), ["hb_ts", "event_id"])
    return history.select("executor_id", "event_id", "history_pos")


@_query(
    """
WITH flat AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
  FROM events WHERE event_type = 'view')
SELECT user_id AS executor_id, (pos - 1) // 5 AS page_no,
  string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos) AS event_ids
FROM flat GROUP BY 1, 2
"""
)
def heartbeat_history_paged(t: Tables) -> DataFrame:
    paged = telemetry.heartbeat_history(t.heartbeats(), ["hb_ts", "event_id"], page=5)
    ids = F.concat_ws(",", F.col("history.event_id").cast("array<string>"))
    return paged.select("executor_id", "page_no", ids.alias("event_ids"))


@_query(
    """
WITH done AS (SELECT user_id, ts FROM events WHERE event_type <> 'view')
SELECT user_id AS executor_id,
  (epoch_us(max(ts)) - (SELECT epoch_us(min(ts)) FROM done)) / CAST(1000000 AS DOUBLE) AS total_seconds
FROM done GROUP BY user_id
"""
)
def completion_report(t: Tables) -> DataFrame:
    return telemetry.completion_report(t.completions())


@_query(
    """
WITH q AS (
  SELECT o_custkey AS queue_id, count(*) FILTER (o_orderstatus = 'O') AS remaining,
    count(*) AS batch_size, count(*) FILTER (o_orderstatus = 'P') AS pool_size
  FROM orders GROUP BY o_custkey)
SELECT *, remaining <= sqrt(batch_size) AND pool_size > 0 AS due_sqrt,
  remaining <= batch_size // 3 AND pool_size > 0 AS due_third,
  remaining = 0 AND pool_size > 0 AS due_empty
FROM q
"""
)
def refill_due(t: Tables) -> DataFrame:
    def with_status(status: str):
        return F.count_if(F.col("o_orderstatus") == status)

    queues = (
        t.table("orders")
        .groupBy(F.col("o_custkey").alias("queue_id"))
        .agg(
            with_status("O").alias("remaining"),
            F.count(F.lit(1)).alias("batch_size"),
            with_status("P").alias("pool_size"),
        )
    )
    for rule in ("sqrt", "third", "empty"):
        queues = telemetry.refill_due(queues, rule, f"due_{rule}")
    return queues


# Ranking ---------------------------------------------------------------------------------------------


@_query(f"{_SNAPSHOT_SQL} SELECT executor_id, remaining FROM latest WHERE remaining > 0")
def with_work_left(t: Tables) -> DataFrame:
    return ranking.with_work_left(_latest(t, "remaining")).select("executor_id", "remaining")


@_query(
    f"""{_SNAPSHOT_SQL}
SELECT executor_id, remaining FROM latest WHERE remaining > 0
ORDER BY remaining DESC, executor_id LIMIT 2"""
)
def top_remaining(t: Tables) -> DataFrame:
    return ranking.top_remaining(_latest(t, "remaining"))


@_query(
    f"""{_SNAPSHOT_SQL}
SELECT max(executor_id) AS executor_id, avg_rate FROM latest WHERE remaining > 0
GROUP BY avg_rate ORDER BY avg_rate DESC LIMIT 2"""
)
def top_rate(t: Tables) -> DataFrame:
    return ranking.top_rate(_latest(t, "remaining", "avg_rate"))


_PICKED_SQL = """,
top AS (
  SELECT executor_id AS victim, row_number() OVER (ORDER BY remaining DESC, executor_id) AS place
  FROM latest WHERE remaining > 0 ORDER BY remaining DESC, executor_id LIMIT 2),
picked AS (
  SELECT executor_id, remaining,
    (SELECT arg_min(victim, place) FROM top WHERE victim <> executor_id) AS victim
  FROM latest)"""


@_query(f"{_SNAPSHOT_SQL}{_PICKED_SQL} SELECT executor_id, remaining, victim FROM picked")
def pick_victim(t: Tables) -> DataFrame:
    return ranking.pick_victim(_latest(t, "remaining", store=True))


# Redistribution --------------------------------------------------------------------------------------

_SMALL = "SELECT o_orderkey AS item_id, o_custkey AS queue_id FROM orders"
_LARGE = "SELECT o_orderkey AS item_id, o_custkey % 8 AS queue_id FROM orders"

_K_SQL = {
    "quarter": "n // 4 + 1",
    "square": "CAST(floor((sqrt(1 + 4 * n) - 1) / 2) AS BIGINT) + 1",
    "capped": "least(2, n // 4 + 1)",
}


def _split_sql(items: str, k: str) -> str:
    return f"""
WITH items AS ({items}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY item_id) AS r,
    count(*) OVER (PARTITION BY queue_id) AS n FROM items),
split AS (SELECT *, CAST({_K_SQL[k]} AS BIGINT) AS k FROM ranked)
SELECT item_id, queue_id,
  CASE WHEN r > k THEN 'kept' WHEN k = n THEN 'pending' ELSE 'moved' END AS status,
  CASE WHEN r <= k THEN k - r + 1 END AS batch_pos
FROM split"""


def _split(items: DataFrame, *args) -> DataFrame:
    return rebalance.split_head(items, *args).select("item_id", "queue_id", "status", "batch_pos")


@_query("SELECT o_custkey AS queue_id, count(*) AS size FROM orders GROUP BY o_custkey")
def queue_sizes(t: Tables) -> DataFrame:
    return rebalance.queue_sizes(t.queues())


@_query(
    """
SELECT o_custkey AS queue_id, min(o_orderkey) AS pos, min(o_orderkey) AS item_id,
  CAST(floor(arg_min(o_totalprice, o_orderkey)) AS BIGINT) AS cost_ms
FROM orders GROUP BY o_custkey
"""
)
def queue_heads(t: Tables) -> DataFrame:
    return rebalance.queue_heads(t.queues())


@_query(
    f"""
SELECT item_id, queue_id FROM ({_SMALL}) i
WHERE queue_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""
)
def lookup_executor(t: Tables) -> DataFrame:
    wanted = t.task_sets().select(F.col("task_set_id").alias("executor_id"))
    return rebalance.lookup_executor(t.queues(), wanted).select("item_id", "queue_id")


@_query(_split_sql(_SMALL, "quarter"))
def split_head(t: Tables) -> DataFrame:
    return _split(t.queues())


@_query(_split_sql(_LARGE, "quarter"))
def split_head_large_queues(t: Tables) -> DataFrame:
    return _split(t.large_queues())


@_query(_split_sql(_LARGE, "quarter"))
def split_head_in_blocks(t: Tables) -> DataFrame:
    split = rebalance.split_head(t.large_queues(), rows_per_block=_BLOCK_ROWS)
    return split.select("item_id", "queue_id", "status", "batch_pos")


@_query(_split_sql(_SMALL, "square"))
def split_head_square(t: Tables) -> DataFrame:
    return _split(t.queues(), "square")


@_query(_split_sql(_SMALL, "capped"))
def split_head_capped(t: Tables) -> DataFrame:
    return _split(t.queues(), "quarter", 2)


_POOL_SQL = """
pool AS (
  SELECT o_orderkey AS item_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord,
    count(*) OVER () AS n FROM orders)"""


@_query(
    f"WITH {_POOL_SQL} SELECT item_id, n // 4 + 1 - ord AS batch_pos FROM pool WHERE ord < n // 4 + 1"
)
def draw_from_pool(t: Tables) -> DataFrame:
    return rebalance.draw_from_pool(t.pool()).select("item_id", "batch_pos")


@_query(f"WITH {_POOL_SQL} SELECT item_id, 1 - ord AS batch_pos FROM pool WHERE ord = 0")
def draw_one_from_pool(t: Tables) -> DataFrame:
    return rebalance.draw_from_pool(t.pool(), "one").select("item_id", "batch_pos")


@_query(
    f"""
WITH {_POOL_SQL}
SELECT item_id, ord - (n - (n // 4 + 1)) + 1 AS batch_pos FROM pool WHERE ord >= n - (n // 4 + 1)
"""
)
def draw_from_pool_tail(t: Tables) -> DataFrame:
    return rebalance.draw_from_pool(t.pool(), from_tail=True).select("item_id", "batch_pos")


def _chunk_sql(count: str) -> str:
    return f"""
chunks(chunk_id, lo, hi, n) AS (
  SELECT 1, 0, n // 4 + 1, n FROM ({count}) c
  UNION ALL SELECT chunk_id + 1, hi, hi + (n - hi) // 4 + 1, n FROM chunks WHERE hi < n)"""


@_query(
    f"""
WITH RECURSIVE {_POOL_SQL}, {_chunk_sql("SELECT count(*) AS n FROM orders")}
SELECT item_id, CAST(chunk_id AS BIGINT) AS chunk_id, hi - ord AS batch_pos
FROM pool JOIN chunks ON ord >= lo AND ord < hi
"""
)
def guided_chunks(t: Tables) -> DataFrame:
    return rebalance.guided_chunks(t.pool()).select("item_id", "chunk_id", "batch_pos")


@_query(
    f"WITH {_POOL_SQL} SELECT item_id, CASE WHEN ord < 9 THEN ord // 3 + 1 END AS executor_id FROM pool"
)
def deal_initial(t: Tables) -> DataFrame:
    return rebalance.deal_initial(t.pool()).select("item_id", "executor_id")


@_query(
    f"""WITH {_POOL_SQL}
SELECT item_id, CASE WHEN ord < n // 4 + 1 THEN 'taken' ELSE 'left' END AS status,
  CASE WHEN ord < n // 4 + 1 THEN n // 4 + 1 - ord END AS batch_pos FROM pool"""
)
def draw_and_rest(t: Tables) -> DataFrame:
    drawn = rebalance.draw_from_pool(t.pool(), keep_rest=True)
    return drawn.select("item_id", "status", "batch_pos")


_TAKE_SQL = f"""
WITH items AS ({_SMALL}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY item_id) AS r,
    count(*) OVER (PARTITION BY queue_id) AS n FROM items)
SELECT item_id, queue_id FROM ranked WHERE """


@_query(_TAKE_SQL + "r <= floor(0.5 * n)")
def take_fraction(t: Tables) -> DataFrame:
    return rebalance.take_fraction(t.queues()).select("item_id", "queue_id")


@_query(_TAKE_SQL + "floor(0.5 * n) >= 1")
def take_fraction_as_coded(t: Tables) -> DataFrame:
    return rebalance.take_fraction(t.queues(), mode="as_coded").select("item_id", "queue_id")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 99 AS id FROM orders")
def assign_ids(t: Tables) -> DataFrame:
    rows = t.table("orders").select("o_orderdate", "o_orderkey")
    return ordinals.assign_ids(rows, ["o_orderdate", "o_orderkey"], start=100).select("o_orderkey", "id")


_APPEND_SQL = """
WITH old AS (
  SELECT o_orderkey AS item_id, o_custkey % 8 AS queue_id,
    row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS pos
  FROM orders WHERE o_orderstatus <> 'F'),
tails AS (SELECT queue_id, max(pos) AS tail FROM old GROUP BY queue_id),
new AS (
  SELECT o_orderkey AS item_id, {to} AS queue_id,
    row_number() OVER (PARTITION BY {to} ORDER BY o_orderkey) AS r
  FROM orders WHERE o_orderstatus = 'F')
SELECT item_id, queue_id, pos FROM old
UNION ALL
SELECT item_id, queue_id, coalesce(tail, 0) + r FROM new LEFT JOIN tails USING (queue_id)
"""
_PART_THIEF = "o_orderkey % 10"


def _old_queues(t: Tables) -> DataFrame:
    items = t.table("orders").where("o_orderstatus <> 'F'")
    items = items.select(
        F.col("o_orderkey").alias("item_id"),
        (F.col("o_custkey") % 8).alias("queue_id"),
        F.col("o_orderkey").alias("_order"),
        F.floor("o_totalprice").cast("long").alias("cost_ms"),
    )
    numbered = ordinals.running_totals(items, ["queue_id"], ["_order"], {"pos": F.lit(1)})
    return numbered.select("item_id", "queue_id", "pos", "cost_ms")


def _new_items(t: Tables) -> DataFrame:
    """Finished orders as items that arrive in key order; queues 8 and 9 are empty before."""
    return (
        t.table("orders")
        .where("o_orderstatus = 'F'")
        .select(
            F.col("o_orderkey").alias("item_id"),
            (F.col("o_custkey") % 8).alias("victim_id"),
            (F.col("o_orderkey") % 10).alias("thief_id"),
            F.col("o_orderkey").alias("pos"),
            F.floor("o_totalprice").cast("long").alias("cost_ms"),
        )
    )


@_query(_APPEND_SQL.format(to="o_custkey % 8"))
def append_items(t: Tables) -> DataFrame:
    new = _new_items(t).withColumnRenamed("victim_id", "queue_id").drop("thief_id")
    return rebalance.append_items(_old_queues(t), new).select("item_id", "queue_id", "pos")


@_query(_APPEND_SQL.format(to=_PART_THIEF))
def receive_items(t: Tables) -> DataFrame:
    queues, _ = rebalance.receive_items(_old_queues(t), _new_items(t), t.move_log())
    return queues.select("item_id", "queue_id", "pos")


_COUNTS_SQL = """,
sides AS (
  SELECT thief_id AS executor_id, 1 AS b, 0 AS f FROM log
  UNION ALL SELECT victim_id, 0, 1 FROM log)
SELECT executor_id, CAST(sum(b) AS BIGINT) AS stolen_by, CAST(sum(f) AS BIGINT) AS stolen_from
FROM sides GROUP BY executor_id"""
_MOVE_LOG_SQL = """
  SELECT o_orderkey AS item_id, (o_custkey + o_orderkey) % 8 AS victim_id, o_custkey % 8 AS thief_id
  FROM orders WHERE (o_custkey + o_orderkey) % 8 <> o_custkey % 8"""


@_query(f"WITH log AS ({_MOVE_LOG_SQL}){_COUNTS_SQL}")
def steal_counts(t: Tables) -> DataFrame:
    return rebalance.steal_counts(t.move_log())


@_query(
    f"""
WITH log AS ({_MOVE_LOG_SQL}
  UNION ALL SELECT o_orderkey, o_custkey % 8, {_PART_THIEF} FROM orders WHERE o_orderstatus = 'F'){_COUNTS_SQL}
"""
)
def receive_items_counts(t: Tables) -> DataFrame:
    _, log = rebalance.receive_items(_old_queues(t), _new_items(t), t.move_log())
    return rebalance.steal_counts(log)


# Needs `items(item_id, queue_id)` in item order and `moves(victim_id, thief_id)`.
_STEAL_SQL = """,
pairs AS (
  SELECT victim_id, min(thief_id) AS thief_id FROM moves WHERE victim_id <> thief_id GROUP BY victim_id),
sizes AS (SELECT queue_id, count(*) AS n FROM items GROUP BY queue_id),
given AS (
  SELECT victim_id, thief_id, CASE WHEN n // 4 + 1 = n THEN 0 ELSE n // 4 + 1 END AS k
  FROM pairs JOIN sizes ON queue_id = victim_id),
grants AS (
  SELECT g.victim_id, g.thief_id, g.k,
    coalesce(s.n, 0) - coalesce(own.k, 0)
      + sum(g.k) OVER (PARTITION BY g.thief_id ORDER BY g.victim_id ROWS UNBOUNDED PRECEDING) - g.k AS ahead
  FROM given g LEFT JOIN sizes s ON s.queue_id = g.thief_id
  LEFT JOIN given own ON own.victim_id = g.thief_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY item_id) AS r FROM items),
after AS (
  SELECT item_id, CASE WHEN r <= k THEN thief_id ELSE queue_id END AS queue_id,
    CAST(CASE WHEN r <= k THEN ahead + k - r + 1 ELSE r - coalesce(k, 0) END AS BIGINT) AS pos,
    coalesce(r <= k, FALSE) AS moved, victim_id, thief_id
  FROM ranked LEFT JOIN grants ON victim_id = queue_id)"""
_STEAL_ORDERS_SQL = f"""
WITH items AS ({_LARGE}),
moves AS (
  SELECT DISTINCT o_custkey % 8 AS victim_id, o_custkey % 8 + 4 AS thief_id FROM orders
  WHERE o_custkey % 8 < 4){_STEAL_SQL}"""


@_query(f"{_STEAL_ORDERS_SQL} SELECT item_id, queue_id, pos FROM after")
def steal_move(t: Tables) -> DataFrame:
    return rebalance.steal_move(t.large_queues(), t.moves()).select("item_id", "queue_id", "pos")


@_query(f"{_STEAL_ORDERS_SQL} SELECT item_id, queue_id, pos FROM after")
def steal_move_in_blocks(t: Tables) -> DataFrame:
    moved = rebalance.steal_move(t.large_queues(), t.moves(), rows_per_block=_BLOCK_ROWS)
    return moved.select("item_id", "queue_id", "pos")


@_query(f"{_STEAL_ORDERS_SQL} SELECT item_id, victim_id, thief_id FROM after WHERE moved")
def moved_items(t: Tables) -> DataFrame:
    return rebalance.moved_items(t.large_queues(), t.moves())


@_query(
    f"""
WITH items AS ({_SMALL}),
moves AS (SELECT o_custkey AS victim_id, (o_orderkey * 7) % 100 AS thief_id FROM orders){_STEAL_SQL}
SELECT item_id, queue_id, pos FROM after
"""
)
def steal_move_many(t: Tables) -> DataFrame:
    """Every queue a victim, with competing thieves that are mostly victims too."""
    moves = t.table("orders").select(
        F.col("o_custkey").alias("victim_id"), (F.col("o_orderkey") * 7 % 100).alias("thief_id")
    )
    return rebalance.steal_move(t.queues(), moves).select("item_id", "queue_id", "pos")


# Shuffle metrics -------------------------------------------------------------------------------------

_DEPS_SQL = """
deps AS (
  SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS dep_id,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS fetch_wait_ms, CAST(l_quantity AS BIGINT) AS local_blocks,
    CAST(l_linenumber AS BIGINT) AS remote_blocks, CAST(round(l_tax * 100) AS BIGINT) AS remote_bytes,
    date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS shuffle_finish_ms
  FROM lineitem)"""
_MERGED_SQL = """
merged AS (
  SELECT task_id, CAST(sum(fetch_wait_ms) AS BIGINT) AS fetch_wait_ms,
    CAST(sum(local_blocks) AS BIGINT) AS local_blocks, CAST(sum(remote_blocks) AS BIGINT) AS remote_blocks,
    CAST(sum(remote_bytes) AS BIGINT) AS remote_bytes,
    greatest(-1, max(shuffle_finish_ms)) AS shuffle_finish_ms
  FROM deps GROUP BY task_id)"""


@_query(f"WITH {_DEPS_SQL} SELECT *, remote_blocks + local_blocks AS total_blocks FROM deps")
def with_total_blocks(t: Tables) -> DataFrame:
    return shuffle_metrics.with_total_blocks(t.shuffle_deps())


@_query(f"WITH {_DEPS_SQL}, {_MERGED_SQL} SELECT * FROM merged")
def merge_shuffle_reads(t: Tables) -> DataFrame:
    return shuffle_metrics.merge_shuffle_reads(t.shuffle_deps())


@_query(
    f"""
WITH {_DEPS_SQL}, {_MERGED_SQL}
SELECT o_orderkey AS task_id, coalesce(fetch_wait_ms, 0) AS fetch_wait_ms,
  coalesce(local_blocks, 0) AS local_blocks, coalesce(remote_blocks, 0) AS remote_blocks,
  coalesce(remote_bytes, 0) AS remote_bytes, coalesce(shuffle_finish_ms, -1) AS shuffle_finish_ms
FROM orders LEFT JOIN merged ON task_id = o_orderkey
"""
)
def merge_shuffle_reads_all_tasks(t: Tables) -> DataFrame:
    return shuffle_metrics.merge_shuffle_reads(t.shuffle_deps(), t.tasks())


@_query(f"WITH {_DEPS_SQL}, {_MERGED_SQL} SELECT * FROM merged")
def merge_shuffle_reads_nested(t: Tables) -> DataFrame:
    """Each order as a task with its lines in an array: the rows of `merge_shuffle_reads`."""
    record = F.struct(*[c for c in t.shuffle_deps().columns if c not in ("task_id", "dep_id")])
    nested = t.shuffle_deps().groupBy("task_id").agg(F.collect_list(record).alias("deps"))
    return shuffle_metrics.merge_shuffle_reads_nested(nested).drop("deps")


@_query(
    f"""
WITH {_DEPS_SQL}
SELECT task_id, dep_id, remote_bytes, o_custkey AS task_set_id, c_custkey % 10 AS stage_id,
  CAST(0 AS BIGINT) AS attempt
FROM deps JOIN orders ON o_orderkey = task_id JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING'
"""
)
def enrich_task_metrics(t: Tables) -> DataFrame:
    metrics = t.shuffle_deps().select("task_id", "dep_id", "remote_bytes")
    return shuffle_metrics.enrich_task_metrics(metrics, t.tasks(), t.task_sets())


# Topology --------------------------------------------------------------------------------------------

_EXECUTORS_SQL = """
WITH executors AS (
  SELECT s_suppkey AS executor_id, n_name AS host, r_name AS rack, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@_query(
    f"""{_EXECUTORS_SQL}
SELECT host, (n - 1) // 3 AS page_no,
  string_agg(CAST(executor_id AS VARCHAR), ',' ORDER BY executor_id) AS executor_ids
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY executor_id) AS n FROM executors) x
GROUP BY host, page_no"""
)
def executors_on_host(t: Tables) -> DataFrame:
    ids = F.concat_ws(",", F.col("executor_ids").cast("array<string>"))
    return topology.executors_on_host(t.executors(), page=3).withColumn("executor_ids", ids)


@_query(
    f"""{_EXECUTORS_SQL}
SELECT n_name AS host FROM nation WHERE n_name IN (SELECT host FROM executors WHERE s_acctbal > 5000)"""
)
def hosts_alive(t: Tables) -> DataFrame:
    requested = t.table("nation").select(F.col("n_name").alias("host"))
    return topology.hosts_alive(requested, t.executors().where("s_acctbal > 5000"))


@_query(
    f"""{_EXECUTORS_SQL}
SELECT r_name AS rack FROM region WHERE r_name IN (SELECT rack FROM executors WHERE s_acctbal > 9500)"""
)
def racks_alive(t: Tables) -> DataFrame:
    requested = t.table("region").select(F.col("r_name").alias("rack"))
    return topology.racks_alive(requested, t.executors().where("s_acctbal > 9500"))


@_query(
    """
SELECT DISTINCT l_suppkey AS executor_id FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
"""
)
def executors_alive(t: Tables) -> DataFrame:
    requested = t.table("lineitem").select(F.col("l_suppkey").alias("executor_id")).distinct()
    return topology.executors_alive(requested, t.executors())


@_query(
    """
SELECT c_custkey, n_name AS host, r_name AS rack
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'
"""
)
def with_rack(t: Tables) -> DataFrame:
    nation, region = t.table("nation"), t.table("region").where("r_name <> 'ASIA'")
    rack_map = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("host"), F.col("r_name").alias("rack")
    )
    hosts = t.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    hosts = hosts.select("c_custkey", F.col("n_name").alias("host"))
    return topology.with_rack(hosts, rack_map).select("c_custkey", "host", "rack")


@_query(
    """
SELECT DISTINCT user_id AS executor_id FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
"""
)
def unknown_executors(t: Tables) -> DataFrame:
    senders = t.table("events").select(F.col("user_id").alias("executor_id"))
    registered = t.table("supplier").select(F.col("s_suppkey").alias("executor_id"))
    return topology.unknown_executors(senders, registered)


@_query(f"{_EXECUTORS_SQL} SELECT executor_id, host, rack FROM executors WHERE NOT s_acctbal < 0")
def drop_lost_executors(t: Tables) -> DataFrame:
    lost = t.table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("executor_id"))
    return topology.drop_lost_executors(t.executors(), lost).select("executor_id", "host", "rack")


# Flows -----------------------------------------------------------------------------------------------


@_query(
    f"""
WITH RECURSIVE {_POOL_SQL}, {_chunk_sql("SELECT count(*) - 9 AS n FROM orders")}
SELECT item_id, CASE WHEN ord < 9 THEN ord // 3 + 1 END AS executor_id,
  CAST(coalesce(chunk_id, 0) AS BIGINT) AS chunk_id, hi - (ord - 9) AS batch_pos
FROM pool LEFT JOIN chunks ON ord - 9 >= lo AND ord - 9 < hi
"""
)
def pool_schedule(t: Tables) -> DataFrame:
    schedule = flows.pool_schedule(t.pool())
    return schedule.select("item_id", "executor_id", "chunk_id", "batch_pos")


# Ten executors. Every third has many open orders; the others have urgent ones only and are due.
_REFILL_SQL = f"""
WITH RECURSIVE queue AS (
  SELECT o_orderkey AS item_id, o_custkey % 10 AS queue_id, o_orderkey AS pos FROM orders
  WHERE (o_orderstatus = 'O' AND o_custkey % 10 % 3 = 0)
    OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')),
pool AS (
  SELECT o_orderkey AS item_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord
  FROM orders WHERE o_orderstatus = 'F'),
{_chunk_sql("SELECT count(*) AS n FROM pool")},
state AS (SELECT o_custkey % 10 AS executor_id, count(*) AS batch_size FROM orders GROUP BY 1),
due AS (
  SELECT executor_id, row_number() OVER (ORDER BY executor_id) AS turn
  FROM state LEFT JOIN (SELECT queue_id, count(*) AS n FROM queue GROUP BY queue_id) q ON queue_id = executor_id
  WHERE coalesce(n, 0) <= sqrt(batch_size) AND (SELECT count(*) FROM pool) > 0),
tails AS (SELECT queue_id, max(pos) AS tail FROM queue GROUP BY queue_id)"""


def _refill(t: Tables) -> tuple[DataFrame, DataFrame]:
    owner = F.col("o_custkey") % 10
    orders = t.table("orders").withColumn("owner", owner)
    is_open = (F.col("o_orderstatus") == "O") & (F.col("owner") % 3 == 0)
    is_queued = is_open | ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
    state = orders.groupBy(F.col("owner").alias("executor_id")).agg(
        F.count_if(is_queued).alias("remaining"), F.count(F.lit(1)).alias("batch_size")
    )
    key = F.col("o_orderkey")
    queues = orders.where(is_queued).select(key.alias("item_id"), F.col("owner").alias("queue_id"), key.alias("pos"))
    pool = orders.where("o_orderstatus = 'F'").select(key.alias("item_id"))
    return flows.refill_round(state, queues, pool)


@_query(
    f"""{_REFILL_SQL}
SELECT item_id, queue_id, pos FROM queue
UNION ALL
SELECT item_id, executor_id, coalesce(tail, 0) + hi - ord FROM pool JOIN chunks ON ord >= lo AND ord < hi
JOIN due ON turn = chunk_id LEFT JOIN tails ON queue_id = executor_id"""
)
def refill_round(t: Tables) -> DataFrame:
    return _refill(t)[0]


@_query(
    f"""{_REFILL_SQL}
SELECT item_id FROM pool JOIN chunks ON ord >= lo AND ord < hi WHERE chunk_id > (SELECT count(*) FROM due)"""
)
def refill_round_rest(t: Tables) -> DataFrame:
    return _refill(t)[1]


@_query(
    f"""{_SNAPSHOT_SQL}{_PICKED_SQL},
items AS (
  SELECT event_id AS item_id, user_id AS queue_id FROM events WHERE event_type = 'view'),
moves AS (SELECT victim AS victim_id, executor_id AS thief_id FROM picked WHERE victim IS NOT NULL){_STEAL_SQL}
SELECT item_id, queue_id, pos FROM after
"""
)
def steal_round(t: Tables) -> DataFrame:
    """The items open at the end of the log, after one round of stealing."""
    queues = flows.steal_round(_latest(t, "remaining", store=True), t.open_items())
    return queues.select("item_id", "queue_id", "pos")


# Thieves have less than the average left. Needs `latest`.
_MATCHED_SQL = """,
asked AS (SELECT executor_id, remaining, remaining < (SELECT avg(remaining) FROM latest) AS asks FROM latest),
matched AS (
  SELECT v.executor_id AS victim_id, t.executor_id AS thief_id, v.rank
  FROM (SELECT *, row_number() OVER (ORDER BY remaining DESC, executor_id) AS rank FROM asked
    WHERE NOT asks AND remaining > 0) v
  JOIN (SELECT *, row_number() OVER (ORDER BY remaining, executor_id) AS rank FROM asked WHERE asks) t
    ON t.rank = v.rank)"""


@_query(f"{_SNAPSHOT_SQL}{_MATCHED_SQL} SELECT * FROM matched")
def match_by_rank(t: Tables) -> DataFrame:
    latest = _latest(t, "remaining", store=True)
    average = latest.agg(F.avg("remaining").alias("a")).scalar()
    return ranking.match_by_rank(latest, F.col("remaining") < average)


@_query(
    f"""{_SNAPSHOT_SQL}{_MATCHED_SQL},
items AS (
  SELECT event_id AS item_id, user_id AS queue_id FROM events WHERE event_type = 'view'),
moves AS (SELECT victim_id, thief_id FROM matched){_STEAL_SQL}
SELECT item_id, queue_id, pos FROM after
"""
)
def steal_round_by_rank(t: Tables) -> DataFrame:
    """The items open at the end of the log, after a round in which each thief has a victim of its own."""
    latest = _latest(t, "remaining", store=True)
    average = latest.agg(F.avg("remaining").alias("a")).scalar()
    queues, _ = flows.steal_rounds(latest, t.open_items(), F.col("remaining") < average, rounds=1)
    return queues.select("item_id", "queue_id", "pos")


# Sources ---------------------------------------------------------------------------------------------


@_query("SELECT CAST(floor(o_totalprice) AS BIGINT) AS cost_ms FROM orders")
def read_costs(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "costs")
    t.pool().select(F.col("cost_ms").cast("string")).write.text(path)
    return costs.read_costs(t.spark, path)


@_query(
    """
WITH numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS item_id FROM orders)
SELECT o_orderkey, item_id, item_id + 1 AS pos,
  CAST('0x' || substr(md5('7:' || CAST(item_id AS VARCHAR)), 1, 12) AS BIGINT) % 200 AS cost_ms
FROM numbered
"""
)
def gen_work_items(t: Tables) -> DataFrame:
    """A drawn cost for every order, in key order."""
    keys = ordinals.assign_ids(t.table("orders").select("o_orderkey"), ["o_orderkey"])
    drawn = costs.gen_work_items(t.spark, t.table("orders").count(), bound=200, seed=7)
    return drawn.join(keys, F.col("item_id") == F.col("id")).select("o_orderkey", "item_id", "pos", "cost_ms")


@_query(
    """
SELECT o_orderkey AS item_id, o_custkey AS queue_id, o_orderkey AS pos,
  CAST(floor(o_totalprice) AS BIGINT) AS cost_ms
FROM orders
"""
)
def load_work_items(t: Tables) -> DataFrame:
    return tables.load_work_items(t.spark, _written(t, t.queues(), "work-items"))


@_query(
    f"""{_FULL_SQL}
SELECT {_STATE_SQL}, epoch_us(ts) AS hb_us, CAST(0 AS BIGINT) AS stolen_by, CAST(0 AS BIGINT) AS stolen_from
FROM progress"""
)
def load_heartbeats(t: Tables) -> DataFrame:
    loaded = tables.load_heartbeats(t.spark, _written(t, _progress(t), "heartbeats"))
    return loaded.select(*_STATE, F.unix_micros("hb_ts").alias("hb_us"), "stolen_by", "stolen_from")


@_query(
    """
SELECT event_id AS item_id, user_id AS executor_id, epoch_us(ts) AS finish_us FROM events
WHERE event_type <> 'view'
"""
)
def load_completions(t: Tables) -> DataFrame:
    loaded = tables.load_completions(t.spark, _written(t, t.completions(), "completions"))
    return loaded.select("item_id", "executor_id", F.unix_micros("finish_ts").alias("finish_us"))


@_query(
    """
SELECT o_orderkey AS task_id, 'host' || CAST(o_custkey % 25 AS VARCHAR) AS hostname,
  CAST(floor(o_totalprice) AS BIGINT) % 7 AS executor_deserialize_ms,
  CAST(floor(o_totalprice) AS BIGINT) AS executor_run_ms,
  CAST(floor(o_totalprice) AS BIGINT) * 3 AS result_size_bytes,
  CAST(floor(o_totalprice) AS BIGINT) % 11 AS jvm_gc_ms, CAST(0 AS BIGINT) AS result_serialization_ms,
  CAST(0 AS BIGINT) AS memory_bytes_spilled, CAST(0 AS BIGINT) AS disk_bytes_spilled,
  CAST(0 AS BIGINT) AS remote_blocks, CAST(floor(o_totalprice) AS BIGINT) AS bytes,
  CASE o_orderkey % 4 WHEN 0 THEN 'Memory' WHEN 1 THEN 'Disk' WHEN 2 THEN 'Hadoop' ELSE 'Network' END
    AS read_method,
  CAST(floor(o_totalprice) AS BIGINT) AS bytes_read, CAST(floor(o_totalprice) AS BIGINT) * 1000 AS write_ns
FROM orders
"""
)
def load_task_metrics(t: Tables) -> DataFrame:
    loaded = tables.load_task_metrics(t.spark, _written(t, t.task_metrics(), "task-metrics"))
    return loaded.select(
        "task_id",
        "hostname",
        "executor_deserialize_ms",
        "executor_run_ms",
        "result_size_bytes",
        "jvm_gc_ms",
        "result_serialization_ms",
        "memory_bytes_spilled",
        "disk_bytes_spilled",
        "shuffle_read.remote_blocks",
        "shuffle_write.bytes",
        "input.read_method",
        "input.bytes_read",
        "shuffle_write.write_ns",
    )


@_query(f"WITH {_DEPS_SQL} SELECT * FROM deps")
def load_shuffle_deps(t: Tables) -> DataFrame:
    return tables.load_shuffle_deps(t.spark, _written(t, t.shuffle_deps(), "shuffle-deps"))


@_query(f"{_EXECUTORS_SQL} SELECT executor_id, host, rack, s_acctbal > 5000 AS active FROM executors")
def load_executors(t: Tables) -> DataFrame:
    return tables.load_executors(t.spark, _written(t, t.executors(), "executors"))


@_query("SELECT o_orderkey AS task_id, o_custkey AS task_set_id, o_orderkey % 100 AS executor_id FROM orders")
def load_tasks(t: Tables) -> DataFrame:
    owned = t.tasks().withColumn("executor_id", F.col("task_id") % 100)
    return tables.load_tasks(t.spark, _written(t, owned, "tasks"))


@_query(
    """
SELECT DISTINCT o_custkey % 8 AS victim_id, o_custkey % 8 + 4 AS thief_id FROM orders
WHERE o_custkey % 8 < 4
"""
)
def load_moves(t: Tables) -> DataFrame:
    return tables.load_moves(t.spark, _written(t, t.moves(), "moves"))


# Streams ---------------------------------------------------------------------------------------------


@_query(
    f"""{_FULL_SQL}
SELECT {_STATE_SQL} FROM progress QUALIFY row_number() OVER (PARTITION BY executor_id ORDER BY hb_seq DESC) = 1"""
)
def stream_latest(t: Tables) -> DataFrame:
    stream = tables.stream_heartbeats(t.spark, _written(t, _progress(t), "heartbeats"))
    return live.latest_table(stream, scratch_dir(t.spark, "latest")).select(*_STATE)


@_query(
    f"""{_SNAPSHOT_SQL}
SELECT executor_id, remaining FROM latest WHERE remaining > 0
ORDER BY remaining DESC, executor_id LIMIT 5"""
)
def stream_top(t: Tables) -> DataFrame:
    """The executors with most work left, from candidates kept up to date over several batches."""
    log = _progress(t).select("executor_id", "hb_ts", "hb_seq", "remaining")
    stream = _stream(t, log, "heartbeats", "events", ["hb_seq", "executor_id"], parts=3)
    return live.top_table(stream, scratch_dir(t.spark, "top"), k=5, buckets=8)[0]


@_query(
    """
SELECT DISTINCT user_id AS executor_id FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
"""
)
def stream_unknown_senders(t: Tables) -> DataFrame:
    beats = t.heartbeats().union(t.completions().select("executor_id", "finish_ts", "event_id"))
    senders = beats.select("executor_id", "event_id")
    stream = _stream(t, senders, "senders", "events", ["event_id"], parts=3, per_batch=2)
    # Opened once for each batch.
    registered = lambda: t.spark.read.parquet(f"{t.folder}/supplier.parquet").select(F.col("s_suppkey").alias("executor_id"))
    return live.unknown_senders(stream, registered, scratch_dir(t.spark, "unknown")).select("executor_id").distinct()


@_query(
    f"""
WITH {_DEPS_SQL}
SELECT task_id, dep_id, remote_bytes, o_custkey AS task_set_id, c_custkey % 10 AS stage_id,
  CAST(0 AS BIGINT) AS attempt
FROM deps JOIN orders ON o_orderkey = task_id JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING'
"""
)
def stream_enriched_metrics(t: Tables) -> DataFrame:
    metrics = t.shuffle_deps().select("task_id", "dep_id", "remote_bytes")
    stream = _stream(t, metrics, "metrics", "lineitem", ["dep_id", "task_id"], parts=2)
    target = scratch_dir(t.spark, "enriched")
    return live.enriched_metrics(stream, t.tasks, t.task_sets, target).drop("batch")


@_query(f"WITH {_DEPS_SQL}, {_MERGED_SQL} SELECT * FROM merged")
def stream_merged_reads(t: Tables) -> DataFrame:
    """Every third record comes with wrong counters first and is corrected later, or before."""
    # Lines of an order share numbers; with the price and the other counters they are told apart.
    number = F.xxhash64("dep_id", "fetch_wait_ms", "local_blocks", "remote_bytes", "shuffle_finish_ms")
    deps = t.shuffle_deps().withColumns({"dep_id": number, "update_seq": F.lit(2).cast("long")})
    wrong = deps.where("abs(task_id + dep_id % 7) % 3 = 0").withColumns(
        {"remote_bytes": F.lit(10**9).cast("long"), "update_seq": F.lit(1).cast("long")}
    )
    stream = _stream(t, deps.unionByName(wrong), "deps", "lineitem", ["task_id", "dep_id", "update_seq"], parts=3)
    return live.merged_reads_table(stream, scratch_dir(t.spark, "merged"), buckets=8)


@_query(
    f"""{_FULL_SQL}
SELECT executor_id, hb_seq, processed, delta, avg_rate, FALSE AS gap FROM progress"""
)
def stream_progress(t: Tables) -> DataFrame:
    """Over a log in which every third heartbeat comes twice."""
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("hb_seq") % 3 == 0, 2).otherwise(1)))
    log = _progress(t).select("*", twice.alias("_copy")).drop("_copy")
    stream = tables.stream_heartbeats(t.spark, _written(t, log, "heartbeats"), maxFilesPerTrigger=4)
    return progress.progress_table(stream, scratch_dir(t.spark, "progress"), buckets=8).drop("hb_ts")


@_query(
    f"""{_FULL_SQL}
SELECT executor_id, hb_seq, remaining FROM progress
WHERE remaining <= sqrt(processed + remaining) AND hb_seq % 3 > 0"""
)
def stream_refill_alerts(t: Tables) -> DataFrame:
    stream = tables.stream_heartbeats(t.spark, _written(t, _progress(t), "heartbeats")).withColumns(
        {
            "batch_size": F.col("processed") + F.col("remaining"),
            "pool_size": F.col("hb_seq") % 3,
        }
    )
    alerts = live.stream_refill_alerts(stream).select("executor_id", "hb_seq", "remaining")
    return batches.run_available(alerts, scratch_dir(t.spark, "alerts"))
