"""Progress over a heartbeat stream: items done since the previous heartbeat, each heartbeat reported once.

What has come of an executor's numbered heartbeats is kept as segments without a gap: their first and last
number, and what the two have counted. Without losses that is one segment per executor, however long the
stream runs. A batch is a job over its rows and the segments of its executors, in built-in expressions only:

1. rows within a segment are repeats and go;
2. the other rows form segments of their own, and all but the first of each have their predecessor there;
3. segments that touch are joined, which gives the first of the later one its predecessor;
4. with a watermark, a first row that waits too long for a lost predecessor is reported against the end of
   the segment before, and joined with it: what was lost is not waited for any more.

Steps 1 and 2 run per executor and run of `RUN` numbers, so a very busy executor is spread over many tasks;
step 3 sees segments only. The segments are a `KeyedTable`: a batch's reports are written first, under the
batch's number, and the segments are published last, so a batch that breaks off is run again as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.streaming.batches import read_batches, run_batches
from evenkeel.streaming.keyed_table import KeyedTable

#: Numbers of an executor that one task looks at in detail.
RUN = 10_000

_SEGMENT = T.StructType(
    [
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("first_ts", T.TimestampType()),
        T.StructField("first_processed", T.LongType()),
        T.StructField("last_processed", T.LongType()),
        # The first row waits for its predecessor.
        T.StructField("open", T.BooleanType()),
    ]
)
_STATE = T.StructType(
    [
        T.StructField("executor_id", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("segments", T.ArrayType(_SEGMENT)),
    ]
)
_REPORT = T.StructType(
    [
        T.StructField("executor_id", T.LongType()),
        T.StructField("hb_seq", T.LongType()),
        T.StructField("hb_ts", T.TimestampType()),
        T.StructField("processed", T.LongType()),
        T.StructField("delta", T.LongType()),
        T.StructField("gap", T.BooleanType()),
    ]
)
_FIELDS = _SEGMENT.fieldNames()


def _open_segments(states: DataFrame) -> DataFrame:
    """The segments whose first row waits, to be looked through when the watermark moves."""
    each = states.select("executor_id", "bucket", F.explode("segments").alias("s"))
    return each.where("s.open").select("executor_id", F.col("s.first_ts").alias("first_ts"), "bucket")


def _reports(rows: DataFrame, seq: str, ts: str, processed: str, before, gap: bool) -> DataFrame:
    return rows.select(
        "executor_id",
        F.col(seq).alias("hb_seq"),
        F.col(ts).alias("hb_ts"),
        F.col(processed).alias("processed"),
        (F.col(processed) - before).alias("delta"),
        F.lit(gap).alias("gap"),
    )


def fresh_rows(rows: DataFrame, segments: DataFrame, run: int = RUN) -> DataFrame:
    """The distinct heartbeats of `rows` that are in no segment, with their `run`."""
    number = F.call_function("div", F.col("hb_seq") - 1, F.lit(run))
    once = rows.groupBy("executor_id", "hb_seq").agg(F.min(F.struct("hb_ts", "processed")).alias("r"))
    once = once.select("executor_id", "hb_seq", "r.*").withColumn("run", number)
    # Segments are cut to the runs that the batch touches.
    touched = once.select("executor_id", "run").distinct()
    cut = touched.join(segments.select("executor_id", "first", "last"), "executor_id").where(
        (F.col("first") <= (F.col("run") + 1) * run) & (F.col("last") > F.col("run") * run)
    )
    known = cut.select(
        "executor_id",
        F.greatest(F.col("first"), F.col("run") * run + 1).alias("hb_seq"),
        F.lit(None).cast("timestamp").alias("hb_ts"),
        F.lit(None).cast("long").alias("processed"),
        "run",
        F.col("last").alias("_covered"),
    )
    in_order = Window.partitionBy("executor_id", "run").orderBy("hb_seq", F.col("_covered").isNull())
    marked = once.withColumn("_covered", F.lit(None).cast("long")).unionByName(known)
    marked = marked.withColumn("_upto", F.max("_covered").over(in_order))
    fresh = marked.where(F.col("_covered").isNull() & (F.coalesce("_upto", F.lit(0)) < F.col("hb_seq")))
    return fresh.select(*once.columns)


def _joined(parts: DataFrame, joins: str) -> DataFrame:
    """Segments where `joins` tells that a part continues the one before it, in order of `first`."""
    in_order = Window.partitionBy("executor_id").orderBy("first")
    numbered = parts.withColumn("_island", F.sum(F.when(F.col(joins), 0).otherwise(1)).over(in_order))
    return numbered.groupBy("executor_id", "_island").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min_by("first_ts", "first").alias("first_ts"),
        F.min_by("first_processed", "first").alias("first_processed"),
        F.max_by("last_processed", "last").alias("last_processed"),
        F.min_by("open", "first").alias("open"),
    ).drop("_island")


def advance(rows: DataFrame, segments: DataFrame, horizon=None, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """The reports of a batch, and the segments after it.

    `rows(executor_id, hb_seq, hb_ts, processed)`; `segments` are those of the executors concerned. First
    rows from before `horizon` (a time) no longer wait.
    """
    fresh = fresh_rows(rows, segments, run)
    in_run = Window.partitionBy("executor_id", "run").orderBy("hb_seq")
    follows = F.lag("hb_seq").over(in_run) + 1 == F.col("hb_seq")
    linked = fresh.withColumns({"_follows": F.coalesce(follows, F.lit(False)), "_before": F.lag("processed").over(in_run)})
    reports = _reports(linked.where("_follows"), "hb_seq", "hb_ts", "processed", F.col("_before"), False)
    island = F.sum(F.when(F.col("_follows"), 0).otherwise(1)).over(in_run)
    new = linked.withColumn("_island", island).groupBy("executor_id", "run", "_island").agg(
        F.min("hb_seq").alias("first"),
        F.max("hb_seq").alias("last"),
        F.min_by("hb_ts", "hb_seq").alias("first_ts"),
        F.min_by("processed", "hb_seq").alias("first_processed"),
        F.max_by("processed", "hb_seq").alias("last_processed"),
    )
    every = segments.select("executor_id", *_FIELDS).unionByName(
        new.select("executor_id", *_FIELDS[:-1]).withColumn("open", F.lit(True))
    )
    in_order = Window.partitionBy("executor_id").orderBy("first")
    every = every.withColumns(
        {
            "_touches": F.coalesce(F.lag("last").over(in_order) + 1 == F.col("first"), F.lit(False)),
            "_before": F.lag("last_processed").over(in_order),
        }
    )
    settled = every.where(F.col("open") & (F.col("_touches") | (F.col("first") == 1)))
    before = F.when(F.col("_touches"), F.col("_before")).otherwise(0)
    reports = reports.unionByName(_reports(settled, "first", "first_ts", "first_processed", before, False))
    still = F.col("open") & ~F.col("_touches") & (F.col("first") != 1)
    after = _joined(every.withColumn("open", still), "_touches")
    if horizon is None:
        return reports, after
    lost = after.withColumns(
        {
            "_lost": F.col("open") & (F.col("first_ts") < horizon),
            "_before": F.lag("last_processed").over(in_order),
        }
    )
    reports = reports.unionByName(
        _reports(lost.where("_lost"), "first", "first_ts", "first_processed", F.col("_before"), True)
    )
    return reports, _joined(lost.withColumn("open", F.col("open") & ~F.col("_lost")), "_lost")


def progress_table(
    heartbeats: DataFrame, path: str, watermark: str | None = None, buckets: int = 64, run: int = RUN
) -> DataFrame:
    """Take in what a heartbeat stream has now, and read all reports so far.

    Needs `executor_id, hb_seq, hb_ts, processed`, with `hb_seq` counting an executor's heartbeats from 1.
    Heartbeats may come late, out of order and repeatedly: each is reported once, when it and its predecessor
    are both in, with the items done since (`delta`) and the average per heartbeat.

    With a `watermark` delay (e.g. "10 minutes"), heartbeats older than the newest of the batches before by
    more than the delay are dropped, and one whose predecessor did not come by then is reported against the
    nearest earlier one (else with a null `delta`), with `gap` true.

    Columns: executor_id, hb_seq, hb_ts, processed, delta, avg_rate, gap.
    """
    spark: SparkSession = heartbeats.sparkSession
    table = KeyedTable(
        spark, f"{path}/segments", _STATE, ["executor_id"], ["version"], buckets, derive=_open_segments
    )

    def take_in(batch: DataFrame, batch_id: int) -> None:
        now = table.current()
        if now["batch"] >= batch_id:
            return
        rows = batch.select("executor_id", F.col("hb_seq").cast("long"), "hb_ts", F.col("processed").cast("long"))
        rows = rows.where("hb_seq >= 1").persist()
        horizon, newest = None, now["note"]
        touched = rows.select("executor_id")
        if watermark is not None:
            if newest is not None:
                horizon = F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {watermark}")
                overdue = table.read_derived().where(F.col("first_ts") < horizon)
                touched = touched.union(overdue.select("executor_id"))
                rows = rows.where(F.col("hb_ts") >= horizon)
            latest = batch.agg(F.max(F.unix_micros("hb_ts"))).first()[0]
            newest = max((x for x in (newest, latest) if x is not None), default=None)
        touched = touched.distinct()
        old = table.read().join(touched, "executor_id", "left_semi")
        segments = old.select("executor_id", F.inline("segments"))
        reports, after = advance(rows, segments, horizon, run)
        reports.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        states = after.groupBy("executor_id").agg(F.sort_array(F.collect_list(F.struct(*_FIELDS))).alias("segments"))
        states = states.withColumn("version", F.lit(batch_id).cast("long"))
        table.merge(states, batch_id, newest)
        rows.unpersist()

    run_batches(heartbeats, take_in, path)
    reports = read_batches(spark, _REPORT, path)
    rate = (F.col("processed") / F.col("hb_seq")).alias("avg_rate")
    return reports.select("executor_id", "hb_seq", "hb_ts", "processed", "delta", rate, "gap")
