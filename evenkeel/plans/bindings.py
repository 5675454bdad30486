"""The test tables in the roles of logs, queues and executors (see FIXTURES.md)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.schemas import READ_METHODS


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str
    _read: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """Opened once per query: each opening reads the footer again."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    # Logs ------------------------------------------------------------------------------------------

    def heartbeats(self) -> DataFrame:
        return (
            self.table("events")
            .where("event_type = 'view'")
            .select(
                F.col("user_id").alias("executor_id"), F.col("ts").cast("timestamp").alias("hb_ts"), "event_id"
            )
        )

    def completions(self) -> DataFrame:
        return (
            self.table("events")
            .where("event_type <> 'view'")
            .select(
                F.col("event_id").alias("item_id"),
                F.col("user_id").alias("executor_id"),
                F.col("ts").cast("timestamp").alias("finish_ts"),
                "event_id",
            )
        )

    def assigned(self) -> DataFrame:
        """Every event of a user is an item; those that were only viewed are still open at the end."""
        items = self.table("events").groupBy(F.col("user_id").alias("executor_id"))
        return items.agg(F.count(F.lit(1)).alias("assigned"))

    def open_items(self) -> DataFrame:
        return (
            self.table("events")
            .where("event_type = 'view'")
            .select(
                F.col("event_id").alias("item_id"),
                F.col("user_id").alias("queue_id"),
                F.col("event_id").alias("pos"),
            )
        )

    def timed_moves(self) -> DataFrame:
        """A move log on the time line of `events`: signups hand an item to another user."""
        other = F.col("event_id") % 150
        return (
            self.table("events")
            .where("event_type = 'signup'")
            .select(
                F.col("user_id").alias("thief_id"),
                other.alias("victim_id"),
                F.col("ts").cast("timestamp").alias("move_ts"),
                "event_id",
            )
            .where("thief_id <> victim_id")
        )

    # Queues ----------------------------------------------------------------------------------------

    def queues(self, queue_id: Column | None = None) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("item_id"),
            (F.col("o_custkey") if queue_id is None else queue_id).alias("queue_id"),
            F.col("o_orderkey").alias("pos"),
            F.floor("o_totalprice").cast("long").alias("cost_ms"),
        )

    def large_queues(self) -> DataFrame:
        return self.queues(F.col("o_custkey") % 8)

    def pool(self) -> DataFrame:
        return self.queues().select("item_id", "cost_ms")

    def move_log(self) -> DataFrame:
        victim = (F.col("o_custkey") + F.col("o_orderkey")) % 8
        return (
            self.table("orders")
            .select(
                F.col("o_orderkey").alias("item_id"),
                victim.alias("victim_id"),
                (F.col("o_custkey") % 8).alias("thief_id"),
            )
            .where("victim_id <> thief_id")
        )

    def moves(self) -> DataFrame:
        victim = F.col("o_custkey") % 8
        ids = self.table("orders").select(victim.alias("victim_id")).where("victim_id < 4").distinct()
        return ids.withColumn("thief_id", F.col("victim_id") + 4)

    # Tasks -----------------------------------------------------------------------------------------

    def shuffle_deps(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("task_id"),
            F.col("l_linenumber").cast("long").alias("dep_id"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("fetch_wait_ms"),
            F.col("l_quantity").cast("long").alias("local_blocks"),
            F.col("l_linenumber").cast("long").alias("remote_blocks"),
            F.round(F.col("l_tax") * 100).cast("long").alias("remote_bytes"),
            F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("shuffle_finish_ms"),
        )

    def tasks(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("task_set_id")
        )

    def task_sets(self) -> DataFrame:
        return (
            self.table("customer")
            .where("c_mktsegment = 'BUILDING'")
            .select(
                F.col("c_custkey").alias("task_set_id"),
                (F.col("c_custkey") % 10).alias("stage_id"),
                F.lit(0).cast("long").alias("attempt"),
            )
        )

    def task_metrics(self) -> DataFrame:
        """Orders as task records with nested parts."""
        price = F.floor("o_totalprice").cast("long")
        method = F.element_at(
            F.array(*[F.lit(name) for name in READ_METHODS]),
            (F.col("o_orderkey") % 4 + 1).cast("int"),
        )
        zero = F.lit(0).cast("long")
        read = ("fetch_wait_ms", "local_blocks", "remote_blocks", "remote_bytes", "shuffle_finish_ms")
        return self.table("orders").select(
            F.col("o_orderkey").alias("task_id"),
            F.concat(F.lit("host"), F.col("o_custkey") % 25).alias("hostname"),
            (price % 7).alias("executor_deserialize_ms"),
            price.alias("executor_run_ms"),
            (price * 3).alias("result_size_bytes"),
            (price % 11).alias("jvm_gc_ms"),
            zero.alias("result_serialization_ms"),
            zero.alias("memory_bytes_spilled"),
            zero.alias("disk_bytes_spilled"),
            F.struct(method.alias("read_method"), price.alias("bytes_read")).alias("input"),
            F.struct(*[zero.alias(name) for name in read]).alias("shuffle_read"),
            F.struct(price.alias("bytes"), (price * 1000).alias("write_ns")).alias("shuffle_write"),
        )

    # Topology --------------------------------------------------------------------------------------

    def executors(self) -> DataFrame:
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.table("supplier")
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("executor_id"),
                F.col("n_name").alias("host"),
                F.col("r_name").alias("rack"),
                (F.col("s_acctbal") > 5000).alias("active"),
                "s_acctbal",
            )
        )
