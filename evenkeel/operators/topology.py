"""Which executors, hosts and racks are alive: `executors(executor_id, host, rack, active)`.

The looked-up side is made distinct before each join: a host with very many executors is one row then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.ordinals import running_totals


def executors_on_host(executors: DataFrame, host: str | None = None, page: int = 10_000) -> DataFrame:
    """Sorted executor ids per host, or of one host.

    A host's ids come as arrays of at most `page`, one row per `page_no` (from 0), so a very full host
    does not end up in one row.
    """
    if host is not None:
        executors = executors.where(F.col("host") == host)
    ids = executors.select("host", "executor_id").distinct()
    numbered = running_totals(ids, ["host"], ["executor_id"], {"n": F.lit(1)})
    page_no = F.call_function("div", F.col("n") - 1, F.lit(page)).alias("page_no")
    return numbered.groupBy("host", page_no).agg(
        F.sort_array(F.collect_list("executor_id")).alias("executor_ids")
    )


def hosts_alive(requested: DataFrame, executors: DataFrame) -> DataFrame:
    """Requested `host` rows that have an executor."""
    return requested.join(executors.select("host").distinct(), "host", "left_semi")


def racks_alive(requested: DataFrame, executors: DataFrame) -> DataFrame:
    """Requested `rack` rows that have a host with an executor."""
    return requested.join(executors.select("rack").distinct(), "rack", "left_semi")


def executors_alive(requested: DataFrame, executors: DataFrame) -> DataFrame:
    """Requested `executor_id` rows that are active."""
    active = executors.where("active").select("executor_id").distinct()
    return requested.join(active, "executor_id", "left_semi")


def with_rack(hosts: DataFrame, rack_map: DataFrame | None = None) -> DataFrame:
    """Add the rack of each `host` from `rack_map(host, rack)`; unknown (null) without a map or entry."""
    if rack_map is None:
        return hosts.withColumn("rack", F.lit(None).cast("string"))
    return hosts.join(rack_map.select("host", "rack").distinct(), "host", "left")


def unknown_executors(heartbeats: DataFrame, executors: DataFrame) -> DataFrame:
    """Heartbeat senders that are not registered; each once."""
    senders = heartbeats.select("executor_id").distinct()
    return senders.join(executors.select("executor_id").distinct(), "executor_id", "left_anti")


def drop_lost_executors(executors: DataFrame, lost: DataFrame) -> DataFrame:
    """Executors without the lost ones; a host or rack with none left is gone from the lookups too."""
    return executors.join(lost.select("executor_id").distinct(), "executor_id", "left_anti")
