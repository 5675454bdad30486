"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming state beyond the heap: keep it in RocksDB instead of the default in-memory map.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(master: str | None = None, app: str = "evenkeel", **conf: object) -> SparkSession:
    """A session with the library's settings. `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


_local_base: str | None = None
_stored: list[str] = []


def scratch_dir(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A new folder name under `folder`, or under the cluster's `spark.checkpoint.dir`.

    Only a local master may have neither: a temporary folder is made then. On a cluster each executor
    would write such a folder on its own disk, so there it is an error.
    """
    global _local_base
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        _local_base = _local_base or tempfile.mkdtemp(prefix="evenkeel-")
        base = _local_base
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write `df` to a new shared folder and read it back.

    For a small result of a long computation that is used several times: it is computed once, survives
    lost executors, and has a known size.
    """
    path = scratch_dir(df.sparkSession, label, folder)
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> int:
    """Delete the tables that `stored` wrote in this process; their DataFrames can't be read any more."""
    removed = 0
    hadoop = spark._jvm.org.apache.hadoop.fs
    while _stored:
        path = hadoop.Path(_stored.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed
