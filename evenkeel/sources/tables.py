"""Typed loads of the logs and tables of `schemas`, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel import schemas


# Columns that a file may leave out; they are null then.
_OPTIONAL = {"remaining_ids", "processed_ids"}


def _load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read with the fixed schema, after checking that the files have its columns.

    The footers are read once: the schema is applied to the opened table.
    """
    table = spark.read.parquet(path)
    there = {c.lower() for c in table.columns}
    missing = [c for c in schema.fieldNames() if c not in there and c not in _OPTIONAL]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return table.to(schema)


def _stream(spark: SparkSession, path: str, schema: StructType, options: dict) -> DataFrame:
    """Files as they arrive in a folder, e.g. with `maxFilesPerTrigger=100`."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def load_heartbeats(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.HEARTBEATS)


def load_work_items(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.WORK_ITEMS)


def load_completions(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.COMPLETIONS)


def load_task_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Task metrics; a read method outside the fixed domain is an error where `input` is used."""
    metrics = _load(spark, path, schemas.TASK_METRICS)
    return metrics.withColumn("input", _checked_input())


def load_shuffle_deps(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.SHUFFLE_DEPS)


def load_executors(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.EXECUTORS)


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.TASKS)


def load_moves(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.MOVES)


def stream_heartbeats(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _stream(spark, path, schemas.HEARTBEATS, options)


def stream_work_items(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _stream(spark, path, schemas.WORK_ITEMS, options)


def stream_completions(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _stream(spark, path, schemas.COMPLETIONS, options)


def stream_shuffle_deps(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _stream(spark, path, schemas.SHUFFLE_DEPS, options)


def stream_executors(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _stream(spark, path, schemas.EXECUTORS, options)


def stream_tasks(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _stream(spark, path, schemas.TASKS, options)


def stream_moves(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _stream(spark, path, schemas.MOVES, options)


def stream_task_metrics(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _stream(spark, path, schemas.TASK_METRICS, options).withColumn("input", _checked_input())


def _checked_input():
    method = F.col("input.read_method")
    known = method.isNull() | method.isin(*schemas.READ_METHODS)
    message = F.concat(F.lit("unknown read method: "), method)
    return F.when(known, F.col("input")).otherwise(
        F.raise_error(message).cast(schemas.INPUT_READ)
    )
