"""Streams batch by batch: run what is available now, and keep results in files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel.streaming.keyed_table import Folder


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Write what an append-mode stream has now to files under `path`, and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start(f"{path}/rows")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_batches(stream: DataFrame, take_in: Callable[[DataFrame, int], None], path: str) -> None:
    """Hand each batch that the stream has now to `take_in(batch, id)`; progress is kept under `path`."""
    writer = stream.writeStream.foreachBatch(take_in).option("checkpointLocation", f"{path}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()


def per_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """`transform` of each batch that the stream has now, read back from files, with the `batch` it is from.

    The transform is built anew for each batch, so tables that it opens are read as they are then. A batch
    that is run again after a failure replaces its files; only complete ones are read.
    """
    spark = stream.sparkSession
    schema = transform(spark.createDataFrame([], stream.schema)).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    run_batches(stream, write, path)
    return read_batches(spark, schema, path)


def read_batches(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The rows that were written as `path/rows/batch=<id>`, with their `batch`; complete folders only."""
    folder = Folder(spark, path)
    done = [n for n in folder.names("rows") if "_SUCCESS" in folder.names(f"rows/{n}")]
    if not done:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    number = F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long")
    rows = spark.read.schema(schema).parquet(*[f"{path}/rows/{n}" for n in done])
    return rows.select("*", number.alias("batch"))
