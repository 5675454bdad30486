"""Small helpers around DataFrames that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.session import stored

__all__ = ["bounded_batches", "fresh", "join_counted", "map_arrow", "read", "row_key", "stored", "text_bytes"]

#: Most rows that an Arrow batch holds, so that a batch of long texts stays small.
_BATCH_ROWS = 1000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows in each Arrow batch of this session, as texts can be long."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > _BATCH_ROWS:
        spark.conf.set(setting, str(_BATCH_ROWS))


def map_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one job over one column, without a shuffle of it."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


#: Keys that are joined by broadcast because they have much of a table: at most so many.
HOT_KEYS = 100_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """Join `rows` with `table`, which has each key once with the number of its rows in column `n`.

    A key of more than one in HOT_KEYS of all rows would fill one task, so these keys (there can't be more
    than HOT_KEYS of them) are broadcast, and their rows stay where they are. `table` is read three times.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_hot = F.col(n) * HOT_KEYS > total
    hot, cool = F.broadcast(table.where(is_hot).drop(n)), table.where(~is_hot).drop(n)
    rest = rows.join(hot.select(key), key, "left_anti").join(cool, key, how)
    return rows.join(hot, key, how).unionByName(rest)


def row_key(*columns: str) -> Column:
    """64 bits that stand for the values of a row. Rows with equal values share them."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """`wanted` names, each with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
