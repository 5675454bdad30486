"""Binary search of a row's value among sorted bounds, as plain column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_rank_among(df: DataFrame, name: str, value: Column, bounds: Column, size: int) -> DataFrame:
    """Add `name`: how many of the `size` ascending entries of `bounds` are at or below `value`.

    One projection per halving step, all inside one generated stage; an index past the end reads null,
    which counts as "not below". For many bounds and for internal columns: a filter on `name` would be
    pushed below the steps and repeat them.
    """
    df = df.withColumn(name, F.lit(0))
    step = 1 << max(size.bit_length() - 1, 0)
    while size and step:
        ahead = F.get(bounds, F.col(name) + (step - 1)) <= value
        df = df.withColumn(name, F.when(ahead, F.col(name) + step).otherwise(F.col(name)))
        step >>= 1
    return df


def rank_among(value: Column, bounds: Sequence[int]) -> Column:
    """How many of a few ascending `bounds` are at or below `value`: a decision tree in one expression."""

    def choose(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        return F.when(value >= bounds[middle], choose(middle + 1, high)).otherwise(choose(low, middle))

    return choose(0, len(bounds))
