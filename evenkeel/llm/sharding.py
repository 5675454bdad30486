"""Shards along a Hilbert curve through several metadata columns.

Each column is quantised at its quantiles, exact over all rows and by whole values, so that every step holds
about as many rows; the point of a row in this grid gives its index on the curve. Rows are sorted by the index and the order is cut into
runs. Neighbours on the curve are neighbours in every column, so each shard covers a small range of each,
and a filter on any of the columns skips most files.

The distinct values of a column are counted, sorted by range and summed up to find its quantiles, so a value
of very many rows is one row there. Only the metadata is shuffled. The sort is by range, so that no task has all rows; positions come from the
counts of the sorted, written parts. Equal texts with equal metadata stay together as far as the cuts let
them. Nulls are the first step of their column; a null text has no bytes. Repeated rows each get a place, and
ties of all of the order any. A very long text counts by its bytes like any other, and an empty table gives no
rows. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm._frames import map_arrow, stored

#: Columns of a document that span the grid, and bits of each.
DIMENSIONS = ("lang", "source", "n_chars")
BITS = 6
SHARDS = 16


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each point (a row of small non-negative integers).

    From the highest bit down, the axes are reflected and exchanged so that each cell is met in the
    orientation in which the curve runs through it; the Gray code of the remaining bits, taken across the
    axes, then reads as the index.
    """
    x = np.array(points, dtype=np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for i in range(axes):
            is_set = (x[i] >> b) & 1 == 1
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & lower)
            x[0] = np.where(is_set, x[0] ^ lower, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> b) & 1 == 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            index = index << 1 | (x[i] >> b) & 1
    return index


def _comparable(df: DataFrame, name: str) -> Column:
    """A column as what its steps compare: whole strings, else a number in the same order."""
    return F.col(name) if dict(df.dtypes)[name] == "string" else F.col(name).cast("double")


def in_parts(df: DataFrame, *order: str) -> DataFrame:
    """`df` sorted by range and stored, with `part` and `at`, the place in the part, counted from 0."""
    by_range = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = stored(by_range.withColumn("at", F.monotonically_increasing_id()), "sorted")
    # The number's high bits are the part, its low 33 bits the place in the part.
    return sorted_rows.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})


def offsets(per_part: DataFrame) -> tuple[DataFrame, int]:
    """(part, before): sums of `per_part(part, n)` before each part, a row for each; and the whole sum."""
    total, before = 0, []
    for part, n in sorted(per_part.collect()):
        before.append((part, total))
        total += n
    return F.broadcast(per_part.sparkSession.createDataFrame(before, "part long, before long")), total


def quantiles(values: DataFrame, steps: int) -> list:
    """The distinct values of `values(v)` at which its order is cut into `steps` parts of about one size."""
    counted = in_parts(values.dropna().groupBy("v").agg(F.count("*").alias("n")), "v")
    before, total = offsets(counted.groupBy("part").agg(F.sum("n").alias("n")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("at"))
    step = F.expr(f"(upto * {steps}) div {max(total, 1)}")
    ranked = counted.join(before, "part").withColumn("upto", upto)
    # A cut is the first value that reaches the next step; values up to a cut are in its step.
    passed = ranked.where(step > F.expr(f"((upto - n) * {steps}) div {max(total, 1)}"))
    return sorted(r[0] for r in passed.where(F.col("upto") < total).select("v").collect())


def curve(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, out: str = "curve") -> DataFrame:
    """`df` with the curve index of each row."""
    cuts = [quantiles(df.select(_comparable(df, d).alias("v")), 1 << bits) for d in dimensions]
    kinds = [object if dict(df.dtypes)[d] == "string" else np.float64 for d in dimensions]
    ordered = [np.array(c, dtype=kind) for c, kind in zip(cuts, kinds)]

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        points = []
        for c, cut in zip(columns, ordered):
            there = c.notna().to_numpy()
            step = np.zeros(len(c), dtype=np.int64)
            step[there] = np.searchsorted(cut, c[there].to_numpy(dtype=cut.dtype), side="left") + 1
            # Few distinct values are spread over the whole axis.
            points.append((step << bits) // (len(cut) + 2))
        return pd.Series(hilbert_index(np.stack(points, axis=1), bits))

    return df.withColumn(out, place(*[_comparable(df, d) for d in dimensions]))


def _described(docs: DataFrame, doc_id: str, text: str, dimensions: tuple[str, ...]) -> DataFrame:
    """The metadata of each row with the bytes and the checksum of its text, without the text."""
    names = [f"dim{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        *[F.col(d).alias(n) for d, n in zip(dimensions, names)],
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            size = pc.add(pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64()), 1)
            crc = pa.array([zlib.crc32(t.as_buffer()) if t.is_valid else 0 for t in texts], type=pa.int64())
            kept = [batch.column(c) for c in ("doc_id", *names)]
            yield pa.RecordBatch.from_arrays([*kept, size, crc], names=["doc_id", *names, "size", "text_crc32"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    return map_arrow(rows, work, f"{fields}, size long, text_crc32 long")


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    dimensions: tuple[str, ...] = DIMENSIONS,
    bits: int = BITS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row; shards differ by one row at most."""
    described = stored(_described(docs, doc_id, text, dimensions), "metadata")
    names = tuple(f"dim{i}" for i in range(len(dimensions)))
    order = ["curve", "size", "text_crc32", "doc_id"]
    placed = curve(described, names, bits).select(*order)
    # Equal values of all of the order would otherwise go to one part.
    placed = placed.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    numbered = in_parts(placed, *order, "tie")
    before, total = offsets(numbered.groupBy("part").agg(F.count("*").alias("n")))
    ranked = numbered.join(before, "part").withColumn("rank", F.col("before") + F.col("at"))
    # Shard s has the ranks from ceil(s * total / shards) on.
    shard = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    ranked = ranked.withColumn("shard", shard)
    return ranked.select(
        "doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot")
    )


def write_shards(docs: DataFrame, places: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write the rows of `docs` (with distinct ids) as Parquet, a folder `shard=n` each, in slot order.

    Row groups then hold short ranges of every dimension, which readers prune by their statistics.
    """
    where = places.select(F.col("doc_id").alias(doc_id), "shard", "slot")
    rows = docs.drop("shard", "slot").join(where, doc_id)
    ordered = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.drop("slot").write.partitionBy("shard").parquet(path)


def digest(places: DataFrame) -> DataFrame:
    return places.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
