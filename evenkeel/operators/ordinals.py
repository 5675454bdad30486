"""Positions and running totals in a given order, safe for tables and keys too large for one task.

A window over a key runs in one task per key, so a key with a third of all rows would not fit. Where the
input is not known to be small, the rows are cut into blocks along `(key, order)`:

1. a small sample gives evenly spaced block bounds, kept as constants, so every later pass, retry or
   recomputation after a lost executor puts a row into the same block. Where there are more than
   `CUT_FANOUT` blocks, the constants cut ranges, and the blocks in each come from a stored table of bounds;
2. the windows run per `(block, key)`;
3. only keys that a bound falls into can reach over more than one block. There are at most as many as
   bounds, so their totals before each block are a broadcast table of proven size.

If the bounds show no key of many blocks, a plain window per key does. The sample decides only where the
work runs; results are exact whatever it was.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.search import with_rank_among
from evenkeel.session import stored

# An input no larger than what one scan task reads anyway may put any one key into one task.
ONE_TASK_BYTES = 128 << 20
ROWS_PER_BLOCK = 1_000_000
MAX_BLOCKS = 65_536
SAMPLES_PER_BLOCK = 20
# Ranges into which `running_totals` cuts at most by constants; as many blocks in each make MAX_BLOCKS.
CUT_FANOUT = 256
# Ranges of a whole table, and sampled rows from which the bounds of each are chosen.
FANOUT = 1024
SAMPLES_PER_RANGE = 200
# A key in at most this many bounds (that is, of about as many blocks) is left to one task.
COOL_BOUNDS = 4

_BLOCK = "_block"


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate; None where the session does not offer one."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        return int(str(plan.stats().sizeInBytes()))
    except (AttributeError, TypeError):
        return None


def _constant_array(table: DataFrame) -> Column:
    """A short table (one row per block at most) as one sorted array constant.

    A single column gives an array of values, several give an array of structs.
    """
    names = table.columns
    entry = F.col(names[0]) if len(names) == 1 else F.struct(*names)
    return table.agg(F.sort_array(F.collect_list(entry)).alias("entries")).scalar()


@dataclass(frozen=True)
class _Cut:
    """Rows with their block. Without `bounds` everything is in one block."""

    rows: DataFrame
    bounds: DataFrame | None = None

    def has_hot_key(self, keys: Sequence[str]) -> bool:
        if self.bounds is None:
            return False
        return not self.bounds.groupBy(*keys).count().where(F.col("count") > COOL_BOUNDS).isEmpty()


def _picked(sample: DataFrame, order: Sequence[str], share: float, parts: int) -> pa.Table | None:
    """Bounds that cut the sample into so many parts of about one size, by a share of its rows."""
    if parts <= 1:
        return None
    some = (sample if share >= 1 else sample.sample(share, seed=11)).orderBy(*order).toArrow()
    picks = sorted({i * some.num_rows // parts for i in range(1, parts)})
    return some.take(picks) if some.num_rows else None


def _inner_bounds(dealt: DataFrame, order: Sequence[str], place: Column, parts: int) -> DataFrame:
    """(_range, _within) from sampled rows with their `_range`: the sorted bounds that cut it into parts."""
    in_order = Window.partitionBy("_range").orderBy(*order)
    step = F.greatest(F.ceil(F.count("*").over(Window.partitionBy("_range")) / parts), F.lit(1))
    chosen = (
        dealt.select("_range", place.alias("_bound"), F.row_number().over(in_order).alias("_n"), step.alias("_step"))
        .where("_n % _step = 0")
        .groupBy("_range")
        .agg(F.array_sort(F.collect_list("_bound")).alias("_within"))
    )
    return stored(chosen, "block-bounds")


def _cut(df: DataFrame, columns: Sequence[str], rows_per_block: int) -> _Cut:
    spark = df.sparkSession
    count = df.count()
    blocks = min(MAX_BLOCKS, -(-count // rows_per_block))
    if blocks <= 1:
        return _Cut(df.withColumn(_BLOCK, F.lit(0)))
    ranges, nested = min(blocks, CUT_FANOUT), blocks > CUT_FANOUT
    fraction = min(1.0, SAMPLES_PER_BLOCK * blocks / count)
    sample = df.select(*columns).sample(fraction, seed=7)
    if len(columns) == 1:
        sample = sample.dropna()  # a null is below every bound; inside a struct it compares by itself
    if nested:
        sample = stored(sample, "order-sample")
    # About SAMPLES_PER_BLOCK rows of a few columns reach the driver for each range.
    top = _picked(sample, columns, min(1.0, ranges / blocks), ranges)
    if top is None:
        return _Cut(df.withColumn(_BLOCK, F.lit(0)))
    bounds = spark.createDataFrame(top, df.select(*columns).schema)
    constant = _constant_array(bounds)
    rows, probe = df, F.col(columns[0])
    if len(columns) > 1:
        # Build the compared record once per row, nullable like the bounds, not once per halving step.
        fields = df.select(*columns).schema
        kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        probe = F.col("_probe")
        rows, sample = (d.withColumn("_probe", F.struct(*columns).cast(kind)) for d in (df, sample))
    rows = with_rank_among(rows, _BLOCK, probe, constant, top.num_rows)
    if nested:
        dealt = with_rank_among(sample, "_range", probe, constant, top.num_rows)
        inner = _inner_bounds(dealt, columns, probe, -(-blocks // ranges))
        widest = inner.agg(F.max(F.size("_within"))).first()[0] or 0
        rows = rows.withColumnRenamed(_BLOCK, "_range").join(F.broadcast(inner), "_range", "left")
        rows = with_rank_among(rows, _BLOCK, probe, F.col("_within"), widest)
        rows = rows.withColumn(_BLOCK, F.col("_range").cast("long") * (widest + 1) + F.col(_BLOCK))
        each = inner.select(F.explode("_within").alias("_bound"))
        bounds = bounds.union(each.select("_bound.*" if len(columns) > 1 else F.col("_bound").alias(columns[0])))
    return _Cut(rows.select(*df.columns, _BLOCK), bounds)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    at_last: Mapping[str, tuple[str, Column]] | None = None,
    finals: Mapping[str, str] | None = None,
    rows_per_block: int | None = None,
    no_larger_than: DataFrame | None = None,
) -> DataFrame:
    """Running totals per key, in ascending order of the `order` columns.

    `totals` maps a new column to its non-negative increment; a row's own increment counts. `at_last`
    maps a new column to `(total, flag)`: that total at the nearest earlier row of the key where the flag
    held, null if there is none. `finals` maps a new column to a total whose end value it repeats.
    `order` must be unique within a key for a deterministic result.

    A small input takes one shuffle and one sort. `no_larger_than` is a table with at least as many rows,
    for an input whose own size estimate is poor (joins). Give `rows_per_block` to force the cut.
    """
    at_last, finals = dict(at_last or {}), dict(finals or {})
    if rows_per_block is None:
        size = estimated_bytes(df if no_larger_than is None else no_larger_than)
        if size is not None and size <= ONE_TASK_BYTES:
            return _windowed(df, keys, order, totals, at_last, finals)
    cut = _cut(df, [*keys, *order], rows_per_block or ROWS_PER_BLOCK)
    if cut.bounds is None or not (rows_per_block or cut.has_hot_key(keys)):
        return _windowed(df, keys, order, totals, at_last, finals)
    local = _windowed(cut.rows, [_BLOCK, *keys], order, totals, at_last, finals)
    carried = _carried(cut, keys, order, totals, at_last, finals)
    match = F.col(_BLOCK) == F.col("_b")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = local.join(F.broadcast(carried), match, "left")

    def whole(name: str) -> Column:
        return F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))

    result = {name: whole(name) for name in totals}
    for name, (total, _) in at_last.items():
        in_block = F.col(name) + F.coalesce(F.col(f"_c_{total}"), F.lit(0))
        result[name] = F.coalesce(in_block, F.col(f"_c_{name}"))
    for name in finals:
        result[name] = F.coalesce(F.col(f"_c_{name}"), F.col(name))
    return joined.select(*df.columns, *[column.alias(name) for name, column in result.items()])


def _windowed(df, keys, order, totals, at_last, finals) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    result = df.withColumns(
        {name: F.sum(step).over(so_far) for name, step in totals.items()}
        | {name: F.sum(totals[total]).over(everything) for name, total in finals.items()}
    )
    if at_last:
        result = result.withColumns(
            {
                name: F.max(F.when(flag, F.col(total))).over(before)
                for name, (total, flag) in at_last.items()
            }
        )
    return result


def _carried(cut: _Cut, keys, order, totals, at_last, finals) -> DataFrame:
    """Totals before each block, for the keys that reach over a bound: two rows per bound at most."""
    rows = cut.rows
    if keys:
        spanning = cut.bounds.select(*[F.col(key).alias(f"_s_{key}") for key in keys]).distinct()
        match = F.lit(True)
        for key in keys:
            match = match & F.col(key).eqNullSafe(F.col(f"_s_{key}"))
        rows = rows.join(F.broadcast(spanning), match, "left_semi")
    sums = [F.sum(step).alias(name) for name, step in totals.items()]
    if at_last:
        rows = _windowed(rows, [_BLOCK, *keys], order, totals, at_last, {})
        sums = [F.max(name).alias(name) for name in totals]
    marks = [
        F.max(F.when(flag, F.col(total))).alias(name) for name, (total, flag) in at_last.items()
    ]
    per_block = rows.groupBy(_BLOCK, *keys).agg(*sums, *marks)
    by_block = Window.partitionBy(*keys).orderBy(_BLOCK)
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = per_block.withColumns(
        {f"_c_{name}": F.coalesce(F.sum(name).over(earlier), F.lit(0)) for name in totals}
        | {f"_c_{name}": F.sum(total).over(everything) for name, total in finals.items()}
    )
    if at_last:
        before = before.withColumns(
            {
                f"_c_{name}": F.max(F.col(f"_c_{total}") + F.col(name)).over(earlier)
                for name, (total, _) in at_last.items()
            }
        )
    return before.select(
        F.col(_BLOCK).alias("_b"),
        *[F.col(key).alias(f"_k_{key}") for key in keys],
        *[f"_c_{name}" for name in [*totals, *at_last, *finals]],
    )


class GlobalOrder:
    """Dense positions over a whole table, without one task that holds all rows.

    Rows are cut into ranges of the order, and where there are more than `fanout` blocks, each range again
    into blocks. The bounds of the ranges are a constant in the plan; those of the blocks are a table with a
    row per range, joined by range. Numbers of rows per range come to the driver (at most `fanout`), those
    per block stay a table.

    The order columns are read twice here: once for the sample, with a count on the way, and once for the
    sizes of the blocks, which make the positions exact. The rows themselves are read once, by what is asked
    for, and shuffled once, by block. `count` is the number of rows.
    """

    def __init__(
        self, df: DataFrame, order: Sequence[str], rows_per_block: int | None = None, fanout: int = FANOUT
    ):
        self._spark, self._columns, self._order = df.sparkSession, df.columns, list(order)
        per_block = rows_per_block or ROWS_PER_BLOCK
        seen = Observation()
        watched = df.select(*order).observe(seen, F.count(F.lit(1)).alias("n"))
        fraction = min(1.0, SAMPLES_PER_RANGE / per_block)
        sample = stored(watched.sample(fraction, seed=7), "order-sample")
        if len(order) == 1:
            sample = sample.dropna()  # a null is below every bound; inside a struct it compares by itself
        about = seen.get["n"]  # recomputed tasks may count twice, so it chooses the number of blocks only
        blocks = -(-about // per_block)
        if not rows_per_block:
            blocks = max(blocks, min(df.sparkSession.sparkContext.defaultParallelism, about // 1000))
        self._place = F.col(order[0])
        if len(order) > 1:
            # One record per row, nullable like the bounds.
            kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.select(*order).schema])
            df, self._place = df.withColumn("_probe", F.struct(*order).cast(kind)), F.col("_probe")
        self._bounds, self._numbers = None, None
        ranges = min(blocks, fanout)
        # At most SAMPLES_PER_RANGE rows for each range are looked at.
        share = min(1.0, SAMPLES_PER_RANGE * fanout / max(about * fraction, 1))
        top = _picked(sample, self._order, share, ranges)
        rows = df.withColumn("_range", F.lit(0))
        if top is not None:
            bounds = self._spark.createDataFrame(top, df.select(*order).schema)
            self._bounds = _constant_array(bounds)
            if len(order) == 1 and pa.types.is_int64(top.field(0).type):
                self._numbers = top.column(0).to_pylist()
            rows = with_rank_among(df, "_range", self._place, self._bounds, top.num_rows)
        self._nested = top is not None and blocks > fanout
        rows = rows.withColumn(_BLOCK, F.lit(0))
        if self._nested:
            rows = self._blocks(rows, sample, top.num_rows, -(-blocks // ranges))
        self._rows = rows.select(*df.columns, "_range", _BLOCK)
        self._starts, self._inner = [0], None
        sizes = self._rows.groupBy("_range", _BLOCK).agg(F.count(F.lit(1)).alias("size"))
        if self._nested:
            sizes = stored(sizes, "block-sizes")
            earlier = Window.partitionBy("_range").orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
            before = F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
            self._inner = sizes.select("_range", _BLOCK, before, "size")
        of_range = dict(sizes.groupBy("_range").agg(F.sum("size").alias("n")).collect())
        for number in range(max(of_range, default=0) + 1):
            self._starts.append(self._starts[-1] + of_range.get(number, 0))
        self.count = self._starts.pop()

    def _blocks(self, rows: DataFrame, sample: DataFrame, ranges: int, parts: int) -> DataFrame:
        """Rows with their block within the range: every range's bounds are an array in a row of a table."""
        place = self._place
        if len(self._order) > 1:
            sample = sample.withColumn("_probe", F.struct(*self._order).cast(rows.schema["_probe"].dataType))
        dealt = with_rank_among(sample, "_range", place, self._bounds, ranges)
        inner = _inner_bounds(dealt, self._order, place, parts)
        widest = inner.agg(F.max(F.size("_within"))).first()[0] or 0
        joined = rows.join(inner, "_range", "left")
        return with_rank_among(joined, _BLOCK, place, F.col("_within"), widest)

    def numbered(self, name: str, low: int = 0, high: int | None = None) -> DataFrame:
        """The rows with positions in `[low, high)`; ranges outside are left out at the scan."""
        high = self.count if high is None else high
        rows = self._within(low, high)
        base = F.lit(0)
        if len(self._starts) > 1:
            starts = self._spark.createDataFrame(
                pa.table({"start": pa.array(self._starts, pa.int64())}), "start long"
            )
            base = F.get(_constant_array(starts), F.col("_range"))
        keys = ["_range", _BLOCK]
        if self._inner is not None:
            begin = base + F.col("before")
            wanted = self._inner.where((begin < high) & (begin + F.col("size") > low))
            rows, base = rows.join(wanted.select(*keys, "before"), keys), begin
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*self._order)) - 1 + base
        rows = rows.withColumn(name, position.cast("long"))
        if low > 0 or high < self.count:
            rows = rows.where((F.col(name) >= low) & (F.col(name) < high))
        return rows.select(*self._columns, name)

    def beyond(self, low: int) -> DataFrame:
        """The rows with positions from `low` on. Those of later ranges are not shuffled."""
        if low >= self.count:
            return self._rows.limit(0).select(*self._columns)
        if low <= 0:
            return self._rows.select(*self._columns)
        later = [i for i, start in enumerate(self._starts) if start >= low and i > 0]
        if not later:
            return self.numbered("_ord", low).drop("_ord")
        rest = self._rows.where(self._place >= self._bound(later[0] - 1)).select(*self._columns)
        first = self._starts[later[0]]
        return self.numbered("_ord", low, first).drop("_ord").union(rest) if first > low else rest

    def _bound(self, i: int) -> Column:
        """One bound; a plain number reaches the scan as a filter."""
        return F.lit(self._numbers[i]) if self._numbers else F.get(self._bounds, F.lit(i))

    def _within(self, low: int, high: int) -> DataFrame:
        """The ranges with positions in `[low, high)`, by comparing the order columns with two bounds.

        A filter on the range itself would be pushed below the search and repeat all of it.
        """
        rows, ends = self._rows, [*self._starts[1:], self.count]
        inside = [b for b, (s, e) in enumerate(zip(self._starts, ends)) if s < high and e > low]
        if not inside:
            return rows.limit(0)
        first, last = inside[0], inside[-1]
        if first > 0:
            rows = rows.where(self._place >= self._bound(first - 1))
        if last < len(self._starts) - 1:
            below = self._place < self._bound(last)
            rows = rows.where(below if first > 0 else below | self._place.isNull())
        return rows


def assign_ids(
    df: DataFrame, order: Sequence[str], start: int = 0, name: str = "id", rows_per_block: int | None = None
) -> DataFrame:
    """Dense ids from `start` on, in the given order."""
    numbered = GlobalOrder(df, order, rows_per_block).numbered(name)
    return numbered.withColumn(name, F.col(name) + start) if start else numbered
