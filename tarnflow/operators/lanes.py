"""Sorted series ("lanes") handed to numpy kernels in large Arrow batches.

A lane is one series, or one time shard of a long one. Spark partitions and sorts; a kernel gets many
lanes at once as flat arrays and walks them in lockstep, so the work in Python is a few numpy calls per
time step of the longest lane in the batch and not a few Python calls per row.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.session import materialise, release

#: Rows of a series in one time shard, and of a range that is ranked in one task.
ROWS_PER_SHARD, BIN_ROWS = 8192, 100_000
#: Rows a kernel gets at once, at least one whole lane.
BATCH_ROWS = 200_000

#: A result in one piece, or in pieces where it may be much larger than the input.
Result = pa.RecordBatch | pa.Table | Iterator[pa.Table]
Kernel = Callable[[pa.Table, np.ndarray], Result]


def lane_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each lane in a table sorted by `keys`, and the number of rows at the end."""
    n = table.num_rows
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            if c.null_count:
                differs = differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
            change[1:] |= differs
    return np.append(np.flatnonzero(change), n)


def _runner(keys: list[str], kernel: Kernel, batch_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(result: Result) -> Iterator[pa.RecordBatch]:
        for piece in [result] if isinstance(result, (pa.RecordBatch, pa.Table)) else result:
            if piece.num_rows:
                yield from piece.to_batches() if isinstance(piece, pa.Table) else [piece]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= batch_rows:
                table = pa.Table.from_batches(held)
                starts = lane_starts(table, keys)
                if len(starts) > 2:  # the last lane may go on in the next batch
                    cut = int(starts[-2])
                    yield from emit(kernel(table.slice(0, cut).combine_chunks(), starts[:-1]))
                    held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from emit(kernel(table, lane_starts(table, keys)))

    return run


def map_lanes(df: DataFrame, keys: list[str], order: list[str], kernel: Kernel, schema: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Apply `kernel(table, starts)` to the lanes of `df`: one shuffle by `keys`, one sort, no group in one object.

    `starts` holds the first row of each lane and the row count. A lane must fit in a task; long series
    are cut by `time_shards` before. An empty `df` gives an empty result.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_runner(keys, kernel, batch_rows), schema)


def ranges(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """`df` written in ranges of (keys, order) of about `rows` rows (BIN_ROWS), numbered by `_bin`; equal order values share a range.

    Spark samples the bounds, so ranges hold alike many rows however the values lie: one far value, or a key with most of
    the rows, makes no large range. `df` should be cheap to read twice.
    """
    n = -(-df.count() // (rows or BIN_ROWS))
    if n <= 1:
        return df.withColumn("_bin", F.lit(0))
    return materialise(df.repartitionByRange(n, *keys, *order).withColumn("_bin", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], value: str | Column, name: str) -> DataFrame:
    """`df` with `name`: the sum of `value` (BIGINT) over the rows of its key that come before it in `order`, 0 at first.

    Rows equal in `order` have the same sum. No key is sorted in one task: sums are taken inside ranges of rows, and the
    ranges' totals are added up.
    """
    return running_over(ranges(df, keys, order), keys, order, value, name).drop("_bin")


def running_over(binned: DataFrame, keys: list[str], order: list[str], value: str | Column, name: str) -> DataFrame:
    """`running` over a table that `ranges` has cut by the same keys and order already."""
    v = F.col(value) if isinstance(value, str) else value
    ahead = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*keys, "_bin").agg(F.sum(v).alias("_in_bin")).select(*keys, "_bin", F.coalesce(F.sum("_in_bin").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_bin")
    upto, peers = F.sum(v).over(inside.orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum(v).over(inside.partitionBy(*keys, "_bin", *order))
    return binned.withColumn("_here", upto - peers).join(totals, [*keys, "_bin"]).withColumn(name, F.col("_ahead") + F.col("_here")).drop("_here", "_ahead")


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`df` with `name`: `value` (not NULL) of the row before in `order`, NULL at a key's first row; ranges as in `running`."""
    return lagged_over(ranges(df, keys, order), keys, order, value, name).drop("_bin")


def lagged_over(binned: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`lagged` over a table that `ranges` has cut by the same keys and order already."""
    last = binned.groupBy(*keys, "_bin").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    last = last.select(*keys, "_bin", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_end"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    return binned.withColumn("_lag", F.lag(value).over(inside)).join(last, [*keys, "_bin"]).withColumn(name, F.coalesce("_lag", "_end")).drop("_lag", "_end")


def lower_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Per key the lower empirical quantiles of `value` (no NULL or NaN), as `lane_quantile` takes them, by ranks."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(df.select(*keys, value), keys, [value], F.lit(1), "_rank").join(n, keys)
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("_rank") <= F.floor(F.lit(q) * (F.col("_n") - 1)), F.col(value))).alias(c) for c, q in wanted.items()))


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Per key the quantiles of `value` (no NULL or NaN) by linear interpolation between ranks, exact for groups of any size.

    Ranks are taken over ranges of rows, so no group is sorted, or held, in one task.
    """
    rows = df.select(*keys, value)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(rows, keys, [value], F.lit(1), "_rank").join(n, keys)
    at = {c: F.lit(q) * (F.col("_n") - 1) for c, q in wanted.items()}
    upto = lambda p: F.max(F.when(F.col("_rank") <= p, F.col(value)))
    ends = ranked.groupBy(*keys, "_n").agg(*(upto(f(p)).alias(f"_{s}{c}") for c, p in at.items() for s, f in (("a", F.floor), ("b", F.ceil))))
    return ends.select(*keys, *((F.col(f"_a{c}") + (p - F.floor(p)) * (F.col(f"_b{c}") - F.col(f"_a{c}"))).alias(c) for c, p in at.items()))


def long_series(df: DataFrame, keys: list[str], order: list[str], ties: bool, rows_per_shard: int = ROWS_PER_SHARD) -> tuple[DataFrame, DataFrame | None]:
    """Rows of series of at most `rows_per_shard` rows, as one shard each; and those of longer ones with their rank in `order`.

    The first have the columns `shard`, `shards` and `core` of `time_shards`; the second, None if there are none, have
    `_rank` and `_n`, for `time_shards`. With `ties` rows equal in `order` share the least rank and so stay in one shard. The table of long series' keys has at most
    rows / rows_per_shard rows.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_shard)
    # AQE turns joins with it into broadcasts if, and only if, the written table is under Spark's threshold
    long = materialise(counted)
    whole = df.join(long.select(*keys), keys, "left_anti").select("*", F.lit(0).alias("shard"), F.lit(1).alias("shards"), F.lit(True).alias("core"))
    if long.isEmpty():
        return whole, None
    rows = materialise(df.join(long.select(*keys), keys))
    if not ties:
        rows, order = rows.withColumn("_turn", F.monotonically_increasing_id()), [*order, "_turn"]
    return whole, materialise(running(rows, keys, order, F.lit(1), "_rank").drop("_turn").join(long, keys))


def time_shards(ranked: DataFrame, size: int, halo: int) -> DataFrame:
    """Rows of `long_series` cut by rank into shards of `size` rows, each with up to `halo` rows of its neighbours.

    Adds `shard`, `shards` (of the series) and `core` (the shard's own row).
    """
    at = lambda r: F.floor(r / size).cast("int")
    own, last = at(F.col("_rank")), at(F.col("_n") - 1)
    reach = F.sequence(F.greatest(F.lit(0), at(F.col("_rank") - halo)), F.least(last, at(F.col("_rank") + halo)))
    cut = ranked.select("*", own.alias("_own"), (last + 1).alias("shards"), F.explode(reach).alias("shard"))
    return cut.withColumn("core", F.col("shard") == F.col("_own")).drop("_own", "_rank", "_n")


def settled(ranked: DataFrame, keys: list[str], order: list[str], kernel: Kernel, schema: str, known: DataFrame, rows_per_shard: int, halo: int) -> DataFrame:
    """Apply `kernel` to the time shards of long series, with the result that uncut series would give.

    `known` (keys and more) is joined to every row. What the kernel carries from row to row must fade: a shard starts
    `halo` rows early. Whether it has faded is measured, not assumed: the kernel also gives, for either border of a shard,
    the states it carries over it, as rows with `edge` (2 x border forward, 2 x border + 1 backward) and `state`. Unless
    both sides of every border have the same states the shards run again with a halo four times as wide, at last the
    whole series.
    """
    while True:
        cut = time_shards(ranked, max(rows_per_shard, 2 * halo), halo).join(known, keys, "left")
        done = materialise(map_lanes(cut, [*keys, "shard"], order, kernel, schema))
        sides = done.filter("edge is not null").groupBy(*keys, "edge").agg(F.min("state").alias("a"), F.max("state").alias("b"), F.count(F.lit(1)).alias("n"))
        near = F.forall(F.zip_with("a", "b", lambda a, b: F.abs(a - b) <= 1e-10 * F.greatest(F.abs(a), F.abs(b))), lambda ok: F.coalesce(ok, F.lit(False)))
        if sides.filter(~near | F.exists("a", F.isnan) | (F.col("n") != 2)).isEmpty():
            return done.filter("edge is null")
        release(done)
        halo *= 4


def border_rows(shard: np.ndarray, shards: np.ndarray, core: np.ndarray, usable: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(lane, row, edge, backward) of the usable rows at the borders of the lanes, row -1 where a border has none.

    Forward states belong to the first usable row after a border, backward ones to the last one before it; `shard` and
    `shards` are per lane. Rows of a lane are those before its core, its core, and those after it.
    """
    n = len(core)
    where = np.arange(n)
    lane = np.repeat(np.arange(len(shard)), np.diff(starts))
    first_core = np.full(len(shard), n)
    last_core = np.full(len(shard), -1)
    np.minimum.at(first_core, lane[core], where[core])
    np.maximum.at(last_core, lane[core], where[core])
    out = []
    for right in (False, True):
        has = np.flatnonzero(shard < shards - 1 if right else shard > 0)
        border = shard[has] + right
        # the border lies before row `at` of the lane
        at = last_core[has] + 1 if right else first_core[has]
        good = np.flatnonzero(usable)
        k = np.searchsorted(good, at)
        after = np.where(k < len(good), good[np.minimum(k, max(len(good) - 1, 0))] if len(good) else -1, -1)
        before = np.where(k > 0, good[np.maximum(k - 1, 0)] if len(good) else -1, -1)
        after = np.where((after >= 0) & (after < starts[has + 1]), after, -1)
        before = np.where(before >= starts[has], before, -1)
        out += [(has, after, 2 * border, False), (has, before, 2 * border + 1, True)]
    return out


class Lockstep:
    """Walks lanes of unequal length together: step j holds the j-th element of every lane that long.

    `pack` puts an array into step-major order, in which step j is the slice `at(j)` and a lane keeps its
    place in every slice (lanes are ordered by falling length); `unpack` undoes it. With `backward` step 0
    holds the last elements.
    """

    def __init__(self, starts: np.ndarray, backward: bool = False):
        lengths = np.diff(starts)
        self.order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        step = np.arange(starts[-1]) - np.repeat(starts[:-1], lengths)
        if backward:
            step = np.repeat(lengths, lengths) - 1 - step
        self.steps = int(lengths.max()) if len(lengths) else 0
        longer = np.sort(lengths)
        self.active = len(lengths) - np.searchsorted(longer, np.arange(self.steps), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        self.place = self.offset[step] + np.repeat(rank, lengths)

    def pack(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.place] = values
        return out

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        return packed[self.place]

    def at(self, j: int) -> slice:
        return slice(self.offset[j], self.offset[j + 1])


def lane_quantile(values: np.ndarray, starts: np.ndarray, q: float) -> np.ndarray:
    """Lower empirical `q` quantile of each lane's finite values, NaN where a lane has none."""
    lane = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((values, lane))  # NaN sorts last in its lane
    n = np.bincount(lane[np.isfinite(values)], minlength=len(starts) - 1)
    at = starts[:-1] + np.floor(q * np.maximum(n - 1, 0)).astype(np.int64)
    return np.where(n > 0, values[order][np.minimum(at, max(len(values) - 1, 0))], np.nan) if len(values) else np.full(len(n), np.nan)
