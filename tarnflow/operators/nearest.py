"""Nearest record in time per entity: a piecewise-linear learned index over sorted time shards."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.lanes import map_lanes, ranges
from tarnflow.session import materialise

DAY = 86_400_000_000
#: Largest error of a predicted position, and points of a segment before it is tried.
MAX_ERROR, SEGMENT = 16, 1024
#: Rows (of both sides, about) of a shard.
ROWS_PER_SHARD = 50_000


class LearnedIndex:
    """Positions in sorted arrays, one per lane, predicted by line segments with bounded error.

    A segment joins the first and the last of its points by a line. Segments start at `SEGMENT` points and are
    halved, all at once, until no point lies more than `max_error` positions off its line; a segment of at most
    `max_error` points always qualifies, so the bound holds for any data. A lookup finds the segment, takes its
    prediction and searches the 2 * max_error + 2 positions around it.
    """

    def __init__(self, key: np.ndarray, starts: np.ndarray, max_error: int = MAX_ERROR, segment: int = SEGMENT):
        self.key, self.starts, self.max_error = key, starts, max_error
        n = len(key)
        size = np.diff(starts)
        lane = np.repeat(np.arange(len(size)), size)
        within = np.arange(n) - np.repeat(starts[:-1], size)
        begin = np.flatnonzero(within % segment == 0)
        while True:
            end = np.append(begin, n)[1:]
            slope = (end - 1 - begin) / np.maximum(key[end - 1] - key[begin], 1)
            seg = np.repeat(np.arange(len(begin)), end - begin)
            off = np.abs(begin[seg] + slope[seg] * (key - key[begin][seg]) - np.arange(n))
            bad = np.zeros(len(begin), bool)
            bad[seg[off > max_error]] = True
            bad &= end - begin > max_error
            if not bad.any():
                break
            begin = np.sort(np.concatenate([begin, (begin + (end - begin) // 2)[bad]]))
        self.begin, self.slope, self.end = begin, slope, end
        self.first = np.searchsorted(lane[begin] if n else begin, np.arange(len(starts)))  # segments of each lane

    def insertion(self, lane: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The number of rows of `lane` with key <= x, as a position in the flat array."""
        low, high = self.first[lane], self.first[lane + 1]
        none = low == high
        seg = _bisect(self.key[self.begin] if len(self.begin) else self.key, low, high, x) - 1
        before = seg < low
        seg = np.clip(seg, low, np.maximum(high - 1, low))
        if not len(self.key):
            return self.starts[lane]
        seg = np.minimum(seg, len(self.begin) - 1)
        guess = self.begin[seg] + self.slope[seg] * np.clip(x - self.key[self.begin[seg]], 0, None)
        guess = np.clip(guess, self.begin[seg], self.end[seg]).astype(np.int64)
        a = np.maximum(guess - self.max_error - 1, self.begin[seg])
        b = np.minimum(guess + self.max_error + 2, self.end[seg])
        at = _bisect(self.key, a, b, x)
        return np.where(none | before, self.starts[lane], at)


def _bisect(key: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """First position in [low, high) whose key is greater than x, for many windows at once."""
    low, high = low.copy(), high.copy()
    last = max(len(key) - 1, 0)
    while len(low) and (open_ := low < high).any():
        mid = (low + high) // 2
        right = open_ & (key[np.minimum(mid, last)] <= x)
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def nearest(left_t: np.ndarray, left_lane: np.ndarray, right_t: np.ndarray, right_starts: np.ndarray, tolerance: int, max_error: int = MAX_ERROR) -> np.ndarray:
    """Position of the nearest right row of the same lane within `tolerance`, the earlier one in a tie, else -1.

    Right times are strictly rising inside a lane.
    """
    if not len(right_t) or not len(left_t):
        return np.full(len(left_t), -1)
    at = LearnedIndex(right_t, right_starts, max_error).insertion(left_lane, left_t)
    far = np.int64(2**62)
    lo, hi = right_starts[left_lane], right_starts[left_lane + 1]
    behind = np.where(at > lo, left_t - right_t[np.maximum(at - 1, 0)], far)
    ahead = np.where(at < hi, right_t[np.minimum(at, len(right_t) - 1)] - left_t, far)
    best = np.where(behind <= ahead, at - 1, at)
    return np.where(np.minimum(behind, ahead) <= tolerance, best, -1)


def _kernel(tolerance: int, max_error: int):
    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        lane = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        is_left = table.column("side").to_numpy() == 1
        t, ident = table.column("t").to_numpy(), table.column("id").to_numpy()
        new = np.ones(len(t), bool)
        same = (lane[1:] == lane[:-1]) & (t[1:] == t[:-1]) & (is_left[1:] == is_left[:-1])
        # rows are sorted by side, t, id: of right rows at one time the least id stays, of left rows each id once
        new[1:] = ~(same & (~is_left[1:] | (ident[1:] == ident[:-1])))
        r, q = np.flatnonzero(new & ~is_left), np.flatnonzero(new & is_left)
        r_starts = np.searchsorted(lane[r], np.arange(len(starts)))
        found = nearest(t[q], lane[q], t[r], r_starts, tolerance, max_error)
        hit = found >= 0
        at = r[found[hit]]
        return pa.RecordBatch.from_arrays([pa.array(ident[q][hit]), pa.array(ident[at]), pa.array(t[at] - t[q][hit])], ["left_id", "right_id", "dt_us"])

    return run


def nearest_in_time(left: DataFrame, right: DataFrame, entity: list[str], tolerance_us: int, rows_per_shard: int = ROWS_PER_SHARD, max_error: int = MAX_ERROR) -> DataFrame:
    """The nearest `right` row in time of each `left` row with the same entity, at most `tolerance_us` away.

    Both inputs have the entity columns, `t` BIGINT in microseconds and `id` BIGINT. Result: left_id, right_id,
    dt_us (right minus left). Ties go to the earlier time, then the smaller id. Each left id of an entity and
    time appears once however often it is repeated; left rows without a partner have no row. Rows with NULL in
    an entity column, t or id match nothing. Empty inputs give an empty result.

    Both sides are cut together into ranges of entity and time of about `rows_per_shard` rows, so neither a hot entity nor
    a dense time makes a large task. Shards overlap by the right rows next to their edges: a shard also gets the last
    right row before it and the first one after it, which may lie several shards away.
    """
    known = lambda df, side: df.select(*entity, F.lit(side).alias("side"), "t", "id").dropna()
    both = ranges(materialise(known(right, 0).unionByName(known(left, 1))), entity, ["t"], rows_per_shard)
    is_right = F.col("side") == 0
    ends = both.groupBy(*entity, "_bin").agg(F.min(F.when(is_right, F.struct("t", "id"))).alias("_first"), F.max(F.when(is_right, F.struct(F.col("t"), (-F.col("id")).alias("less")))).alias("_last"))
    along = Window.partitionBy(*entity).orderBy("_bin")  # a row per shard
    before = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    edges = ends.select(*entity, "_bin", F.struct(before["t"], (-before["less"]).alias("id")).alias("_a"), F.struct(after["t"], after["id"]).alias("_b"))
    edges = edges.select(*entity, "_bin", F.lit(0).alias("side"), F.explode(F.array("_a", "_b")).alias("_e")).filter("_e.t is not null").select(*entity, "_bin", "side", "_e.t", "_e.id")
    return map_lanes(both.unionByName(edges), [*entity, "_bin"], ["side", "t", "id"], _kernel(tolerance_us, max_error), "left_id bigint, right_id bigint, dt_us bigint")
