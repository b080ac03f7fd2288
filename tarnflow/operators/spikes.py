"""Implausible readings: robust EWMA control charts, run-length counters and physical limits per source."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.lanes import ROWS_PER_SHARD, Lockstep, border_rows, lagged, lane_quantile, long_series, lower_quantiles, map_lanes, settled
from tarnflow.session import materialise
from tarnflow.sources.tables import micros, present


#: Rows of each neighbour that a shard of a long series sees at first: 0.95 ** 1024, what is left of a chart's start, is nothing.
HALO_ROWS = 1024


@dataclass(frozen=True)
class Limits:
    """Physical range of a variable, and whether its scatter is a ratio (charted as logarithm)."""

    low: float
    high: float
    ratio: bool


# fixed values of the data description: pH 0..14, iron 0..1e9 microgram per litre
LIMITS = {"pH": Limits(0.0, 14.0, False), "Fe-Dis": Limits(0.0, 1e9, True), "Fe-Tot": Limits(0.0, 1e9, True)}


@dataclass(frozen=True)
class Chart:
    """Settings of the control charts.

    weight: of a new reading in the running mean; scale_weight: in the running scatter; far: distance in
    units of scatter from which a reading is suspect; clip: distance to which a reading is clipped before it
    updates the chart; confirm: successive suspects on one side that make a new level and not a fault; stuck:
    successive sample times with one value that make a stuck sensor; floor, ceiling: bounds of the running
    scatter, as parts of the series' overall scatter; least: absolute least scatter.
    """

    weight: float = 0.3
    scale_weight: float = 0.05
    far: float = 5.5
    clip: float = 3.0
    confirm: int = 3
    stuck: int = 6
    floor: float = 0.7
    ceiling: float = 1.3
    least: float = 0.02


def _side(y: np.ndarray, starts: np.ndarray, scatter: np.ndarray, chart: Chart, backward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One chart over every lane: the mean that each element was held against, suspicion as -1, 0, 1, and the chart's state there."""
    walk = Lockstep(starts, backward)
    lanes = len(starts) - 1
    base = np.maximum(scatter, chart.least)[walk.order]
    packed = walk.pack(y)
    mean_at, side_at, state_at = np.empty(len(y)), np.zeros(len(y), np.int8), np.empty((len(y), 3))
    head = np.full((5, lanes), np.nan)
    for j in range(min(5, walk.steps)):
        head[j, : walk.active[j]] = packed[walk.at(j)]
    mean, spread = np.nanmedian(head, axis=0), base.copy()
    run, last, recent = np.zeros(lanes, np.int64), np.zeros(lanes, np.int8), np.zeros((chart.confirm, lanes))
    for j in range(walk.steps):
        a, here = int(walk.active[j]), walk.at(j)
        m, s = mean[:a], np.clip(spread[:a], chart.floor * base[:a], chart.ceiling * base[:a])
        v = packed[here]
        off = v - m
        side = np.where(np.abs(off) > chart.far * s, np.sign(off), 0).astype(np.int8)
        mean_at[here] = m
        state_at[here] = np.column_stack([spread[:a], run[:a], last[:a]])
        side_at[here] = side
        run[:a] = np.where(side == 0, 0, np.where(side == last[:a], run[:a] + 1, 1))
        last[:a] = side
        recent[j % chart.confirm, :a] = v
        step = np.clip(off, -chart.clip * s, chart.clip * s)
        mean[:a] = m + chart.weight * step
        # 1.2533: mean absolute deviation to standard deviation; 1.083: the mean's own scatter at weight 0.3
        spread[:a] += chart.scale_weight * (1.2533 / 1.083 * np.abs(step) - spread[:a])
        new = np.flatnonzero(run[:a] >= chart.confirm)
        if len(new):  # further readings confirm the level: no fault, and the chart starts anew there
            for back in range(min(chart.confirm, j + 1)):
                side_at[walk.offset[j - back] + new] = 0
            mean[new] = np.median(recent[:, new], axis=0)
            run[new] = last[new] = 0
    return walk.unpack(mean_at), walk.unpack(side_at), walk.unpack(state_at)


def _stuck(value: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Elements in runs of at least `least` equal values inside a lane; NaN equals nothing."""
    n = len(value)
    fresh = np.ones(n, bool)
    fresh[1:] = value[1:] != value[:-1]
    fresh[starts[:-1][starts[:-1] < n]] = True
    run = np.cumsum(fresh) - 1
    return (np.bincount(run, minlength=1)[run] >= least) & ~np.isnan(value) if n else np.zeros(0, bool)


def judge(ts: np.ndarray, value: np.ndarray, ratio: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, chart: Chart, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reason of each reading (0 none, 1 impossible, 2 stuck, 3 spike), its distance in units of scatter, and the charts'
    states before its sample time (forward mean, scatter, run, side, then those backward; NaN at impossible readings).

    Rows are sorted by time inside each lane; `ratio`, `low` and `high` are per row. `known` is the scatter of each lane
    where the lane is a part of a series, NaN where it is to be taken from the lane.
    """
    n = len(value)
    lane = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    impossible = (value < low) | (value > high)
    # sample times: the readings of one lane and instant
    first = np.ones(n, bool)
    first[1:] = (ts[1:] != ts[:-1]) | (lane[1:] != lane[:-1])
    at = np.cumsum(first) - 1
    t_start = np.flatnonzero(first)
    t_lane = lane[t_start]
    lowest, highest = np.minimum.reduceat(value, t_start), np.maximum.reduceat(value, t_start)
    t_starts = np.searchsorted(t_lane, np.arange(len(starts)))
    stuck = _stuck(np.where(lowest == highest, value[t_start], np.nan), t_starts, chart.stuck)[at]

    y = np.where(ratio, np.log(np.maximum(value, 1e-9)), value)
    ok = np.flatnonzero(~impossible)
    far, z, states = np.zeros(n, bool), np.zeros(n), np.full((n, 8), np.nan)
    if len(ok):
        yo, ao = y[ok], at[ok]
        c_first = np.ones(len(ok), bool)
        c_first[1:] = ao[1:] != ao[:-1]
        c_at, c_start = np.cumsum(c_first) - 1, np.flatnonzero(c_first)
        # the charted value of a sample time: the median of its readings
        order = np.lexsort((yo, c_at))
        size = np.diff(np.append(c_start, len(ok)))
        charted = (yo[order][c_start + (size - 1) // 2] + yo[order][c_start + size // 2]) / 2
        c_lane = t_lane[ao[c_start]]
        lanes, c_starts = np.unique(c_lane, return_index=True)
        c_starts = np.append(c_starts, len(c_lane))
        jump = np.abs(np.diff(charted, prepend=np.nan))
        jump[c_starts[:-1]] = np.nan
        # of absolute differences of a normal series: median 0.954, upper quartile 1.627 times its scatter
        scatter = np.nan_to_num(np.maximum(lane_quantile(jump, c_starts, 0.5) / 0.954, 0.9 * lane_quantile(jump, c_starts, 0.75) / 1.627))
        if known is not None:
            scatter = np.where(np.isnan(known[lanes]), scatter, known[lanes])
        before, side_f, state_f = _side(charted, c_starts, scatter, chart, False)
        after, side_b, state_b = _side(charted, c_starts, scatter, chart, True)
        states[ok] = np.column_stack([before, state_f, after, state_b])[c_at]
        unit = np.maximum(np.repeat(scatter, np.diff(c_starts)), chart.least)
        own = np.minimum(np.abs(yo - before[c_at]), np.abs(yo - after[c_at])) / unit[c_at]
        edge = np.zeros(len(charted), bool)
        edge[c_starts[:-1]] = edge[c_starts[1:] - 1] = True  # nothing before, or nothing after
        hit = (side_f != 0) & (side_f == side_b) & ~edge
        z[ok] = own
        far[ok] = hit[c_at] & (own > chart.far * chart.floor)
    return np.where(impossible, 1, np.where(stuck, 2, np.where(far, 3, 0))).astype(np.int32), np.where(impossible, np.inf, z), states


def _kernel(limits: dict[str, Limits], chart: Chart, all_rows: bool):
    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        var = table.column("var").take(pa.array(starts[:-1])).to_pylist()
        size = np.diff(starts)
        per_row = lambda f: np.repeat(np.array([f(limits[v]) for v in var]), size)
        value = table.column("value").to_numpy()
        head = pa.array(starts[:-1])
        lane = lambda c: table.column(c).take(head).to_numpy(zero_copy_only=False)
        low, high = per_row(lambda x: x.low), per_row(lambda x: x.high)
        reason, z, states = judge(table.column("t").to_numpy(), value, per_row(lambda x: x.ratio), low, high, starts, chart, lane("scatter").astype(float))
        core = table.column("core").to_numpy(zero_copy_only=False)
        keep = core if all_rows else core & (reason > 0)
        rows = np.flatnonzero(keep)
        key = lambda at: [table.column(c).take(pa.array(at)).combine_chunks() for c in ("wqms_id", "var")]
        names = ["wqms_id", "var", "obs_id", "value", "reason", "distance", "edge", "state"]
        none = pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.list_(pa.float64()))
        out = [pa.table([*key(rows), table.column("obs_id").to_numpy()[rows], value[rows], reason[rows], z[rows], *none], names=names)]
        for at, row, edge, backward in border_rows(lane("shard"), lane("shards"), core, (value >= low) & (value <= high), starts):
            state = np.where((row >= 0)[:, None], states[row][:, 4:] if backward else states[row][:, :4], np.nan)
            blank = [pa.nulls(len(at), k) for k in (pa.int64(), pa.float64(), pa.int32(), pa.float64())]
            out.append(pa.table([*key(starts[at]), *blank, pa.array(edge.astype(np.int32)), pa.array(list(state), pa.list_(pa.float64()))], names=names))
        return pa.concat_tables(out)

    return run


def _scatter(limits: dict[str, Limits], rows: DataFrame) -> DataFrame:
    """The scatter that `judge` finds in a whole series, for series cut into shards: wqms_id, var, scatter."""
    keys = ["wqms_id", "var"]
    pick = lambda f: F.coalesce(*(F.when(F.col("var") == v, F.lit(f(x))) for v, x in limits.items()))
    good = rows.filter(F.col("value").between(pick(lambda x: x.low), pick(lambda x: x.high)))
    y = F.when(pick(lambda x: x.ratio), F.log(F.greatest("value", F.lit(1e-9)))).otherwise(F.col("value"))
    charted = materialise(good.groupBy(*keys, "t").agg(F.median(y).alias("y")))
    jumps = lagged(charted, keys, ["t"], "y", "_last").select(*keys, F.abs(F.col("y") - F.col("_last")).alias("jump")).filter("jump is not null")
    q = lower_quantiles(materialise(jumps), keys, "jump", {"_half": 0.5, "_upper": 0.75})
    return q.select(*keys, F.greatest(F.col("_half") / 0.954, 0.9 * F.col("_upper") / 1.627).alias("scatter"))


def implausible(obs: DataFrame, limits: dict[str, Limits] = LIMITS, variables: tuple[str, ...] = ("pH", "Fe-Dis"), chart: Chart = Chart(), all_rows: bool = False, rows_per_shard: int = ROWS_PER_SHARD, halo: int = HALO_ROWS) -> DataFrame:
    """Readings of `obs` that their own station cannot have measured.

    Columns: obs_id, value, reason (1 outside the physical limits, 2 in a run of equal values, 3 far off the
    readings before and after), distance (in units of the station's scatter; infinite for reason 1). With
    `all_rows` every judged reading, the good ones with reason 0.

    Each station and variable is charted forward and backward in time. A suspect is clipped before it moves
    the mean or the scatter; three suspects in a row on one side are a new level, withdrawn as faults. A spike
    must be suspect in both directions on the same side, so steps, floods and gaps are none, and nothing is said
    of a series' first and last sample time. Rows without ts or value (NULL or NaN), of other variables or with
    NULL station are not judged. A row delivered twice appears twice; an empty table gives no rows; further
    columns are ignored. Series over `rows_per_shard` rows are charted in overlapping time shards with the scatter of the
    whole series (`lanes.settled`), which gives what one chart over all of it gives.
    """
    rows = obs.filter(F.col("var").isin(*variables) & F.col("ts").isNotNull() & present("value") & F.col("wqms_id").isNotNull())
    rows = rows.select("wqms_id", "var", micros("ts").alias("t"), "obs_id", "value")
    schema = "wqms_id string, var string, obs_id bigint, value double, reason int, distance double, edge int, state array<double>"
    keys, kernel = ["wqms_id", "var"], _kernel(limits, chart, all_rows)
    whole, ranked = long_series(rows, keys, ["t"], True, rows_per_shard)
    out = map_lanes(whole.withColumn("scatter", F.lit(None).cast("double")), [*keys, "shard"], ["t", "obs_id", "value"], kernel, schema)
    if ranked is not None:
        known = materialise(_scatter(limits, ranked))
        out = out.unionByName(settled(ranked, keys, ["t", "obs_id", "value"], kernel, schema, known, rows_per_shard, halo))
    return out.select("obs_id", "value", "reason", "distance")
