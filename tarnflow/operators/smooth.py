"""Irregular readings onto a regular weekly grid: a Kalman smoother with continuous-time local trend."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.lanes import ROWS_PER_SHARD, Kernel, Lockstep, lagged, lane_quantile, long_series, lower_quantiles, map_lanes, time_shards
from tarnflow.operators.spikes import LIMITS, Limits
from tarnflow.session import materialise
from tarnflow.sources.tables import micros, present

DAY = 86_400_000_000
WEEK = 7 * DAY
#: 1970-01-01 was a Thursday: Mondays are at MONDAY + k weeks.
MONDAY = -3 * DAY


@dataclass(frozen=True)
class Trend:
    """Settings of the local trend model, times in days.

    swing_days: time over which the level is taken to move by its own overall scatter, which sets the
    slope's noise; clip: readings are held to this many times their noise around the median of their neighbours;
    least: least scatter of a reading; prior_slope: standard deviation of the first slope, per day.
    """

    swing_days: float = 60.0
    clip: float = 4.0
    least: float = 0.02
    prior_slope: float = 0.05


MOMENTS = ("m0", "m1", "p00", "p01", "p11")
#: Level, half width and median step of a series, by which its noise is set.
STATISTICS = ["middle", "half", "steps"]
#: Moments of a shard's first row after its reading, and smoothed ones of the row after its last.
ENTRY, LEAVE = [f"entry_{m}" for m in MOMENTS], [f"leave_{m}" for m in MOMENTS]


@dataclass(frozen=True)
class Noise:
    """What `smooth` needs of each lane: level, scatter, noise of a reading, and spectral density of the slope's noise."""

    level: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    density: np.ndarray


def noise_of(y: np.ndarray, used: np.ndarray, starts: np.ndarray, trend: Trend, known: np.ndarray | None = None) -> Noise:
    """The noise of each lane; `known` (STATISTICS per lane) are the whole series' where a lane is a part of it, else NaN."""
    n = len(y)
    lane = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    seen = np.where(used, y, np.nan)
    q = lambda x, p: lane_quantile(x, starts, p)
    found = [q(seen, 0.5), (q(seen, 0.84) - q(seen, 0.16)) / 2]
    at = np.flatnonzero(used)
    jump = np.full(n, np.nan)
    if len(at) > 1:
        same = lane[at[1:]] == lane[at[:-1]]
        jump[at[1:][same]] = np.abs(np.diff(y[at]))[same]
    found.append(q(jump, 0.5))
    if known is not None:
        found = [np.where(np.isnan(k), x, k) for k, x in zip(known, found)]
    level, spread = np.nan_to_num(found[0]), np.maximum(np.nan_to_num(found[1]), trend.least)
    # a Wiener process of spectral density g integrated over T has variance g T^3 / 3
    return Noise(level, spread, np.maximum(np.nan_to_num(found[2]) / 0.954, trend.least), 3 * spread**2 / trend.swing_days**3)


def prior(noise: Noise, trend: Trend) -> list[np.ndarray]:
    """Moments of each lane's state before its first reading."""
    none = np.zeros(len(noise.level))
    return [noise.level, none, 4 * noise.spread**2 + noise.noise**2, none, none + trend.prior_slope**2]


def clipped(y: np.ndarray, used: np.ndarray, starts: np.ndarray, noise: np.ndarray, trend: Trend) -> np.ndarray:
    """Readings held to `clip` times the noise around the median of the used ones among the five rows around each."""
    n = len(y)
    if not n:
        return y
    lane = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    seen = np.where(used, y, np.nan)
    around = np.full((5, n), np.nan)
    for k, shift in enumerate(range(-2, 3)):
        at = np.arange(n) + shift
        ok = (at >= 0) & (at < n)
        ok[ok] &= lane[at[ok]] == lane[ok]
        around[k, ok] = seen[at[ok]]
    around.sort(axis=0)  # NaN last
    count = np.maximum(np.isfinite(around).sum(axis=0), 1)
    middle = (around[(count - 1) // 2, np.arange(n)] + around[count // 2, np.arange(n)]) / 2
    wide = trend.clip * noise[lane]
    return np.where(used, np.clip(y, middle - wide, middle + wide), y)


def smooth(
    t: np.ndarray, y: np.ndarray, used: np.ndarray, starts: np.ndarray, trend: Trend, noise: Noise, entry: np.ndarray | None = None, leave: np.ndarray | None = None
) -> dict[str, np.ndarray]:
    """Filtered, predicted and smoothed moments of every reading; t in microseconds, rows sorted by time per lane.

    The state is level and slope; between readings the level follows the slope and the slope is a Wiener
    process. Rows that are not `used` are passed over like missing readings. `entry` are the filtered moments of a lane's
    first row and `leave` the smoothed ones of its last row where they are known (lane x MOMENTS, else NaN). Everything
    runs in lockstep.
    """
    n, lanes = len(y), len(starts) - 1
    lane = np.repeat(np.arange(lanes), np.diff(starts))
    walk = Lockstep(starts)
    dt = np.diff(t, prepend=t[:1]) / DAY
    head = starts[:-1][starts[:-1] < n]
    dt[head] = 0
    begin = prior(noise, trend)
    if entry is not None:
        given = np.isfinite(entry[:, 0])
        begin = [np.where(given, e, x) for e, x in zip(entry.T, begin)]
        used = used.copy()
        used[starts[:-1][given]] = False  # it is in the moments already
    T, Y, U = walk.pack(dt), walk.pack(np.where(used, y, 0.0)), walk.pack(used)
    R, G = (noise.noise**2)[walk.order], noise.density[walk.order]
    names = MOMENTS
    pred, filt, smoo = ({k: np.empty(n) for k in names} for _ in range(3))
    m0, m1, p00, p01, p11 = (x[walk.order] for x in begin)
    for j in range(walk.steps):
        a, here = int(walk.active[j]), walk.at(j)
        d, g, r = T[here], G[:a], R[:a]
        u0, u1 = m0[:a] + d * m1[:a], m1[:a]
        q11 = g * d
        c00 = p00[:a] + d * (2 * p01[:a] + d * p11[:a]) + q11 * d * d / 3
        c01 = p01[:a] + d * p11[:a] + q11 * d / 2
        c11 = p11[:a] + q11
        for k, v in zip(names, (u0, u1, c00, c01, c11)):
            pred[k][here] = v
        s = c00 + r
        e = np.where(U[here], Y[here] - u0, 0.0)
        k0, k1 = np.where(U[here], c00 / s, 0.0), np.where(U[here], c01 / s, 0.0)
        m0[:a], m1[:a] = u0 + k0 * e, u1 + k1 * e
        p00[:a], p01[:a], p11[:a] = c00 * (1 - k0), c01 * (1 - k0), c11 - k1 * c01
        for k, v in zip(names, (m0, m1, p00, p01, p11)):
            filt[k][here] = v[:a]
    for i, k in enumerate(names):
        smoo[k][:] = filt[k]
        if leave is not None:
            known = np.flatnonzero(np.isfinite(leave[:, 0]))
            smoo[k][walk.place[starts[known + 1] - 1]] = leave[known, i]
    for j in range(walk.steps - 2, -1, -1):
        a = int(walk.active[j + 1])
        nxt = walk.at(j + 1)
        here = slice(walk.offset[j], walk.offset[j] + a)
        f = [filt[k][here] for k in names]
        out = _back(f, T[nxt], [pred[k][nxt] for k in names], [smoo[k][nxt] for k in names])
        for k, v in zip(names, out):
            smoo[k][here] = v
    res = {f"{w}_{k}": walk.unpack(x[k]) for w, x in (("pred", pred), ("filt", filt), ("smoo", smoo)) for k in names}
    return res | {"density": noise.density[lane], "noise": noise.noise[lane]}


def digest(t: np.ndarray, y: np.ndarray, used: np.ndarray, starts: np.ndarray, noise: Noise) -> np.ndarray:
    """What each lane does to the state of its first row: lane x 14 numbers A (2 x 2), b, C (3), h, J (3).

    Given the state x of the first row, the filter comes to the mean A x + b and the covariance C at the last row, and the
    readings after the first say of x that J x = h, in the sense of information. So lanes are put together afterwards
    (`joined`), each digested by itself.
    """
    lanes = len(starts) - 1
    walk = Lockstep(starts)
    dt = np.diff(t, prepend=t[:1]) / DAY
    T, Y, U = walk.pack(dt), walk.pack(np.where(used, y, 0.0)), walk.pack(used)
    R, G = (noise.noise**2)[walk.order], noise.density[walk.order]
    x = np.zeros((14, lanes))
    x[0] = x[3] = 1.0
    for j in range(1, walk.steps):
        a, here = int(walk.active[j]), walk.at(j)
        d, g, u = T[here], G[:a], U[here]
        a00, a01, a10, a11, b0, b1, c00, c01, c11 = x[:9, :a]
        a00, a01, b0 = a00 + d * a10, a01 + d * a11, b0 + d * b1
        q = g * d
        c00, c01, c11 = c00 + d * (2 * c01 + d * c11) + q * d * d / 3, c01 + d * c11 + q * d / 2, c11 + q
        s = c00 + R[:a]
        e = np.where(u, Y[here] - b0, 0.0)
        w, k0, k1 = np.where(u, 1 / s, 0.0), np.where(u, c00 / s, 0.0), np.where(u, c01 / s, 0.0)
        x[9:, :a] += np.array([a00 * e * w, a01 * e * w, a00 * a00 * w, a00 * a01 * w, a01 * a01 * w])
        x[:9, :a] = a00 * (1 - k0), a01 * (1 - k0), a10 - k1 * a00, a11 - k1 * a01, b0 + k0 * e, b1 + k1 * e, c00 * (1 - k0), c01 * (1 - k0), c11 - k1 * c01
    out = np.empty((lanes, 14))
    out[walk.order] = x.T
    return out


def _told(m: np.ndarray, p: np.ndarray, h: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a state after the information J x = h."""
    gain = np.linalg.inv(np.eye(2) + p @ j)
    p = gain @ p
    return gain @ m + p @ h, (p + p.T) / 2


def joined(start: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered moments of each shard's first row, and smoothed moments of the row after its last (NaN at the end).

    `start` are the filtered moments of the series' first row, `parts` the `digest` of its shards in time.
    """
    square = lambda v: np.array([[v[0], v[1]], [v[1], v[2]]])
    flat = lambda m, p: np.array([m[0], m[1], p[0, 0], p[0, 1], p[1, 1]])
    split = [(x[:4].reshape(2, 2), x[4:6], square(x[6:9]), x[9:11], square(x[11:])) for x in parts]
    states = [(start[:2], square(start[2:]))]
    for a, b, c, h, j in split[:-1]:
        m, p = _told(*states[-1], h, j)
        states.append((a @ m + b, a @ p @ a.T + c))
    leave = np.full((len(parts), 5), np.nan)
    h1, j1 = np.zeros(2), np.zeros((2, 2))
    for k in range(len(parts) - 1, 0, -1):
        a, b, c, h, j = split[k]
        fade = a.T @ np.linalg.inv(np.eye(2) + j1 @ c)
        h1, j1 = h + fade @ (h1 - j1 @ b), j + fade @ j1 @ a
        j1 = (j1 + j1.T) / 2
        leave[k - 1] = flat(*_told(*states[k], h1, j1))
    return np.array([flat(*s) for s in states]), leave


def _back(f: list[np.ndarray], d: np.ndarray, pred: list[np.ndarray], smoo: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """One smoothing step: moments at a time from those at the next one, d later."""
    m0, m1, p00, p01, p11 = f
    u0, u1, c00, c01, c11 = pred
    s0, s1, v00, v01, v11 = smoo
    det = np.maximum(c00 * c11 - c01 * c01, 1e-300)
    a00, a10 = p00 + d * p01, p01 + d * p11  # P A'
    g00, g01 = (a00 * c11 - p01 * c01) / det, (p01 * c00 - a00 * c01) / det
    g10, g11 = (a10 * c11 - p11 * c01) / det, (p11 * c00 - a10 * c01) / det
    e0, e1, w00, w01, w11 = s0 - u0, s1 - u1, v00 - c00, v01 - c01, v11 - c11
    h00, h01 = g00 * w00 + g01 * w01, g00 * w01 + g01 * w11
    h10, h11 = g10 * w00 + g11 * w01, g10 * w01 + g11 * w11
    return (
        m0 + g00 * e0 + g01 * e1, m1 + g10 * e0 + g11 * e1,
        np.maximum(p00 + h00 * g00 + h01 * g01, 0.0), p01 + h00 * g10 + h01 * g11, np.maximum(p11 + h10 * g10 + h11 * g11, 0.0),
    )


def _between(x: dict[str, np.ndarray], left: np.ndarray, ahead: np.ndarray, right: np.ndarray, has_right: np.ndarray, d_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its variance `ahead` days after row `left`, `d_right` days before row `right`.

    Without a right row it is the prediction from `left`.
    """
    names = ("m0", "m1", "p00", "p01", "p11")
    m0, m1, p00, p01, p11 = (x[f"filt_{k}"][left] for k in names)
    q11 = x["density"][left] * ahead
    f = [m0 + ahead * m1, m1, p00 + ahead * (2 * p01 + ahead * p11) + q11 * ahead**2 / 3, p01 + ahead * p11 + q11 * ahead / 2, p11 + q11]
    b = _back(f, d_right, [x[f"pred_{k}"][right] for k in names], [x[f"smoo_{k}"][right] for k in names])
    return np.where(has_right, b[0], f[0]), np.where(has_right, b[2], f[2])


class _Rows:
    """Readings of lanes as arrays: time, value, charted value, use; halo rows are dropped but for the one after the core."""

    def __init__(self, table: pa.Table, starts: np.ndarray, limits: dict[str, Limits], trend: Trend):
        head = pa.array(starts[:-1])
        size = np.diff(starts)
        self.var = table.column("var").take(head).to_pylist()
        per_row = lambda f: np.repeat(np.array([f(limits[v]) for v in self.var]), size)
        lane_of = lambda c: table.column(c).take(head).to_numpy(zero_copy_only=False)
        t, value = table.column("t").to_numpy(), table.column("value").to_numpy()
        ratio = per_row(lambda x: x.ratio)
        used = (value >= per_row(lambda x: x.low)) & (value <= per_row(lambda x: x.high)) & ~(ratio & (value <= 0))
        y = np.where(ratio, np.log(np.where(used & ratio, value, 1.0)), np.where(used, value, 0.0))
        self.held = np.zeros(len(t), bool)
        if "held" in table.column_names:  # readings that the smoother must not see
            self.held = table.column("held").to_numpy(zero_copy_only=False) & used
            used = used & ~self.held
        known = np.array([lane_of(c).astype(float) for c in STATISTICS]) if STATISTICS[0] in table.column_names else None
        self.noise = noise_of(y, used, starts, trend, known)
        self.ends = [None, None]
        if ENTRY[0] in table.column_names:  # shards of long series
            self.ends = [np.column_stack([lane_of(c) for c in names]) for names in (ENTRY, LEAVE)]
        y = clipped(y, used, starts, self.noise.noise, trend)
        core = table.column("core").to_numpy(zero_copy_only=False)
        keep = core.copy()
        lane = np.repeat(np.arange(len(size)), size)
        keep[1:] |= core[:-1] & (lane[1:] == lane[:-1])
        self.rows = np.flatnonzero(keep)  # in the table
        self.t, self.value, self.y, self.used, self.held, self.core, self.ratio = (x[keep] for x in (t, value, y, used, self.held, core, ratio))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(lane[keep], minlength=len(size)))])
        self.shard, self.shards = lane_of("shard"), lane_of("shards")


def _digest_kernel(limits: dict[str, Limits], trend: Trend):
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        r = _Rows(table, starts, limits, trend)
        found = digest(r.t, r.y, r.used, r.starts, r.noise)
        at = r.starts[:-1]
        begin = prior(r.noise, trend)
        gain = np.where(r.used[at], begin[2] / (begin[2] + r.noise.noise**2), 0.0)
        first = np.column_stack([begin[0] + gain * (r.y[at] - begin[0]), begin[1], begin[2] * (1 - gain), begin[3], begin[4]])
        head = pa.array(starts[:-1])
        names = ["wqms_id", "var", "shard", "first", "part"]
        return pa.table([*(table.column(c).take(head).combine_chunks() for c in names[:3]), pa.array(list(first)), pa.array(list(found))], names=names)

    return run


def _join_kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
    first, part = (np.stack(table.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "part"))
    entry, leave = np.empty((len(part), 5)), np.empty((len(part), 5))
    for s, e in zip(starts[:-1], starts[1:]):
        entry[s:e], leave[s:e] = joined(first[s], part[s:e])
    names = ["wqms_id", "var", "shard"]
    return pa.table([*(table.column(c) for c in names), *(pa.array(np.ascontiguousarray(x)) for x in (*entry.T, *leave.T))], names=[*names, *ENTRY, *LEAVE])


def _kernel(limits: dict[str, Limits], trend: Trend):
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        r = _Rows(table, starts, limits, trend)
        table = table.take(pa.array(r.rows))
        t, value, used, core, ratio, starts, shard, shards = r.t, r.value, r.used, r.core, r.ratio, r.starts, r.shard, r.shards
        n, size = len(t), np.diff(starts)
        lane = np.repeat(np.arange(len(size)), size)
        x = smooth(t, r.y, used, starts, trend, r.noise, *r.ends)
        week = (t - MONDAY) // WEEK
        fresh = np.ones(n, bool)
        fresh[1:] = lane[1:] != lane[:-1]
        # weeks with core readings (and that of the row after them), and the empty ones after each core reading
        new_week = fresh.copy()
        new_week[1:] |= week[1:] != week[:-1]
        run_id, run_at = np.cumsum(new_week) - 1, np.flatnonzero(new_week)
        n_core = np.bincount(run_id, core, len(run_at)).astype(np.int64)
        total = np.bincount(run_id, np.where(core & used, value, 0.0), len(run_at))
        n_used = np.bincount(run_id, core & used, len(run_at)).astype(np.int64)
        kept = np.arange(len(run_at))
        gap = np.zeros(n, np.int64)
        gap[:-1] = np.where(fresh[1:] | ~core[:-1], 0, week[1:] - week[:-1] - 1)
        gap = np.maximum(gap, 0)
        holes = np.repeat(np.arange(n), gap)
        k = np.arange(len(holes)) - np.repeat(np.cumsum(gap) - gap, gap)
        grid_week = np.concatenate([week[run_at[kept]], week[holes] + 1 + k if len(holes) else np.zeros(0, np.int64)])
        anchor = np.concatenate([run_at[kept], holes]).astype(np.int64)  # a row of the lane
        # the grid time is the week's middle; the row before it may lie a few rows on inside the week
        mid = grid_week * WEEK + MONDAY + WEEK // 2
        g_lane = lane[anchor]
        low = t.min(initial=0)
        span = max(int(max(t.max(initial=0), mid.max(initial=0)) - min(low, mid.min(initial=low))) + 1, 1)
        base = min(low, int(mid.min(initial=low)))
        # one sorted key per lane and time; as float it may err by under a millisecond, which the model can't see
        order_key = lane.astype(np.float64) * span + (t - base)
        after = np.searchsorted(order_key, g_lane.astype(np.float64) * span + (mid - base), side="right")
        after = np.clip(after, starts[g_lane], starts[g_lane + 1])
        has_left, has_right = after > starts[g_lane], after < starts[g_lane + 1]
        left, right = np.where(has_left, after - 1, after), np.where(has_right, after, after - 1)
        mean, variance = _between(x, left, np.where(has_left, np.maximum(mid - t[left], 0) / DAY, 0.0), right, has_left & has_right, np.where(has_right, np.maximum(t[right] - mid, 0) / DAY, 0.0))
        # before a lane's first row: its smoothed level carried back along its slope
        lead = np.where(has_left, 0.0, (t[right] - mid) / DAY)
        first0, first1 = x["smoo_m0"][right] - lead * x["smoo_m1"][right], x["smoo_p00"][right] - 2 * lead * x["smoo_p01"][right] + lead**2 * x["smoo_p11"][right] + x["density"][right] * lead**3 / 3
        mean, variance = np.where(has_left, mean, first0), np.where(has_left, variance, np.maximum(first1, 0.0))
        deviation = np.sqrt(np.maximum(variance, 0.0))
        back = lambda v: np.where(ratio[anchor], np.exp(np.clip(v, -700, 700)), v)
        pad = len(holes)
        observed = np.concatenate([n_core[kept], np.zeros(pad, np.int64)])
        sums, of = np.concatenate([total[kept], np.zeros(pad)]), np.concatenate([n_used[kept], np.zeros(pad, np.int64)])
        # a week on a shard's border comes from every shard with a row of it; the one to keep has the row before its middle
        own = has_left | (shard[g_lane] == 0)
        rows = pa.array(anchor)
        names = ["wqms_id", "var", "turn", "week_end", "filled", "low", "high", "n_readings", "total", "n_used"]
        return pa.table(
            [
                table.column("wqms_id").take(rows).combine_chunks(), table.column("var").take(rows).combine_chunks(), pa.array(np.where(own, -shard[g_lane] - 1, 1).astype(np.int32)),
                pa.array(((grid_week + 1) * WEEK + MONDAY - DAY) // DAY, pa.int32()).cast(pa.date32()),
                pa.array(back(mean)), pa.array(back(mean - 1.96 * deviation)), pa.array(back(mean + 1.96 * deviation)),
                pa.array(observed), pa.array(sums), pa.array(of),
            ],
            names=names,
        )

    return run


def _statistics(limits: dict[str, Limits], rows: DataFrame) -> DataFrame:
    """The STATISTICS that `noise_of` takes of a whole series, for series cut into shards."""
    keys = ["wqms_id", "var"]
    pick = lambda f: F.coalesce(*(F.when(F.col("var") == v, F.lit(f(x))) for v, x in limits.items()))
    ratio = pick(lambda x: x.ratio)
    used = rows.filter(F.col("value").between(pick(lambda x: x.low), pick(lambda x: x.high)) & (~ratio | (F.col("value") > 0)))
    used = materialise(used.select(*keys, "t", F.when(ratio, F.log("value")).otherwise(F.col("value")).alias("y")))
    level = lower_quantiles(used, keys, "y", {"middle": 0.5, "_a": 0.16, "_b": 0.84})
    jumps = lagged(used, keys, ["t", "y"], "y", "_last").select(*keys, F.abs(F.col("y") - F.col("_last")).alias("jump")).filter("jump is not null")
    step = lower_quantiles(materialise(jumps), keys, "jump", {"steps": 0.5})
    return level.join(step, keys, "left").select(*keys, "middle", ((F.col("_b") - F.col("_a")) / 2).alias("half"), "steps")


def _readings(obs: DataFrame, limits: dict[str, Limits]) -> DataFrame:
    rows = obs.filter(F.col("var").isin(*limits) & F.col("ts").isNotNull() & present("value") & F.col("wqms_id").isNotNull())
    return rows.select("wqms_id", "var", micros("ts").alias("t"), "value")


def _mapped(rows: DataFrame, limits: dict[str, Limits], trend: Trend, kernel: Kernel, schema: str, rows_per_shard: int) -> list[DataFrame]:
    """`kernel` over whole series and, if there are any, over the shards of long ones between the true states at their ends."""
    keys, order = ["wqms_id", "var"], ["t", "value"]
    lanes = [*keys, "shard"]
    whole, ranked = long_series(rows, keys, order, False, rows_per_shard)
    out = [map_lanes(whole, lanes, order, kernel, schema)]
    if ranked is not None:
        seen = ranked.filter("not held") if "held" in ranked.columns else ranked
        # two rows of each neighbour: the medians of `clipped` reach as far
        cut = time_shards(ranked, rows_per_shard, 2).join(materialise(_statistics(limits, seen)), keys, "left")
        parts = map_lanes(cut, lanes, order, _digest_kernel(limits, trend), "wqms_id string, var string, shard int, first array<double>, part array<double>")
        # one row per shard: a series of a billion rows has some hundred thousand
        ends = materialise(map_lanes(parts, keys, ["shard"], _join_kernel, ", ".join(["wqms_id string, var string, shard int", *(f"{c} double" for c in (*ENTRY, *LEAVE))])))
        out.append(map_lanes(cut.join(ends, lanes), lanes, order, kernel, schema))
    return out


def _held_kernel(limits: dict[str, Limits], trend: Trend):
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        r = _Rows(table, starts, limits, trend)
        x = smooth(r.t, r.y, r.used, r.starts, trend, r.noise, *r.ends)
        at = np.flatnonzero(r.held & r.core)
        level, wide = x["smoo_m0"][at], 1.96 * np.sqrt(x["smoo_p00"][at] + x["noise"][at] ** 2)
        truth = np.where(r.ratio[at], np.log(np.maximum(r.value[at], 1e-300)), r.value[at])
        rows = pa.array(r.rows[at])
        return pa.table([*(table.column(c).take(rows) for c in ("wqms_id", "var", "t", "value")), pa.array(np.abs(truth - level)), pa.array(np.abs(truth - level) <= wide)], names=["wqms_id", "var", "t", "value", "error", "inside"])

    return run


def held_out(obs: DataFrame, part: int = 10, limits: dict[str, Limits] = LIMITS, trend: Trend = Trend(), rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """How well the smoother tells readings that it has not seen: wqms_id, var, t, value, error, inside.

    One in `part` sample times of every station and variable, by hash, is kept from the smoother; error is the distance of
    its smoothed level from the reading (iron: of the logarithms), inside whether the reading lies in its 95 % band, which
    is that of the level and a reading's noise. Impossible readings are not asked for. An empty table gives no rows.
    """
    rows = _readings(obs, limits).withColumn("held", F.pmod(F.xxhash64("wqms_id", "var", "t"), F.lit(part)) == 0)
    schema = "wqms_id string, var string, t bigint, value double, error double, inside boolean"
    return reduce(DataFrame.unionByName, _mapped(rows, limits, trend, _held_kernel(limits, trend), schema, rows_per_shard))


def weekly_series(obs: DataFrame, limits: dict[str, Limits] = LIMITS, trend: Trend = Trend(), rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One weekly row per station and variable from its first to its last week with a reading.

    Columns: wqms_id, var, week_end DATE (Sunday), observed (mean of the week's possible readings, NULL if
    none), n_readings, filled (smoothed value at the week's middle), low and high (its 95 % band), missing
    (no reading in the week). Iron is smoothed as logarithm, so its band is a ratio. Values outside the
    physical limits count as readings of their week but do not enter the smoother; a series with no possible
    reading is filled with the neutral value. Rows without ts, value or station, or of variables without
    limits, are no readings. Rows delivered twice count twice in n_readings. An empty table gives no rows.
    Series over `rows_per_shard` rows are cut into time shards, with the noise of the whole series. Each shard is digested
    to what it does to a state that enters it (`digest`), the digests of a series are put together (`joined`), and then each
    shard is smoothed between the true states at its ends: exactly what one smoother over all of it gives, to rounding.
    """
    keys = ["wqms_id", "var"]
    schema = "wqms_id string, var string, turn int, week_end date, filled double, low double, high double, n_readings bigint, total double, n_used bigint"
    both, *cut = _mapped(_readings(obs, limits), limits, trend, _kernel(limits, trend), schema, rows_per_shard)
    both = both.drop("turn")
    for weeks in cut:
        one = {c: F.min_by(c, "turn").alias(c) for c in ("filled", "low", "high")}
        both = both.unionByName(weeks.groupBy(*keys, "week_end").agg(*one.values(), *(F.sum(c).alias(c) for c in ("n_readings", "total", "n_used"))))
    mean = F.when(F.col("n_used") > 0, F.col("total") / F.col("n_used"))
    return both.select(*keys, "week_end", mean.alias("observed"), "n_readings", "filled", "low", "high", (F.col("n_readings") == 0).alias("missing"))
