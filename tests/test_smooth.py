import datetime as dt
import math
import random

import numpy as np

from tarnflow.operators.smooth import DAY, Trend, clipped, digest, held_out, joined, noise_of, smooth, weekly_series

SCHEMA = "obs_id long, wqms_id string, ts timestamp_ntz, var string, value double, missing int"


def rts(t, y, used, trend):
    """A plain Kalman smoother of one series with matrices."""
    seen = np.sort(y[used])
    q = lambda p: seen[int(math.floor(p * (len(seen) - 1)))]
    spread = max((q(0.84) - q(0.16)) / 2, trend.least)
    jump = np.sort(np.abs(np.diff(y[used])))
    noise = max(jump[int(0.5 * (len(jump) - 1))] / 0.954, trend.least)
    g = 3 * spread**2 / trend.swing_days**3
    m, p = np.array([q(0.5), 0.0]), np.diag([4 * spread**2 + noise**2, trend.prior_slope**2])
    ms, ps, mp, pp, fs = [], [], [], [], []
    for i in range(len(t)):
        d = t[i] - t[i - 1] if i else 0.0
        f = np.array([[1, d], [0, 1]])
        m, p = f @ m, f @ p @ f.T + g * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]])
        mp.append(m), pp.append(p), fs.append(f)
        if used[i]:
            s = p[0, 0] + noise**2
            k = p[:, 0] / s
            m, p = m + k * (y[i] - m[0]), p - np.outer(k, p[0])
        ms.append(m), ps.append(p)
    out_m, out_p = [ms[-1]], [ps[-1]]
    for i in range(len(t) - 2, -1, -1):
        gain = ps[i] @ fs[i + 1].T @ np.linalg.inv(pp[i + 1])
        out_m.append(ms[i] + gain @ (out_m[-1] - mp[i + 1]))
        out_p.append(ps[i] + gain @ (out_p[-1] - pp[i + 1]) @ gain.T)
    return np.array(out_m[::-1]), np.array(out_p[::-1])


def test_lockstep_equals_matrices():
    r = np.random.default_rng(1)
    parts, starts = [], [0]
    for n in (40, 7, 90, 3):
        t = np.sort(r.uniform(0, 300, n))
        parts.append((t - t[0], 7 + np.sin(t / 40) + r.normal(0, 0.1, n), r.random(n) > 0.1))
        starts.append(starts[-1] + n)
    t, y, used = (np.concatenate([p[k] for p in parts]) for k in range(3))
    starts = np.array(starts)
    got = smooth(np.round(t * DAY).astype(np.int64), y, used, starts, Trend(), noise_of(y, used, starts, Trend()))
    for (a, b, c), s, e in zip(parts, starts, starts[1:]):
        m, p = rts(a, b, c, Trend())
        assert np.allclose(got["smoo_m0"][s:e], m[:, 0], atol=1e-6)
        assert np.allclose(got["smoo_p00"][s:e], p[:, 0, 0], atol=1e-6)


def test_clipping_by_neighbours():
    y = np.array([7.0, 7.1, 50.0, 7.2, 7.1, 9.0, 1.0, 1.1, 1.2])
    used = np.array([True] * 4 + [False] + [True] * 4)
    got = clipped(y, used, np.array([0, 6, 9]), np.array([0.1, 0.1]), Trend(clip=4.0))
    # around the third row 7, 7.1, 50, 7.2 are used: their median is 7.15; around the fourth 7.1, 50, 7.2, 9, around the sixth 7.2, 9: 8.1
    assert np.allclose(got, [7.0, 7.1, 7.55, 7.7, 7.1, 8.5, 1.0, 1.1, 1.2])


def test_digests_put_together_equal_one_filter():
    r = np.random.default_rng(5)
    n = 400
    t = np.cumsum(r.exponential(0.7, n))
    us, y, used = np.round(t * DAY).astype(np.int64), 3 + np.sin(t / 30) + r.normal(0, 0.2, n), r.random(n) > 0.1
    one = np.array([0, n])
    noise = noise_of(y, used, one, Trend())
    whole = smooth(us, y, used, one, Trend(), noise)
    cuts = [0, 50, 51, 180, n - 1]
    parts = [digest(us[a : b + 1], y[a : b + 1], used[a : b + 1], np.array([0, b + 1 - a]), noise)[0] for a, b in zip(cuts, cuts[1:])]
    names = ("m0", "m1", "p00", "p01", "p11")
    entry, leave = joined(np.array([whole[f"filt_{k}"][0] for k in names]), np.array(parts))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert np.allclose(entry[i], [whole[f"filt_{k}"][a] for k in names], rtol=1e-10, atol=1e-14)
        if i + 1 < len(parts):
            assert np.allclose(leave[i], [whole[f"smoo_{k}"][b] for k in names], rtol=1e-9, atol=1e-13)
    assert np.isnan(leave[-1]).all()


def rows_of(station, var, readings):
    return [(i, station, ts, var, v, 0) for i, (ts, v) in enumerate(readings)]


def test_weeks_gaps_and_values(spark):
    monday = dt.datetime(2024, 1, 1)
    r = random.Random(2)
    days = sorted(r.sample(range(0, 100), 40)) + [150, 151, 200]
    rows = rows_of("s", "pH", [(monday + dt.timedelta(days=d, hours=5), 7 + math.sin(d / 20) + r.gauss(0, 0.02)) for d in days])
    rows += [(99, "s", None, "pH", 7.0, 0), (98, "s", monday, "pH", math.nan, 0), (97, None, monday, "pH", 7.0, 0), (96, "s", monday, "colour", 7.0, 0)]
    rows.append((95, "s", monday + dt.timedelta(days=175), "pH", -999.0, 0))  # impossible, yet a reading of its week
    got = sorted(weekly_series(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda x: x["week_end"])
    weeks = {d // 7 for d in [*days, 175]}
    assert [x["week_end"] for x in got] == [dt.date(2024, 1, 7) + dt.timedelta(days=7 * k) for k in range(29)]
    assert {k for k, x in enumerate(got) if not x["missing"]} == weeks
    for k, x in enumerate(got):
        assert x["low"] <= x["filled"] <= x["high"]
        assert (x["observed"] is None) == (k not in {d // 7 for d in days})
        if k < 14:
            assert abs(x["filled"] - (7 + math.sin((7 * k + 3.5) / 20))) < 0.15
    assert got[26]["high"] - got[26]["low"] > got[5]["high"] - got[5]["low"]


def test_long_series_equal_whole_ones(spark):
    start = dt.datetime(2020, 1, 6)
    r = random.Random(3)
    rows = rows_of("s", "Fe-Tot", [(start + dt.timedelta(hours=3 * i + (2000 if i > 700 else 0)), math.exp(5 + math.sin(i / 200) + r.gauss(0, 0.1))) for i in range(1500)])
    rows += rows_of("t", "pH", [(start + dt.timedelta(hours=i), 7 + r.gauss(0, 0.1) if i % 9 else -1.0) for i in range(350)])
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda x: (x["wqms_id"], x["week_end"])
    whole = sorted(weekly_series(df).collect(), key=key)
    for size in (300, 7):
        cut = sorted(weekly_series(df, rows_per_shard=size).collect(), key=key)
        assert len(cut) == len(whole)
        for a, b in zip(cut, whole):
            assert (key(a), a["n_readings"], a["missing"]) == (key(b), b["n_readings"], b["missing"])
            for c in ("filled", "low", "high"):
                assert math.isclose(a[c], b[c], rel_tol=1e-9)


def test_week_longer_than_a_shard(spark):
    start = dt.datetime(2024, 1, 1)
    r = random.Random(4)
    df = spark.createDataFrame(rows_of("s", "pH", [(start + dt.timedelta(minutes=10 * i), 7 + r.gauss(0, 0.1)) for i in range(2500)]), SCHEMA)
    whole, cut = (sorted(x.collect(), key=lambda y: y["week_end"]) for x in (weekly_series(df), weekly_series(df, rows_per_shard=200)))
    assert len(cut) == len(whole) == 3
    for a, b in zip(cut, whole):
        assert a["n_readings"] == b["n_readings"] and all(math.isclose(a[c], b[c], rel_tol=1e-9) for c in ("observed", "filled", "low", "high"))


def test_empty_and_single(spark):
    assert weekly_series(spark.createDataFrame([], SCHEMA)).collect() == []
    one = weekly_series(spark.createDataFrame(rows_of("s", "pH", [(dt.datetime(2024, 1, 7, 13), 7.0)] * 2), SCHEMA)).collect()
    assert [(str(x["week_end"]), x["n_readings"], x["observed"], x["missing"]) for x in one] == [("2024-01-07", 2, 7.0, False)]
    late = weekly_series(spark.createDataFrame(rows_of("s", "pH", [(dt.datetime(2024, 1, 8), 7.0)]), SCHEMA)).collect()
    assert str(late[0]["week_end"]) == "2024-01-14"


def test_held_out_readings_lie_in_the_band(spark):
    r = random.Random(9)
    start = dt.datetime(2023, 1, 2)
    rows = rows_of("s", "pH", [(start + dt.timedelta(days=2 * i + r.random()), 7 + math.sin(i / 40) + r.gauss(0, 0.1)) for i in range(900)]) + rows_of("t", "pH", [(start, -5.0)] * 3)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {x["t"]: x for x in held_out(df, 5).collect()}
    assert 120 < len(whole) < 240 and 0.88 < sum(x["inside"] for x in whole.values()) / len(whole) <= 1 and sum(x["error"] for x in whole.values()) / len(whole) < 0.12
    cut = {x["t"]: x for x in held_out(df, 5, rows_per_shard=100).collect()}
    assert cut.keys() == whole.keys() and all(math.isclose(cut[k]["error"], whole[k]["error"], rel_tol=1e-6, abs_tol=1e-9) for k in whole)
    assert held_out(df.limit(0)).collect() == []
