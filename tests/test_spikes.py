import datetime as dt
import math
import random

from tarnflow.operators.spikes import implausible

SCHEMA = "obs_id long, wqms_id string, ts timestamp_ntz, var string, value double, load_ts timestamp_ntz, t long, shard string"
T0 = dt.datetime(2020, 1, 1)


def series(values, station="a", var="pH", first=1, hours=24.0):
    return [(first + i, station, T0 + dt.timedelta(hours=hours * i), var, v, T0, 1, "x") for i, v in enumerate(values)]


def noise(n, seed, centre=7.0, scatter=0.1):
    r = random.Random(seed)
    return [round(centre + r.gauss(0, scatter), 3) for _ in range(n)]


def found(spark, rows, **k):
    return {r["obs_id"]: r["reason"] for r in implausible(spark.createDataFrame(rows, SCHEMA), **k).collect()}


def test_limits_stuck_and_spikes(spark):
    v = noise(120, 1)
    v[30] = -1.0
    v[50] = 12.0  # one spike
    v[70], v[71] = 2.0, 2.3  # two in a row
    v[90:97] = [7.0] * 7  # stuck
    got = found(spark, series(v))
    assert got == {31: 1, 51: 3, 71: 3, 72: 3} | {i: 2 for i in range(91, 98)}


def test_steps_and_floods_are_no_faults(spark):
    v = noise(150, 2)
    v = v[:50] + [x + 3 for x in v[50:58]] + [x - 2 for x in v[58:]]
    assert found(spark, series(v)) == {}


def test_five_equal_are_not_stuck_and_missing_do_not_interrupt(spark):
    v = noise(60, 3)
    v[10:15] = [7.0] * 5
    v[30:37] = [7.1, 7.1, 7.1, math.nan, 7.1, 7.1, 7.1]
    got = found(spark, series(v))
    assert got == {i: 2 for i in (31, 32, 33, 35, 36, 37)}


def test_iron_is_judged_in_ratio(spark):
    r = random.Random(4)
    v = [100 * math.exp(r.gauss(0, 0.2)) for _ in range(100)]
    v[40] = v[40] * 1000
    v[60] = 0.1
    v[80] = 2e9
    assert found(spark, series(v, var="Fe-Dis")) == {41: 3, 61: 3, 81: 1}


def test_second_ids_and_resent_rows(spark):
    v = noise(80, 5)
    rows = series(v)
    rows[40] = (41, "a", rows[40][2], "pH", 13.0, T0, 1, "x")
    rows += [rows[40], (900, "a", rows[40][2], "pH", 13.1, T0, 1, "x")]
    assert found(spark, rows) == {41: 3, 900: 3}


def test_missing_values_columns_and_empty(spark):
    rows = [(1, None, T0, "pH", 99.0, T0, 1, "x"), (2, "a", None, "pH", 99.0, T0, 1, "x"), (3, "a", T0, "pH", None, T0, 1, "x"), (4, "a", T0, "other", 99.0, T0, 1, "x"), (5, "a", T0, None, 9.0, T0, 1, "x")]
    assert found(spark, rows) == {}
    assert found(spark, rows[:0]) == {}
    assert found(spark, [(6, "a", T0, "pH", 99.0, T0, 1, "x")]) == {6: 1}


def test_shards_agree_with_one_lane(spark):
    v = noise(3000, 6)
    r = random.Random(7)
    for i in r.sample(range(10, 2990), 40):
        v[i] = 11.0
    v[1000:1030] = [7.0] * 30
    v[1500:1510] = [-1.0] * 10
    rows = series(v, hours=1) + [(9001, "b", T0, "pH", 99.0, T0, 1, "x")]
    get = lambda **k: {x["obs_id"]: (x["reason"], x["distance"]) for x in implausible(spark.createDataFrame(rows, SCHEMA), all_rows=True, **k).collect()}
    whole = get()
    assert sum(x[0] > 0 for x in whole.values()) >= 60
    for size, halo in ((400, 300), (400, 8)):
        cut = get(rows_per_shard=size, halo=halo)
        assert cut.keys() == whole.keys()
        assert all(cut[k][0] == whole[k][0] and (cut[k][1] == whole[k][1] or abs(cut[k][1] - whole[k][1]) < 1e-9 * (1 + whole[k][1])) for k in whole)


def test_running_sums_in_ranges_whatever_the_times(spark, monkeypatch):
    from tarnflow.operators import lanes

    monkeypatch.setattr(lanes, "BIN_ROWS", 500)
    # one far time must not put all others into one range
    rows = [("a", i // 3, i) for i in range(5000)] + [("a", 10**15, 5000)] + [("b", i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(6)
    largest = lanes.ranges(df, ["k"], ["t"]).groupBy("_bin").count().agg({"count": "max"}).first()[0]
    assert largest < 1500
    got = {(r["k"], r["id"]): r["rank"] for r in lanes.running(df, ["k"], ["t"], lanes.F.lit(1), "rank").collect()}
    assert got == {("a", i): i // 3 * 3 for i in range(5000)} | {("a", 5000): 5000} | {("b", i): i for i in range(20)}
    last = {(r["k"], r["id"]): r["last"] for r in lanes.lagged(df, ["k"], ["t", "id"], "id", "last").collect()}
    assert last == {("a", i): i - 1 if i else None for i in range(5001)} | {("b", i): i - 1 if i else None for i in range(20)}
    q = lanes.lower_quantiles(df, ["k"], "id", {"low": 0.1, "mid": 0.5})
    assert {r["k"]: (r["low"], r["mid"]) for r in q.collect()} == {"a": (500, 2500), "b": (1, 9)}
