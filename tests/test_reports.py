import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import hierarchy, lanes, metrics, network, raster, series


def test_quantiles_equal_interpolated_ones(spark, monkeypatch):
    monkeypatch.setattr(lanes, "BIN_ROWS", 100)
    r = random.Random(1)
    v = {"a": [r.choice([1.0, 2.0, r.random()]) for _ in range(777)], "b": [3.0], "c": [r.gauss(0, 1) for _ in range(50)]}
    df = spark.createDataFrame([(k, x) for k, xs in v.items() for x in xs], "k string, x double")
    got = {x["k"]: x for x in lanes.quantiles(df, ["k"], "x", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    for k, xs in v.items():
        assert [got[k][c] for c in ("q1", "q2", "q9")] == pytest.approx(np.quantile(xs, [0.25, 0.5, 0.9]))
    assert lanes.quantiles(df.limit(0), ["k"], "x", {"q": 0.5}).collect() == []


def test_large_groups_have_the_same_metrics_and_constant_models_none(spark):
    r = random.Random(2)
    rows = [("a", r.gauss(5, 1), r.gauss(5, 2)) for _ in range(80)] + [("flat", float(i), 2.0) for i in range(5)] + [("nan", 1.0, math.nan)]
    df = spark.createDataFrame(rows, "k string, observed double, modelled double")
    one, two = ({x["k"]: x for x in metrics.fit_metrics(df, ["k"], large=b).collect()} for b in (False, True))
    assert one.keys() == two.keys() == {"a", "flat"}
    assert one["flat"]["n"] == 5 and one["flat"]["bias"] == 0.0 and all(one["flat"][c] is None for c in ("rmse", "r2", "nse", "kge", "fze"))
    assert list(one["a"])[1:] == pytest.approx(list(two["a"])[1:])


def test_p_values(spark):
    # of Student's t: n, r and the two-sided p by tables
    want = [(3, 0.5, 2 / 3), (5, 0.8783, 0.05), (10, 0.6319, 0.05), (102, 0.25, 0.01128), (30_000, 0.01, 0.08327), (8, 1.0, 0.0), (2, 0.5, None), (12, 0.0, 1.0)]
    df = spark.createDataFrame([(i, n, rho) for i, (n, rho, _) in enumerate(want)], "i int, n long, rho double")
    got = [x[0] for x in df.orderBy("i").select(metrics.student_p(F.col("rho"), F.col("n"))).collect()]
    for a, (_, _, b) in zip(got, want):
        assert a == b if b is None else a == pytest.approx(b, abs=2e-4)


def test_range_between_matches(spark):
    df = spark.createDataFrame([(i, i in (3, 6)) for i in range(10)] + [(None, True)], "id long, ok boolean")
    assert sorted(x["id"] for x in raster.between_matches(df, "id", F.col("ok")).collect()) == [3, 4, 5, 6]
    assert raster.between_matches(df, "id", F.lit(False)).collect() == []


def test_steps_accumulate_through_nodes_without_values(spark):
    # 1 -> 2 -> 3 -> 4, 5 -> 3, 6 <-> 7
    links = hierarchy.parent_links(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 0), (5, 3), (6, 7), (7, 6)], "id long, up long"), "id", "up")
    rows = [(1, "t1", 1.0), (1, "t2", 10.0), (3, "t1", 100.0), (4, "t1", 1000.0), (4, "t2", None), (5, "t2", 5.0), (6, "t1", 7.0)]
    values = spark.createDataFrame(rows, "node long, ts string, value double")
    got = {(x["node"], x["ts"]): x["total"] for x in network.accumulate_steps(links, values, "ts").collect()}
    assert got == {(1, "t1"): 1.0, (1, "t2"): 10.0, (3, "t1"): 101.0, (4, "t1"): 1101.0, (4, "t2"): 15.0, (5, "t2"): 5.0}


def test_prepared_flow_is_cut_to_box_and_years(spark):
    rows = [(0, c, 50.0, 10.0 * c, y, 5.0) for c in range(3) for y in range(2)]
    fields = [spark.createDataFrame(rows, f"row int, col int, lat double, lon double, year int, {q} double") for q in ("qav", "qmi", "qma")]
    calendar = fields[0].selectExpr("row", "col", "year", "2000 + year as calendar")
    all_ = series.prepare_flow(*fields, (0.0, 60.0, -5.0, 15.0), (1990, 2010), calendar).collect()
    assert {x["col"] for x in all_} == {0, 1} and len(all_) == 2 * 104 and all(x["q"] == pytest.approx(5.0) for x in all_)
    one = series.prepare_flow(*fields, (0.0, 60.0, -5.0, 5.0), (2000, 2000), calendar).collect()
    assert {x["col"] for x in one} == {0} and len(one) == 52
    assert series.prepare_flow(*fields, (-60.0, -50.0, -5.0, 5.0), (2000, 2000), calendar).collect() == []


def test_gap_clusters_over_ranges(spark):
    r = random.Random(3)
    day, t0, rows = 0, dt.datetime(2020, 1, 1), []
    for i in range(300):
        day += r.choice([1, 1, 2, 9])
        rows.append(("a" if i % 3 else "b", t0 + dt.timedelta(days=day), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int")
    want = {}
    for k in "ab":
        last, cluster, n = None, 1, 0
        for _, t, i in sorted(x for x in rows if x[0] == k):
            cluster, n = (cluster + 1, 1) if last and t - last > dt.timedelta(days=5) else (cluster, n + 1)
            want[i], last = (cluster, n), t
    for most in (40, 120, 1000):  # both series long, one, none
        got = {x["id"]: (x["cluster"], x["in_cluster"]) for x in series.gap_clusters(df, ["k"], "ts", 5 * series.DAY_US, "id", most).collect()}
        assert got == want
