"""Formulas against hand-computed values."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import chemistry, grids, hydraulics
from tarnflow.operators import metrics, series


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    "q,s,want",
    [
        (1.0, 0.01, (2.71, 0.349, 0.27752054, 0.966964978, 1.03416362, 1034163.62, 16.6000978)),
        (25.0, 0.002, (16.2787808, 1.04597901, 0.926868713, 0.966216544, 25.8741171, 25874117.1, 87.4702941)),
    ],
)
def test_hydraulics(spark, q, s, want):
    Q, S = F.lit(q), F.lit(s)
    v = hydraulics.velocity(Q, S)
    a = hydraulics.area(Q, v)
    got = one(spark, hydraulics.width(Q), hydraulics.depth(Q), hydraulics.hydraulic_radius(Q), v, a, hydraulics.volume(a), hydraulics.dispersion(Q, S))
    assert list(got) == pytest.approx(want, rel=1e-7)
    assert one(spark, hydraulics.courant_substeps(v, 604800.0), hydraulics.courant_substeps(v, 604800.0, 1000))[:] == (100, 585)


def test_flat_and_dry_cells(spark):
    got = one(spark, hydraulics.area(F.lit(3.0), hydraulics.velocity(F.lit(3.0), F.lit(0.0))), hydraulics.chemistry_velocity(F.lit(3.0), F.lit(0.0)), hydraulics.hydraulic_radius(F.lit(0.0)))
    assert tuple(got) == (1e-6, 1.0, 0.0)
    with pytest.raises(ValueError):
        hydraulics.seconds_of("year")


def test_chemistry_scalars(spark):
    h, fe3, fe2, so4 = (F.lit(x) for x in (1e-3, 1e-4, 2e-4, 5e-4))
    rate = one(spark, chemistry.oxidation_rate(F.lit(1e-7)), chemistry.oxidation_rate(F.lit(1e-3)))
    assert list(rate) == pytest.approx([2.79300061e-3, 6.3903e-10], rel=1e-4)
    got = one(spark, *chemistry.activities(h, fe3, fe2, so4), chemistry.ferric_at_equilibrium(h, fe3, fe2, so4), *chemistry.pyrite_rates(fe3, h, F.lit(94.0)))
    assert list(got) == pytest.approx([0.948931305, 0.623897099, 1.06314217e-4, 9.01522568e-7, 2.29385751e-8], rel=1e-7)
    ph = one(spark, chemistry.ph(F.lit(1e-7)), chemistry.ph(F.lit(0.0)), chemistry.ph(F.lit(1e-20)), chemistry.ph(F.lit(None).cast("double")))
    assert tuple(ph) == (7.0, None, 14.0, None)
    assert one(spark, *(chemistry.impact_class(F.lit(x)) for x in (0.0, 15.9, 16.0, 41.0)))[:] == (None, "low", "raised", "high")
    assert one(spark, chemistry.ore_area(F.lit(True), 94.0), chemistry.ore_area(F.lit(False)))[:] == (94.0, None)


def test_precipitation_keeps_iron(spark):
    rows = [(1e-3, 1e-5, 1e-4, 1e-4, 2e-4), (1e-6, 1e-5, 1e-4, 1e-4, 5e-4), (1e-3, 0.0, 0.0, 0.0, 1e-3), (1e-3, 1e-3, 1e-5, 1e-5, 5e-4)]
    df = spark.createDataFrame(rows, "fe3 double, h double, solid double, bed double, target double")
    after = chemistry.precipitate(*(F.col(c) for c in ("fe3", "h", "solid", "bed", "target")))
    for old, new in zip(rows, df.select(*(v.alias(k) for k, v in after.items())).collect()):
        assert old[0] + old[2] + old[3] == pytest.approx(new["ferric_iron"] + new["ferric_oxyhydroxide"] + new["bedload_storage"])
        assert min(new) >= 0


def test_d8_grid(spark):
    codes = [1, 4, 8, 255, 1, 2, 4, 16, 64, 1, 0, 32]
    df = spark.createDataFrame([(i // 4, i % 4, c) for i, c in enumerate(codes)], "r int, k int, c int")
    got = [x[0] for x in df.select(grids.d8_target(F.col("r"), F.col("k"), F.col("c"), 3, 4)).collect()]
    assert got == [1, 5, 5, None, 5, 10, 10, 6, 4, 10, 10, 6]
    back = one(spark, *(grids.d8_code(F.lit(r), F.lit(k)) for r, k in grids.D8.values()), grids.d8_code(F.lit(2), F.lit(0)), grids.d8_code(F.lit(None).cast("int"), F.lit(0)))
    assert list(back) == [*grids.D8, 255, 255]
    assert one(spark, grids.row_of(F.lit(90 - 1 / 240)), grids.row_of(F.lit(90.0)), grids.column_of(F.lit(-180 + 3 / 240)))[:] == (0, 0, 1)
    whole = spark.range(0, 180).select(F.sum(grids.cell_area_km2(F.col("id") - 89.5, 1.0)) * 360).first()[0]
    assert whole == pytest.approx(510065621.7, rel=1e-6)


def test_spline(spark):
    df = spark.createDataFrame([(1, 10.0, 0, 5.0, 1.0, 10.0), (2, -10.0, 0, 5.0, 1.0, 10.0), (3, 1.0, 0, 5.0, None, 10.0), (4, 1.0, 0, 5.0, 1.0, 10.0), (4, 1.0, 1, 6.0, 2.0, 12.0)], "k int, lat double, year int, qav double, qmi double, qma double")
    got = {(r["k"], r["week"]): r["q"] for r in series.seasonal_weeks(df, ["k"], "lat").collect()}
    assert sorted(w for k, w in got if k == 1) == list(range(1, 53)) and sorted(w for k, w in got if k == 4) == list(range(1, 105)) and not any(k == 3 for k, _ in got)
    assert [got[1, w] for w in (1, 2, 8, 15, 28, 52)] == pytest.approx([9.935366409, 10, 8.304050979, 5, 1, 9.7715066], abs=1e-7)
    assert got[2, 2] == 1 and got[2, 28] == 10 and got[4, 54] == 12


def test_metrics(spark):
    df = spark.createDataFrame([("a", o, m) for o, m in zip([1.0, 2.0, 4.0, 9.0], [2.0, 2.0, 6.0, 8.0])] + [("b", 1.0, 2.0), ("b", 1.0, None), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 4.0)], "k string, observed double, modelled double")
    got = {r["k"]: r for r in metrics.fit_metrics(df, ["k"]).collect()}
    a = got["a"]
    assert (a["n"], a["bias"]) == (4, 0.5)
    assert [a[c] for c in ("rmse", "r2", "nse", "nse_standard", "kge", "kge_standard", "fze")] == pytest.approx([1.224744871, 0.842105263, 0.777777778, 0.842105263, 0.773968167, 0.789481083, 0.681756363], abs=1e-8)
    assert got["b"]["n"] == 1 and got["b"]["bias"] == 1 and got["b"]["rmse"] is None and got["c"]["rmse"] is None and got["c"]["n"] == 3
    assert metrics.legacy_fze(df.filter("k = 'a'"), ["k"]).first()[1] == pytest.approx(1 - ((0.842105263 - 1) ** 2 + 0.285714286**2 + 0.125**2) ** 0.5, abs=1e-8)
    s = metrics.spearman(spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 1.0), (1, 2.0, 2.0), (1, 5.0, 9.0)], "k int, x double, y double"), ["k"], "x", "y").first()
    assert s["rho"] == pytest.approx(0.3162278, abs=1e-6) and s["n"] == 4
    bins = spark.createDataFrame([(x,) for x in (0.0, 0.99, 1.0, 9.99, 10.0)], "v double").select(metrics.equal_bins(F.col("v"), F.lit(0.0), F.lit(10.0))).collect()
    assert [b[0] for b in bins] == [1, 1, 2, 10, 10]


def test_weeks(spark):
    d = dt.datetime
    rows = [("s", d(2024, 1, 7, 13), 1.0), ("s", d(2024, 1, 8), 2.0), ("s", d(2024, 1, 14, 23, 59), 3.0), ("s", d(2024, 1, 22), 4.0), ("s", None, 9.0), ("t", d(2024, 1, 1), None)]
    got = series.weekly_mean(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), ["k"], "ts", "v").orderBy("k", "week_end").collect()
    assert [(r["k"], str(r["week_end"]), r["value"], r["n"]) for r in got] == [("s", "2024-01-07", 1.0, 1), ("s", "2024-01-14", 2.5, 2), ("s", "2024-01-21", None, 0), ("s", "2024-01-28", 4.0, 1), ("t", "2024-01-07", None, 0)]
    near = spark.createDataFrame([(d(2024, 1, 8),), (d(2024, 1, 10, 12),), (d(2024, 1, 10, 12, 1),), (d(2024, 1, 14),)], "ts timestamp_ntz").select(series.nearest_week_end(F.col("ts"))).collect()
    assert [str(r[0]) for r in near] == ["2024-01-07", "2024-01-07", "2024-01-14", "2024-01-14"]


def test_asof_takes_the_nearest_row_even_if_empty(spark):
    day = series.DAY_US
    left = spark.createDataFrame([("a", 8 * day, 1), ("a", 10 * day, 2), ("b", 1, 3), ("a", 40 * day, 4)], "k string, t long, id int")
    right = spark.createDataFrame([("a", 7 * day, None), ("a", 14 * day, 5.0), ("a", 9 * day, 1.0), ("a", 11 * day, 2.0)], "k string, t long, v double")
    got = {r["id"]: (r["t_right"], r["v"]) for r in series.asof_nearest(left, right.filter("t in (7, 14) or t > 0"), ["k"], 14 * day, ["v"], ["id"]).collect()}
    assert got[1] == (7 * day, None) and got[2] == (9 * day, 1.0) and got[3] == (None, None) and got[4] == (None, None)


def test_gap_clusters(spark):
    d = dt.datetime
    rows = [("a", d(2024, 1, 1), 1), ("a", d(2024, 1, 2), 2), ("a", d(2024, 1, 3), 3), ("a", d(2024, 3, 1), 4)]
    got = series.gap_clusters(spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int"), ["k"], "ts", 5 * series.DAY_US, "id").orderBy("id").collect()
    assert [(r["cluster"], r["in_cluster"], r["offset"]) for r in got] == [(1, 1, -0.5), (1, 2, 0.0), (1, 3, 0.5), (2, 1, 0.0)]
