import math

import pytest

from tarnflow.operators import hierarchy, raster


def grid(spark, lines):
    return spark.createDataFrame([(r, c, v) for r, line in enumerate(lines) for c, v in enumerate(line)], "row int, col int, value double")


def values(df, name="value"):
    return {(r["row"], r["col"]): r[name] for r in df.collect()}


def test_box_merge_and_lines(spark):
    df = spark.createDataFrame([(1.0, 179.0), (1.0, -179.0), (1.0, 0.0), (5.0, 0.0)], "lat double, lon double")
    assert raster.box(df, 0, 2, 178, -178).count() == 2 and raster.box(df, 1, 5, -1, 1).count() == 2
    g = grid(spark, [[None, 1.0, math.nan], [None, None, math.nan], [2.0, 3.0, None]])
    assert set(values(raster.drop_empty_lines(g, "value"))) == {(0, 0), (0, 1), (2, 0), (2, 1)}
    a, b = grid(spark, [[1.0, 2.0]]), grid(spark, [[5.0]]).withColumnRenamed("value", "other")
    assert {tuple(r) for r in raster.merge(a, b).collect()} == {(0, 0, 1.0, 5.0), (0, 1, 2.0, None)}
    assert values(raster.dense(a.unionByName(spark.createDataFrame([(2, 1, 9.0)], "row int, col int, value double")), "value")) == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): None, (1, 1): None, (2, 0): None, (2, 1): 9.0}
    assert raster.dense(a.limit(0), "value").collect() == []


def test_coarsen_keeps_planes_and_slope_of_planes(spark):
    plane = grid(spark, [[3.0 * r + 4.0 * c for c in range(12)] for r in range(12)])
    got = values(raster.coarsen(plane, "value", 3))
    assert sorted(got) == [(r, c) for r in range(4) for c in range(4)]
    for r in (1, 2):
        for c in (1, 2):
            assert got[r, c] == pytest.approx(3 * (3 * r + 1) + 4 * (3 * c + 1))
    slope = values(raster.terrain_slope(plane, "value", 10.0), "slope")
    assert len(slope) == 100 and all(v == pytest.approx(0.5) for v in slope.values())


def test_fill_downstream(spark):
    links = hierarchy.parent_links(spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (6, 0), (8, 9), (9, 8), (7, 8), (10, 11), (11, 12), (12, 11)], "id long, up long"), "id", "up")
    v = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 0.0), (4, math.nan), (5, 1.0), (6, None), (7, 4.0), (10, 5.0), (12, 3.0)], "node long, value double")
    got = {r["node"]: (r["value"], r["filled"]) for r in raster.fill_downstream(links, v).collect()}
    assert got == {1: (2.0, False), 2: (5.0, False), 3: (7.0, True), 4: (7.0, True), 5: (1.0, False), 6: (1.0, True), 7: (4.0, False), 8: (None, False), 9: (None, False), 10: (5.0, False), 11: (8.0, True), 12: (3.0, False)}


def test_adjacent_difference(spark):
    got = values(raster.adjacent_difference(grid(spark, [[1.0], [4.0], [9.0]]), "value"), "step")
    assert got == {(0, 0): 3.0, (1, 0): 5.0, (2, 0): None}


def test_mask(spark):
    g, r = spark.createDataFrame([(1, 1), (1, 2)], "row int, col int"), spark.createDataFrame([(1, 2), (1, 2)], "row int, col int")
    assert {tuple(x) for x in raster.mask(g, r, ["row", "col"]).collect()} == {(1, 1, 0), (1, 2, 1)}
