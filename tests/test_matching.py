from tarnflow.operators import hierarchy, matching


def test_network_distance_and_area_ratio(spark):
    # 1 -> 2 -> 3 -> end; 9 apart
    links = hierarchy.parent_links(spark.createDataFrame([(1, 2), (2, 3), (3, 0), (9, 0)], "id long, up long"), "id", "up")
    length = spark.createDataFrame([(1, 3.0), (2, 4.0), (3, 5.0), (9, None)], "node long, km double")
    snap = "who string, line long, along double, lat double, lon double"
    stations = spark.createDataFrame([("s", 1, 500.0, 0.0, 0.0), ("t", 3, 100.0, 0.0, 0.02), ("far", 9, 0.0, 40.0, 0.0)], snap).withColumnRenamed("who", "wqms_id")
    cells = spark.createDataFrame([(11, 1, 1700.0, 0.0, 0.01), (12, 2, 0.0, 0.0, 0.02), (13, 3, 900.0, 0.0, 0.03)], snap.replace("who string", "cell_id long"))
    pairs = {(r["wqms_id"], r["cell_id"]): round(r["km"], 3) for r in matching.network_pairs(stations, cells, links, length, 6.0).collect()}
    # s to 13 is 7 km along the rivers, too far though near as the crow flies; t has no way up, so straight distances
    assert pairs == {("s", 11): 1.2, ("s", 12): 3.0, ("t", 13): 0.8, ("t", 11): 1.112, ("t", 12): 0.0}
    areas = spark.createDataFrame([("s", 100.0), ("t", 50.0), ("u", None)], "wqms_id string, station_area_km2 double")
    cell_area = spark.createDataFrame([(11, 5, 1, 500.0), (12, 5, 2, 110.0), (13, 5, 3, 50.0)], "cell_id long, ilat int, ilon int, cell_uparea_km2 double")
    km = spark.createDataFrame([(a, b, v) for (a, b), v in pairs.items()], "wqms_id string, cell_id long, km double")
    got = {r["wqms_id"]: (r["cell_id"], r["dist_m"], round(r["area_ratio"], 3)) for r in matching.match_stations(km, areas, cell_area).collect()}
    assert got == {"s": (12, 3000.0, 0.909), "t": (13, 800.0, 1.0)}
