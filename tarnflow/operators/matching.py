"""Stations matched to model cells along the river network."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import hierarchy
from tarnflow.operators.places import unit_vector, within_distance
from tarnflow.session import materialise


def network_pairs(stations: DataFrame, cells: DataFrame, links: DataFrame, length: DataFrame, max_km: float, **kd) -> DataFrame:
    """Pairs of a station and a cell at most `max_km` apart along the rivers: wqms_id, cell_id, km.

    `stations` (wqms_id) and `cells` (cell_id) come snapped: line, along, lat, lon. `links` are the rivers' parent links,
    `length` has node, km. On one segment the distance is that of the two positions; from a segment to one downstream
    it is the sum of the segments' lengths from the first up to the second; where no path leads down, it is the
    straight distance of the snapped points. Segments that run into a loop count by their straight distance.
    """
    weighted = materialise(links.join(length, "node", "left").withColumn("value", F.coalesce("km", F.lit(0.0))))
    label = materialise(hierarchy.intervals(links, materialise(hierarchy.resolve(links))))
    held = stations.select(F.col("line").alias("node")).distinct()
    tree = label.select("node")
    below = hierarchy.ancestors_within(weighted.join(tree, "node", "left_semi"), held, max_km)
    below = materialise(below.select(F.col("node").alias("line"), F.col("ancestor").alias("cell_line"), F.col("total").alias("km")))
    s = stations.select("wqms_id", "line", F.col("along").alias("_sa"))
    c = cells.select("cell_id", F.col("line").alias("cell_line"), F.col("along").alias("_ca"))
    same = s.join(c, F.col("line") == F.col("cell_line")).select("wqms_id", "cell_id", (F.abs(F.col("_sa") - F.col("_ca")) / 1000).alias("km"))
    down = s.join(below, "line").join(c, "cell_line").select("wqms_id", "cell_id", "km")
    point = lambda df, i: df.select(F.col(i).alias("id"), *unit_vector("lat", "lon"))
    numbered = materialise(stations.withColumn("sid", F.monotonically_increasing_id()))
    near = within_distance(point(numbered, "sid"), point(cells, "cell_id"), max_km * 1000, **kd)
    near = near.select(F.col("q_id").alias("sid"), F.col("t_id").alias("cell_id"), (F.col("metres") / 1000).alias("km")).join(numbered.select("sid", "wqms_id", "line"), "sid").join(c, "cell_id")
    # a path leads down if the station's segment lies above the cell's, however far
    la = label.select(F.col("node").alias("line"), F.col("root").alias("_r"), F.col("first").alias("_f"))
    lb = label.select(F.col("node").alias("cell_line"), F.col("root").alias("_s"), F.col("first").alias("_a"), F.col("last").alias("_b"))
    leads = F.coalesce((F.col("_r") == F.col("_s")) & F.col("_f").between(F.col("_a"), F.col("_b")), F.lit(False))
    straight = near.filter("line <> cell_line").join(la, "line", "left").join(lb, "cell_line", "left").filter(~leads).select("wqms_id", "cell_id", "km")
    return same.unionByName(down).unionByName(straight).filter(F.col("km") <= max_km)


def match_stations(pairs: DataFrame, station_area: DataFrame, cell_area: DataFrame, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """The nearest cell of every station whose upstream areas agree: wqms_id, cell_id, dist_m, areas and their ratio.

    `station_area`: wqms_id, station_area_km2; `cell_area`: cell_id, ilat, ilon, cell_uparea_km2. The ratio (station by
    cell) lies in low..high; ties go to the first cell by row and column. Missing areas match nothing.
    """
    ratio = F.col("station_area_km2") / F.nullif(F.col("cell_uparea_km2"), F.lit(0.0))
    both = pairs.join(station_area, "wqms_id").join(cell_area, "cell_id").withColumn("area_ratio", ratio).filter(F.col("area_ratio").between(low, high))
    best = both.groupBy("wqms_id").agg(F.min(F.struct("km", "ilat", "ilon", "cell_id", "station_area_km2", "cell_uparea_km2", "area_ratio")).alias("b"))
    return best.select("wqms_id", "b.cell_id", (F.col("b.km") * 1000).alias("dist_m"), "b.ilat", "b.ilon", "b.station_area_km2", "b.cell_uparea_km2", "b.area_ratio")
