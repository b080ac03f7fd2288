"""Queries that bring stations, cells, rivers and basins together."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import grids
from tarnflow.operators import hierarchy, matching, network, places
from tarnflow.plans.network import LINK, UP, cell_links
from tarnflow.plans.scalar import station_areas
from tarnflow.session import materialise
from tarnflow.sources.tables import read_table
from tarnflow.sources.wkb import edge_rows

#: Reach of snapping in metres, narrow to wide, for stations and cells; longest network distance of a match in km.
STATION_TIERS, CELL_TIERS, MATCH_KM = (1000.0, 8000.0, 50_000.0), (1000.0, 5000.0), 15.0


def station_positions(spark: SparkSession, d: str) -> DataFrame:
    """wqms_id, lat, lon of the stations that have a position."""
    return materialise(places.positions(read_table(spark, d, "stations"), "wqms_id", "lat", "lon"))


def cell_positions(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, lat, lon of the cells."""
    return materialise(places.positions(read_table(spark, d, "cells"), "cell_id", "lat", "lon"))


def snap_stations(spark: SparkSession, d: str) -> DataFrame:
    """The nearest river segment of every station within 50 km."""
    return places.nearest_line(station_positions(spark, d), "wqms_id", materialise(edge_rows(read_table(spark, d, "rivers"), "hyriv_id")), STATION_TIERS).withColumnsRenamed({"who": "wqms_id", "line": "hyriv_id"})


def upstream_area(spark: SparkSession, d: str) -> DataFrame:
    """Upstream area of every cell that reaches an outlet, from the cells' own areas on the ellipsoid."""
    area = read_table(spark, d, "cells").groupBy(F.col("cell_id").alias("node")).agg(grids.cell_area_km2(F.max("lat")).alias("value"))
    return network.flow_accumulation(cell_links(spark, d), area).select(F.col("node").alias("cell_id"), F.round("total", 6).alias("km2"))


def station_cell_match(spark: SparkSession, d: str) -> DataFrame:
    """The cell of every station by network distance and agreeing upstream areas."""
    rivers = read_table(spark, d, "rivers")
    edges = materialise(edge_rows(rivers, "hyriv_id"))
    stations = places.nearest_line(station_positions(spark, d), "wqms_id", edges, STATION_TIERS).withColumnRenamed("who", "wqms_id")
    cells = places.nearest_line(cell_positions(spark, d), "cell_id", edges, CELL_TIERS).withColumnRenamed("who", "cell_id")
    links = materialise(hierarchy.parent_links(rivers, "hyriv_id", "next_down"))
    length = rivers.groupBy(F.col("hyriv_id").alias("node")).agg(F.max(F.nanvl("length_km", F.lit(None))).alias("km"))
    pairs = matching.network_pairs(stations, cells, links, length, MATCH_KM)
    where = read_table(spark, d, "cells").select("cell_id", "ilat", "ilon").distinct()
    area = where.join(upstream_area(spark, d), "cell_id").withColumnRenamed("km2", "cell_uparea_km2")
    own = station_areas(spark, d).groupBy("wqms_id").agg(F.max("area_km2").alias("station_area_km2"))
    return matching.match_stations(pairs, own, area)


def near_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells within 5 km of any station, as mine cells are kept within a buffer of mineral finds."""
    point = lambda df: df.select("lat", "lon").distinct().select(F.monotonically_increasing_id().alias("id"), *places.unit_vector("lat", "lon"))
    cells = cell_positions(spark, d)
    near = places.near_any(cells.select(F.col("cell_id").alias("id"), *places.unit_vector("lat", "lon")), materialise(point(station_positions(spark, d))), 5000.0)
    return near.select(F.col("id").alias("cell_id")).distinct()


def nearest_ore_cell(spark: SparkSession, d: str) -> DataFrame:
    """The nearest cell of every station, one with ore first, within 5 km, else the nearest however far."""
    ore = read_table(spark, d, "cells").groupBy("cell_id").agg(F.max(F.coalesce((F.col("ore") > 0) & ~F.isnan("ore"), F.lit(False))).alias("valid"))
    targets = materialise(cell_positions(spark, d).join(ore, "cell_id").withColumnRenamed("cell_id", "id"))
    return places.nearest_where(station_positions(spark, d), "wqms_id", targets, 5000.0).select(F.col("who").alias("wqms_id"), F.col("target").alias("cell_id"), F.round("km", 6).alias("km"), "tier")


def sampled_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cell whose raster row and column each station rounds to."""
    s = station_positions(spark, d).select("wqms_id", grids.row_of(F.col("lat")).alias("ilat"), grids.column_of(F.col("lon")).alias("ilon"))
    return s.join(read_table(spark, d, "cells").select("ilat", "ilon", "cell_id").distinct(), ["ilat", "ilon"]).select("wqms_id", "cell_id")


def rasterised_basins(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose centre lies in a basin: the basins burnt into the grid."""
    return places.inside_regions(cell_positions(spark, d), "cell_id", edge_rows(read_table(spark, d, "basins"), "hybas_id")).withColumnsRenamed({"who": "cell_id", "region": "hybas_id"})


QUERIES = {
    "snap_stations": snap_stations, "upstream_area": upstream_area, "station_cell_match": station_cell_match, "near_cells": near_cells, "nearest_ore_cell": nearest_ore_cell,
    "sampled_cells": sampled_cells, "rasterised_basins": rasterised_basins,
}

_AT = "s as (select distinct wqms_id, lat, (lon + 180) - 360 * floor((lon + 180) / 360) - 180 as lon from stations where lat is not null and lat::varchar <> 'nan' and lon is not null and lon::varchar <> 'nan')"

SQL = {
    "upstream_area": "with recursive " + LINK + UP + """, e as (select sqrt(1 - (6356752.3142 / 6378137) ** 2) as e), z as (
  select cell_id, e, e * sin(radians(lat + 1.0 / 240)) as a, e * sin(radians(lat - 1.0 / 240)) as b from (select cell_id, max(lat) as lat from cells group by 1), e
), area as (
  select cell_id, abs((atanh(a) / (2 * e) + a / e / (2 * (1 - a * a))) - (atanh(b) / (2 * e) + b / e / (2 * (1 - b * b)))) * pi() * 6356752.3142 ** 2 * 2 / 43200 / 1e6 as km2 from z
) select u.node as cell_id, round(sum(km2), 6) as km2 from up u join area a on a.cell_id = u.top group by 1""",
    "near_cells": f"with {_AT}, c as (select distinct cell_id, lat, lon from cells)" + """
select distinct cell_id from c, s where abs(c.lat - s.lat) < 0.1 and 2 * 6371008.8 * asin(sqrt(least(1, sin(radians(c.lat - s.lat) / 2) ** 2 + cos(radians(c.lat)) * cos(radians(s.lat)) * sin(radians(c.lon - s.lon) / 2) ** 2))) <= 5000
""",
    "nearest_ore_cell": f"with {_AT}, c as (select cell_id, max(lat) as lat, max(lon) as lon, bool_or(coalesce(ore > 0 and ore::varchar <> 'nan', false)) as valid from cells group by 1)" + """, p as (
  select s.wqms_id, c.cell_id, c.valid, sqrt(((c.lat - s.lat) * 111) ** 2 + ((((c.lon - s.lon + 180) - 360 * floor((c.lon - s.lon + 180) / 360)) - 180) * 111 * cos(radians(s.lat))) ** 2) as km from s, c
), t as (select *, case when km <= 5 and valid then 1 when km <= 5 then 2 else 3 end as tier from p)
select wqms_id, cell_id, round(km, 6) as km, tier::int as tier from t qualify row_number() over (partition by wqms_id order by tier, km, cell_id) = 1
""",
    "sampled_cells": f"with {_AT}" + """ select s.wqms_id, c.cell_id from s join (select distinct ilat, ilon, cell_id from cells) c
on c.ilat = round_even((90 - s.lat) / (1.0 / 120) - 0.5, 0) and c.ilon = round_even((s.lon + 180) / (1.0 / 120) - 0.5, 0)""",
}
