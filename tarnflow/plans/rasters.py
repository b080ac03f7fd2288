"""Queries on the cells as a raster of slope and ore."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import raster
from tarnflow.plans.network import cell_links
from tarnflow.sources.tables import read_table

#: Width of a cell in metres, and how many cells a coarse one is wide.
CELL_M, COARSE = 1000.0, 10


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "cells").groupBy(F.col("ilat").alias("row"), F.col("ilon").alias("col")).agg(F.max(F.nanvl(F.col("slope").cast("double"), F.lit(None))).alias("value"))


def surface_slope(spark: SparkSession, d: str) -> DataFrame:
    """Horn's slope of the slope field where all nine cells are there, in parts per million."""
    return raster.terrain_slope(_grid(spark, d), "value", CELL_M).select("row", "col", F.round(F.col("slope") * 1e6, 5).alias("slope"))


def coarse_field(spark: SparkSession, d: str) -> DataFrame:
    """The slope field on cells ten times as wide."""
    return raster.coarsen(_grid(spark, d), "value", COARSE).select("row", "col", F.round("value", 8).alias("value"))


def occupied_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cells of grid lines and columns that hold ore."""
    g = read_table(spark, d, "cells").groupBy(F.col("ilat").alias("row"), F.col("ilon").alias("col")).agg(F.max(F.nanvl(F.col("ore").cast("double"), F.lit(None))).alias("ore"))
    return raster.drop_empty_lines(g, "ore").select("row", "col", F.round("ore", 6).alias("ore"))


def filled_slope(spark: SparkSession, d: str) -> DataFrame:
    """Slopes with gaps and zeros filled from upstream."""
    v = read_table(spark, d, "cells").groupBy(F.col("cell_id").alias("node")).agg(F.max(F.nanvl(F.col("slope").cast("double"), F.lit(None))).alias("value"))
    return raster.fill_downstream(cell_links(spark, d), v).select("node", F.round("value", 8).alias("value"), "filled")


def latitude_steps(spark: SparkSession, d: str) -> DataFrame:
    """Difference of the slope field to the next row south in each column."""
    return raster.adjacent_difference(_grid(spark, d), "value").select("row", "col", F.round("step", 8).alias("step"))


QUERIES = {"surface_slope": surface_slope, "coarse_field": coarse_field, "occupied_lines": occupied_lines, "filled_slope": filled_slope, "latitude_steps": latitude_steps}

_GRID = "g as (select ilat as row, ilon as col, max(case when slope::varchar <> 'nan' then slope::double end) as v from cells group by 1, 2)"

SQL = {
    "surface_slope": f"with {_GRID}, w as (select * from (values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dk)), n as (" + """
  select g.row - dr as row, g.col - dk as col, g.v, dr, dk from g, w where g.v is not null
) select row, col, round(sqrt(sum(v * dk * case when dr = 0 then 2 else 1 end) ** 2 + sum(v * dr * case when dk = 0 then 2 else 1 end) ** 2) / 8000 * 1e6, 5) as slope from n group by 1, 2 having count(*) = 9
""",
    "coarse_field": f"with {_GRID}, " + """f as (select v, (row + 0.5) / 10 - 0.5 as y, (col + 0.5) / 10 - 0.5 as x from g where v is not null), s as (
  select v, floor(y) + a.i as row, floor(x) + b.j as col, (1 - abs(y - floor(y) - a.i)) * (1 - abs(x - floor(x) - b.j)) as w from f, (values (0), (1)) a(i), (values (0), (1)) b(j)
), e as (select min(row) // 10 as r0, max(row) // 10 as r1, min(col) // 10 as c0, max(col) // 10 as c1 from g)
select row::int as row, col::int as col, round(sum(w * v) / sum(w), 8) as value from s, e where row between r0 and r1 and col between c0 and c1 group by 1, 2 having sum(w) > 0
""",
    "occupied_lines": """
with g as (select ilat as row, ilon as col, max(case when ore::varchar <> 'nan' then ore::double end) as ore from cells group by 1, 2), a as (
  select g.* from g semi join (select row from g where ore is not null) using (row)
) select row, col, round(ore, 6) as ore from a semi join (select col from a where ore is not null) using (col)
""",
    "filled_slope": """
with recursive raw as (
  select cell_id as node, min(case when out_id > 0 then out_id end) as parent, max(case when slope::varchar <> 'nan' then slope::double end) as v from cells group by 1
), own as (select node, parent, case when v <> 0 then v end as own from raw
), link as (
  select a.node, a.own, b.node as parent from own a left join own b on b.node = a.parent and b.own is null
), tree as (
  select node from link where parent is null union all select l.node from link l join tree t on l.parent = t.node
), up as (
  select l.node, l.own from link l join tree t using (node) where own is not null
  union all
  select l.parent, u.own from up u join link l on l.node = u.node where l.parent is not null
), total as (select node, sum(own) as s from up group by 1)
select o.node, round(coalesce(o.own, nullif(t.s, 0)), 8) as value, o.own is null and coalesce(t.s, 0) <> 0 as filled from own o left join total t using (node)
""",
    "latitude_steps": f"with {_GRID} select row, col, round(lead(v) over (partition by col order by row) - v, 8) as step from g",
}
