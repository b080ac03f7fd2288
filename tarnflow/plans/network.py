"""Queries on the drainage network of cells and rivers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import grids
from tarnflow.operators import hierarchy, network
from tarnflow.session import materialise
from tarnflow.sources.tables import read_table


def cell_links(spark: SparkSession, d: str) -> DataFrame:
    """node, parent of the cells; a link out of the table is none."""
    return materialise(hierarchy.parent_links(read_table(spark, d, "cells"), "cell_id", "out_id"))


LINK = """
raw as (select cell_id as node, min(case when out_id > 0 then out_id end) as parent from cells group by 1), link as (
  select a.node, b.node as parent from raw a left join raw b on b.node = a.parent
), indeg as (select l.node, l.parent, coalesce(i.n, 0) as indegree from link l left join (select parent as node, count(*) as n from link where parent is not null group by 1) i using (node)
), tree as (
  select node, node as root, 0 as depth from link where parent is null union all
  select l.node, t.root, t.depth + 1 from link l join tree t on l.parent = t.node
)"""


def d8_edges(spark: SparkSession, d: str) -> DataFrame:
    """The D8 code of every cell's outflow, and the cell it decodes to on the global grid."""
    c = read_table(spark, d, "cells").select("cell_id", "ilat", "ilon", "out_id").distinct()
    down, right = F.floor(F.col("out_id") / grids.COLUMNS) - F.col("ilat"), F.pmod("out_id", F.lit(grids.COLUMNS)) - F.col("ilon")
    code = grids.d8_code(F.when(F.col("out_id") > 0, down), F.when(F.col("out_id") > 0, right))
    c = c.select("cell_id", "ilat", "ilon", code.alias("code"))
    target = grids.d8_target(F.col("ilat"), F.col("ilon"), F.col("code"), grids.COLUMNS // 2, grids.COLUMNS)
    return c.select("cell_id", "code", F.coalesce(target, F.lit(-1).cast("bigint")).alias("target"))


def node_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Indegree, headwater, confluence and sink flags of every cell."""
    k = network.node_kinds(cell_links(spark, d))
    return k.select("node", F.col("indegree").cast("bigint").alias("indegree"), "headwater", "confluence", "sink")


def source_flags(spark: SparkSession, d: str) -> DataFrame:
    """Cells that are nobody's target; one that drains into itself is its own target."""
    links = cell_links(spark, d)
    return links.select("node").join(links.select(F.col("parent").alias("node")), "node", "left_anti")


def basin_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Cells and greatest depth of every outlet's basin."""
    r = hierarchy.resolve(cell_links(spark, d)).filter("depth >= 0")
    return r.groupBy(F.col("root").alias("outlet")).agg(F.count(F.lit(1)).alias("cells"), F.max("depth").alias("deepest"))


def flow_accumulation(spark: SparkSession, d: str) -> DataFrame:
    """Ore upstream of every cell that reaches an outlet."""
    ore = read_table(spark, d, "cells").select(F.col("cell_id").alias("node"), F.col("ore").cast("double").alias("value")).distinct()
    return network.flow_accumulation(cell_links(spark, d), ore).select("node", F.round("total", 4).alias("ore_upstream"))


def network_mask(spark: SparkSession, d: str) -> DataFrame:
    """Cells at or below a cell with ore."""
    seeds = read_table(spark, d, "cells").filter("ore > 0 and not isnan(ore)").select(F.col("cell_id").alias("node"))
    return network.downstream_closure(cell_links(spark, d), seeds)


def reaches(spark: SparkSession, d: str) -> DataFrame:
    """Reach and position of every cell."""
    return network.reaches(cell_links(spark, d)).select("node", "reach_id", F.col("position").cast("int").alias("position"))


def reach_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Reaches by their number of cells."""
    return network.reaches(cell_links(spark, d)).groupBy("reach_id").count().groupBy(F.col("count").alias("cells")).agg(F.count(F.lit(1)).alias("reaches"))


def junction_inflow(spark: SparkSession, d: str) -> DataFrame:
    """Inflow of every junction cell, with the number of upstream cells as flow."""
    links = cell_links(spark, d)
    reach = materialise(network.reaches(links))
    one = links.select("node", F.lit(1.0).alias("value"))
    flow = network.flow_accumulation(links, one).select("node", F.col("total").alias("q"))
    return network.junction_inflow(network.junctions(links, reach), flow).select(F.col("destination").alias("node"), "inflow")


def river_distance(spark: SparkSession, d: str) -> DataFrame:
    """Kilometres of river from each segment's start to its outlet's end, missing lengths counting 0."""
    rivers = read_table(spark, d, "rivers")
    links = hierarchy.parent_links(rivers, "hyriv_id", "next_down")
    length = rivers.groupBy(F.col("hyriv_id").alias("node")).agg(F.max(F.nanvl("length_km", F.lit(None))).alias("km"))
    return hierarchy.sum_to_root(links.join(length, "node", "left").withColumn("value", F.coalesce("km", F.lit(0.0)))).select("node", F.round("total", 5).alias("km"))


QUERIES = {
    "d8_edges": d8_edges, "node_kinds": node_kinds, "source_flags": source_flags, "basin_sizes": basin_sizes, "flow_accumulation": flow_accumulation, "network_mask": network_mask,
    "reaches": reaches, "reach_lengths": reach_lengths, "junction_inflow": junction_inflow, "river_distance": river_distance,
}

_REACH = LINK + """, reach as (
  select node, node as reach_id, 0 as pos from indeg where indegree <> 1 union all
  select i.node, r.reach_id, r.pos + 1 from reach r join link l on l.node = r.node join indeg i on i.node = l.parent where i.indegree = 1
)"""
UP = """, up as (
  select node, node as top from tree union all
  select l.parent, u.top from up u join link l on l.node = u.node where l.parent is not null
)"""

SQL = {
    "d8_edges": """
with c as (select distinct cell_id, ilat, ilon, out_id from cells), s as (
  select cell_id, out_id, case when out_id > 0 then out_id // 43200 - ilat end as r, case when out_id > 0 then out_id % 43200 - ilon end as k from c
), t as (
  select cell_id, out_id, case when r = 0 and k = 1 then 1 when r = 1 and k = 1 then 2 when r = 1 and k = 0 then 4 when r = 1 and k = -1 then 8 when r = 0 and k = -1 then 16
    when r = -1 and k = -1 then 32 when r = -1 and k = 0 then 64 when r = -1 and k = 1 then 128 when r = 0 and k = 0 then 0 else 255 end as code from s
) select cell_id, code, case when code <> 255 then out_id else -1 end as target from t
""",
    "node_kinds": "with recursive " + LINK + " select node, indegree, indegree = 0 as headwater, indegree > 1 as confluence, parent is null as sink from indeg",
    "source_flags": "with recursive " + LINK + " select node from indeg where indegree = 0",
    "basin_sizes": "with recursive " + LINK + " select root as outlet, count(*) as cells, max(depth) as deepest from tree group by 1",
    "flow_accumulation": "with recursive " + LINK + UP + """ select u.node, round(sum(coalesce(case when o.ore::varchar <> 'nan' then o.ore::double end, 0.0)), 4) as ore_upstream
from up u join (select distinct cell_id, ore from cells) o on o.cell_id = u.top group by 1""",
    "network_mask": "with recursive " + LINK + """, mask as (
  select cell_id as node from cells where ore > 0 and ore::varchar <> 'nan' union select l.parent from mask m join link l on l.node = m.node where l.parent is not null
) select node from mask""",
    "reaches": "with recursive " + _REACH + " select node, reach_id, pos as position from reach",
    "reach_lengths": "with recursive " + _REACH + " select cells, count(*) as reaches from (select reach_id, count(*) as cells from reach group by 1) group by 1",
    "junction_inflow": "with recursive " + _REACH + UP + """, flow as (select node, count(*)::double as q from up group by 1), tail as (
  select arg_max(node, pos) as node from reach group by reach_id
) select l.parent as node, sum(f.q) as inflow from tail t join link l using (node) join flow f on f.node = t.node where l.parent is not null group by 1""",
    "river_distance": """
with recursive raw as (select hyriv_id as node, min(case when next_down > 0 then next_down end) as parent, coalesce(max(case when length_km::varchar <> 'nan' then length_km end), 0.0) as km from rivers group by 1), link as (
  select a.node, b.node as parent, a.km from raw a left join raw b on b.node = a.parent
), tree as (select node, km from link where parent is null union all select l.node, l.km + t.km from link l join tree t on l.parent = t.node)
select node, round(km, 5) as km from tree
""",
}
