"""Queries of the numbered problems that belong to the core."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import hierarchy, places
from tarnflow.operators.nearest import DAY, nearest_in_time
from tarnflow.operators.smooth import held_out, weekly_series
from tarnflow.operators.spikes import implausible
from tarnflow.session import materialise, small_side
from tarnflow.sources.tables import micros, present, read_table
from tarnflow.sources.wkb import edge_rows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """obs_id of every pH or Fe-Dis reading that its station cannot have measured."""
    return implausible(read_table(spark, d, "obs")).select("obs_id").distinct()


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Downstream links of rivers and cells in one table, by `net`."""
    rivers = read_table(spark, d, "rivers").select(F.lit("rivers").alias("net"), F.col("hyriv_id").alias("id"), F.col("next_down").alias("down"))
    cells = read_table(spark, d, "cells").select(F.lit("cells").alias("net"), F.col("cell_id").alias("id"), F.col("out_id").alias("down"))
    return materialise(hierarchy.parent_links(rivers.unionByName(cells), "id", "down", ["net"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Outlet and depth of every river segment and cell; loops have depth -1 and their smallest id."""
    out = hierarchy.resolve(_links(spark, d), ["net"])
    return out.select("net", F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every node down to its outlet."""
    links = _links(spark, d)
    return hierarchy.paths(links, materialise(hierarchy.resolve(links, ["net"])), ["net"])


def p2_upstream(spark: SparkSession, d: str) -> DataFrame:
    """All upstream nodes of every node, one row per pair."""
    links = _links(spark, d)
    pairs = hierarchy.ancestors(links, materialise(hierarchy.resolve(links, ["net"])), ["net"])
    return pairs.select("net", F.col("ancestor").alias("node_id"), F.col("node").alias("upstream_id"), "hops")


def p2_upstream_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes lie upstream of every node; -1 where the path enters a loop."""
    links = _links(spark, d)
    out = hierarchy.descendant_counts(links, materialise(hierarchy.resolve(links, ["net"])), ["net"])
    return out.select("net", F.col("node").alias("node_id"), F.coalesce("descendants", F.lit(-1)).alias("n_upstream"))


def station_cells(spark: SparkSession, d: str) -> DataFrame:
    """wqms_id, cell_id of every matched station, each pair once."""
    cells = read_table(spark, d, "cells").select("ilat", "ilon", "cell_id").distinct()
    return read_table(spark, d, "matches").select("wqms_id", "ilat", "ilon").distinct().join(cells, ["ilat", "ilon"]).select("wqms_id", "cell_id")


def _p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    matched = small_side(materialise(station_cells(spark, d)))
    obs = read_table(spark, d, "obs").filter(F.col("var").isin("pH", "Fe-Dis") & F.col("ts").isNotNull() & present("value"))
    readings = obs.join(matched, "wqms_id").select("cell_id", "var", micros("ts").alias("t"), F.col("obs_id").alias("id"))
    model = read_table(spark, d, "results").filter(F.col("ts").isNotNull())
    t = micros("ts").alias("t")
    steps = [
        model.filter(present(c)).select("cell_id", F.lit(v).alias("var"), t, F.col("result_id").alias("id")) for c, v in (("ph", "pH"), ("ferric_iron", "Fe-Dis"))
    ]
    return nearest_in_time(readings, steps[0].unionByName(steps[1]), ["cell_id", "var"], 14 * DAY)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The nearest model row of each reading at a matched station within 14 days."""
    return _p3_pairs(spark, d).select(F.col("left_id").alias("obs_id"), F.col("right_id").alias("result_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Weeks without a reading between a series' first and last."""
    weeks = weekly_series(read_table(spark, d, "obs")).filter("missing")
    return weeks.select("wqms_id", "var", F.date_format("week_end", "yyyy-MM-dd").alias("week_end"))


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    """The weekly series with filled values, their band and missing flags."""
    return weekly_series(read_table(spark, d, "obs"))


def p4_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Per variable: readings kept from the smoother, its mean error on them (iron: of logarithms), and the part inside the 95 % band."""
    h = held_out(read_table(spark, d, "obs"))
    return h.groupBy("var").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("error"), 4).alias("mean_error"), F.round(F.avg(F.col("inside").cast("int")), 4).alias("coverage"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Stations within 500 m of each other, within 1 km of a river line, and inside a basin."""
    at = materialise(places.positions(read_table(spark, d, "stations"), "wqms_id", "lat", "lon"))
    pairs = places.neighbours(at, "wqms_id", 500.0).select(F.lit("station").alias("rel"), "id_a", "id_b")
    rivers = places.near_lines(at, "wqms_id", materialise(edge_rows(read_table(spark, d, "rivers"), "hyriv_id")), 1000.0).select("who", F.lit("river").alias("rel"), F.col("line").alias("other"))
    basins = places.inside_regions(at, "wqms_id", edge_rows(read_table(spark, d, "basins"), "hybas_id")).select("who", F.lit("basin").alias("rel"), F.col("region").alias("other"))
    other = F.col("other").cast("string")
    mixed = rivers.unionByName(basins).select("rel", F.least("who", other).alias("id_a"), F.greatest("who", other).alias("id_b"))
    return pairs.unionByName(mixed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_found": p2_found, "p2_paths": p2_paths, "p2_upstream": p2_upstream, "p2_upstream_counts": p2_upstream_counts, "p3_found": p3_found, "p4_found": p4_found, "p4_series": p4_series, "p4_held_out": p4_held_out, "p5_found": p5_found}
#: Links as `hierarchy.parent_links` makes them, and their walk; a walk stops where it meets its own start.
_WALK = """
with recursive raw as (
  select 'rivers' as net, hyriv_id as node, min(case when next_down > 0 then next_down end) as parent from rivers where hyriv_id is not null group by 2
  union all
  select 'cells', cell_id, min(case when out_id > 0 then out_id end) from cells where cell_id is not null group by 2
), link as (
  select a.net, a.node, b.node as parent from raw a left join raw b on b.net = a.net and b.node = a.parent
), tree as (
  select net, node, node as root, 0 as depth from link where parent is null
  union all
  select l.net, l.node, t.root, t.depth + 1 from link l join tree t on l.net = t.net and l.parent = t.node
), lost as (
  select net, node, parent from link l anti join tree t using (net, node)
), orbit as (
  select net, node, parent as pos from lost
  union
  select o.net, o.node, l.parent from orbit o join lost l on l.net = o.net and l.node = o.pos
), loops as (
  select net, node from orbit where node = pos
), answer as (
  select net, node, root, depth from tree
  union all
  select o.net, o.node, min(o.pos), -1 from orbit o join loops p on p.net = o.net and p.node = o.pos group by 1, 2
)"""

SQL: dict[str, str] = {
    "p2_found": _WALK + " select net, node as node_id, root as root_id, depth from answer",
    "p2_upstream_counts": _WALK + """, up as (
  select l.net, l.node, l.parent as pos from link l join tree t using (net, node) where l.parent is not null
  union all
  select u.net, u.node, l.parent from up u join link l on l.net = u.net and l.node = u.pos where l.parent is not null
)
select a.net, a.node as node_id, case when a.depth >= 0 then coalesce(c.n, 0) else -1 end as n_upstream
from answer a left join (select net, pos, count(*) as n from up group by 1, 2) c on c.net = a.net and c.pos = a.node
""",
    "p2_upstream": _WALK + """, up as (
  select l.net, l.parent as node_id, l.node as upstream_id, 1 as hops from link l join tree t using (net, node) where l.parent is not null
  union all
  select u.net, l.parent, u.upstream_id, u.hops + 1 from up u join link l on l.net = u.net and l.node = u.node_id where l.parent is not null
)
select net, node_id, upstream_id, hops from up
""",
    "p3_found": """
with cell as (
  select distinct m.wqms_id, c.cell_id from matches m join cells c on c.ilat = m.ilat and c.ilon = m.ilon
), reading as (
  select distinct o.obs_id, c.cell_id, o.var, o.ts from obs o join cell c using (wqms_id)
  where o.var in ('pH', 'Fe-Dis') and o.ts is not null and o.value is not null and not isnan(o.value)
), step as (
  select cell_id, 'pH' as var, ts, min(result_id) as result_id from results where ph is not null and not isnan(ph) and ts is not null group by all
  union all
  select cell_id, 'Fe-Dis', ts, min(result_id) from results where ferric_iron is not null and not isnan(ferric_iron) and ts is not null group by all
), either as (
  select r.obs_id, r.ts, s.ts as step_ts, s.result_id from reading r asof join step s on s.cell_id = r.cell_id and s.var = r.var and r.ts >= s.ts
  union all
  select r.obs_id, r.ts, s.ts, s.result_id from reading r asof join step s on s.cell_id = r.cell_id and s.var = r.var and r.ts <= s.ts
)
select obs_id, arg_min(result_id, (abs(epoch_us(step_ts) - epoch_us(ts)), step_ts)) as result_id from either
where abs(epoch_us(step_ts) - epoch_us(ts)) <= 14 * 86400000000 group by obs_id
""",
    "p4_found": """
with readings as (
  select distinct wqms_id, var, date_trunc('week', ts)::date as week from obs
  where ts is not null and value is not null and not isnan(value) and wqms_id is not null and var in ('pH', 'Fe-Dis', 'Fe-Tot')
), gaps as (
  select wqms_id, var, week, lead(week) over (partition by wqms_id, var order by week) as next from readings
)
select wqms_id, var, strftime(unnest(generate_series(week + interval 7 day, next - interval 7 day, interval 7 day)) + interval 6 day, '%Y-%m-%d') as week_end
from gaps where next > week + interval 7 day
""",
}
