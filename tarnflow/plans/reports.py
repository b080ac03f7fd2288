"""Queries for reports: sorted and top rows, slices, masks and their sizes, merged and dense grids, prepared flow."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import chemistry
from tarnflow.operators import hierarchy, metrics, network, raster, series
from tarnflow.plans import scalar
from tarnflow.plans.network import LINK, UP, cell_links
from tarnflow.plans.network import SQL as NETWORK_SQL
from tarnflow.plans.network import network_mask
from tarnflow.plans.problems import _WALK, _links
from tarnflow.plans.scalar import _MOL, _f, _r, molar_results
from tarnflow.plans.series import _STATION_FIT, _WEEKS, _annual, station_metrics, weekly_pairs
from tarnflow.plans.series import SQL as SERIES_SQL
from tarnflow.session import materialise
from tarnflow.sources import files
from tarnflow.sources.tables import read_table

#: Box of the flow grid (south, north, west, east), whose polar caps hold no rivers; and the years of a slice.
BOX, YEARS = (-60.0, 75.0, -180.0, 180.0), (1900, 2100)
#: Fine cells in a cell of the overview grid.
OVERVIEW = 1200


def most_observed(spark: SparkSession, d: str) -> DataFrame:
    """The 25 stations with the most readings, most first, ties by id."""
    n = read_table(spark, d, "obs").filter("wqms_id is not null").groupBy("wqms_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "wqms_id").limit(25)


def countries_by_count(spark: SparkSession, d: str) -> DataFrame:
    """Customers per nation, most first."""
    return scalar.country_summary(spark, d).orderBy(F.desc("n"), "country")


def readings_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Distinct readings of every station and variable in order of station, variable and time."""
    o = read_table(spark, d, "obs").filter("ts is not null").select("wqms_id", "var", "ts", "obs_id").distinct()
    return o.orderBy("wqms_id", "var", "ts", "obs_id")


def final_slice(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the last time of the whole table with positive dissolved iron."""
    r = read_table(spark, d, "results").filter("ts is not null").distinct()
    last = r.agg(F.max("ts").alias("last"))  # one row
    iron = chemistry.dissolved_iron(_f("ferrous_iron"), _f("ferric_iron"))
    return r.join(F.broadcast(last), r["ts"] == last["last"]).select("result_id", "cell_id", F.round(iron, 6).alias("iron")).filter("iron > 0")


def metrics_with_places(spark: SparkSession, d: str) -> DataFrame:
    """Fit of each station and variable with the coordinates of its cell, which are NULL where it has none."""
    at = read_table(spark, d, "matches").groupBy("wqms_id").agg(F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon"))
    m = station_metrics(spark, d).select("wqms_id", "var", "n", "rmse", "kge", "fze")
    return m.join(at.select("wqms_id", F.round("cell_lat", 6).alias("cell_lat"), F.round("cell_lon", 6).alias("cell_lon")), "wqms_id", "left")


def station_markers(spark: SparkSession, d: str) -> DataFrame:
    """Stations of either table once, with the first position that is not empty: their own, else their cell's."""
    good = lambda c: F.nanvl(F.col(c), F.lit(None))
    own = read_table(spark, d, "stations").select("wqms_id", F.lit(0).alias("turn"), good("lat").alias("lat"), good("lon").alias("lon"))
    cell = read_table(spark, d, "matches").select("wqms_id", F.lit(1).alias("turn"), good("cell_lat").alias("lat"), good("cell_lon").alias("lon"))
    both = own.unionByName(cell).filter("wqms_id is not null")
    first = F.min(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("turn", "lat", "lon"))).alias("at")
    return both.groupBy("wqms_id").agg(first).select("wqms_id", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


def iron_subset(spark: SparkSession, d: str) -> DataFrame:
    """pH readings of the stations that have dissolved iron, too."""
    o = read_table(spark, d, "obs")
    iron = o.filter("var = 'Fe-Dis' and value is not null and not isnan(value)").select("wqms_id")
    return o.filter("var = 'pH'").join(iron, "wqms_id", "left_semi").select("obs_id").distinct()


def fze_variants(spark: SparkSession, d: str) -> DataFrame:
    """The FZE of each station and variable with R2 in the place of the correlation, as earlier reports had it."""
    return _r(metrics.legacy_fze(weekly_pairs(spark, d), ["wqms_id", "var"]), 5)


def iron_micrograms(spark: SparkSession, d: str) -> DataFrame:
    """Iron of a cubic metre of each model row back in microgram per litre; NULL without water."""
    m = molar_results(spark, d)
    back = lambda c, s: chemistry.micrograms(F.col(c) * 1000, F.lit(1000.0), s)
    return _r(m.select("result_id", back("fe2", "ferrous_iron").alias("ferrous"), back("fe3", "ferric_iron").alias("ferric")), 6)


def ore_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Reactive ore surface of the source cells by the oxidation depth, beside the table's own value."""
    c = read_table(spark, d, "cells").select("cell_id", "source", _f("ore").alias("ore")).distinct()
    return _r(c.select("cell_id", chemistry.ore_area(F.col("source"), 94.0).alias("estimate"), "ore"), 6)


def network_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the network at or below ore, and all cells."""
    mask = raster.mask(cell_links(spark, d).select("node"), network_mask(spark, d), ["node"])
    return mask.agg(F.count_if(F.col("mask") == 1).alias("masked"), F.count(F.lit(1)).alias("cells"))


def ore_mask(spark: SparkSession, d: str) -> DataFrame:
    """The grid's cells, 1 where they hold ore."""
    c = read_table(spark, d, "cells")
    return raster.mask(c.select("ilat", "ilon").distinct(), c.filter("ore > 0 and not isnan(ore)").select("ilat", "ilon"), ["ilat", "ilon"]).withColumn("mask", F.col("mask").cast("int"))


def _field(spark: SparkSession, d: str, name: str) -> DataFrame:
    c = read_table(spark, d, "cells").select(F.col("ilat").alias("row"), F.col("ilon").alias("col"), _f(name).alias(name))
    return c.dropna().groupBy("row", "col").agg(F.max(name).alias(name))


def merged_fields(spark: SparkSession, d: str) -> DataFrame:
    """Slope and ore as one raster, NULL where one has no cell."""
    return _r(raster.merge(_field(spark, d, "slope"), _field(spark, d, "ore")), 8)


def cell_centres(spark: SparkSession, d: str) -> DataFrame:
    """Centre of every grid cell from its row and column."""
    g = read_table(spark, d, "cells").select(F.col("ilat").alias("row"), F.col("ilon").alias("col")).distinct()
    return _r(files.with_centres(g), 8)


def overview(spark: SparkSession, d: str) -> DataFrame:
    """Cells in each square of ten degrees, every square between the outermost, NULL where there are none."""
    c = read_table(spark, d, "cells").select("cell_id", "ilat", "ilon").distinct()
    g = c.groupBy(F.floor(F.col("ilat") / OVERVIEW).cast("int").alias("row"), F.floor(F.col("ilon") / OVERVIEW).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return raster.dense(g, "n")


def results_slice(spark: SparkSession, d: str) -> DataFrame:
    """Model rows inside the box, over the years from the first to the last that observations cover."""
    years = read_table(spark, d, "obs").agg(F.year(F.min("ts")).alias("a"), F.year(F.max("ts")).alias("b"))  # one row
    c = raster.box(read_table(spark, d, "cells").select("cell_id", "lat", "lon").distinct(), *BOX)
    r = read_table(spark, d, "results").filter("ts is not null").join(F.broadcast(years)).filter(F.year("ts").between(F.col("a"), F.col("b")))
    return r.join(c, "cell_id", "left_semi").select("result_id").distinct()


def rivers_to_last_outlet(spark: SparkSession, d: str) -> DataFrame:
    """Segments from the first to the last, by id, of those that end in the table: a contiguous range between matches."""
    r = read_table(spark, d, "rivers")
    return raster.between_matches(r, "hyriv_id", F.coalesce(F.col("next_down") <= 0, F.lit(True))).select("hyriv_id").distinct()


def flow_preparation(spark: SparkSession, d: str) -> DataFrame:
    """Weekly flow of every cell from its yearly mean, least and greatest value, from slice to spline in one go."""
    a = _annual(spark, d).join(read_table(spark, d, "cells").select("cell_id", F.col("ilat").alias("row"), F.col("ilon").alias("col"), "lon").distinct(), "cell_id")
    fields = [a.select("row", "col", "lat", "lon", "year", q) for q in ("qav", "qmi", "qma")]
    weeks = series.prepare_flow(*fields, BOX, YEARS, a.select("row", "col", "year", (F.year(F.lit("1900-01-01")) + F.col("year")).alias("calendar")))
    return weeks.select("row", "col", "week", F.round("q", 6).alias("q"))


def flow_by_step(spark: SparkSession, d: str) -> DataFrame:
    """Sulphate of each model row's cell and of all cells upstream, step by step."""
    r = read_table(spark, d, "results").filter("ts is not null").select(F.col("cell_id").alias("node"), "ts", _f("sulphate").alias("value"))
    r = materialise(r.groupBy("node", "ts").agg(F.max("value").alias("value")))
    out = network.accumulate_steps(cell_links(spark, d), r, "ts")
    return out.select(F.col("node").alias("cell_id"), "ts", F.round("total", 4).alias("sulphate"))


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Interval labels of every river segment and cell that reaches an outlet: upstream of X is what starts inside X."""
    links = _links(spark, d)
    out = hierarchy.intervals(links, materialise(hierarchy.resolve(links, ["net"])), ["net"])
    return out.select("net", F.col("node").alias("node_id"), F.col("root").alias("root_id"), "first", "last")


QUERIES = {f.__name__: f for f in (
    most_observed, countries_by_count, readings_in_time, final_slice, metrics_with_places, station_markers, iron_subset, fze_variants, iron_micrograms, ore_estimate,
    network_totals, ore_mask, merged_fields, cell_centres, overview, results_slice, rivers_to_last_outlet, flow_preparation, flow_by_step, p2_intervals,
)}

_BOXED = f"lat between {BOX[0]} and {BOX[1]} and lon between {BOX[2]} and {BOX[3]}"


SQL = {
    "most_observed": "select wqms_id, count(*) as n from obs where wqms_id is not null group by 1 order by n desc, wqms_id limit 25",
    "countries_by_count": scalar.SQL["country_summary"] + " order by n desc, country",
    "readings_in_time": "select distinct wqms_id, var, ts, obs_id from obs where ts is not null order by wqms_id, var, ts, obs_id",
    "final_slice": """
select result_id, cell_id, round(ferrous_iron::double + ferric_iron::double, 6) as iron from (select distinct * from results)
where ts = (select max(ts) from results) and iron > 0 and not isnan(iron)
""",
    "metrics_with_places": "with s as (" + _STATION_FIT + """), p as (select wqms_id, round(min(cell_lat), 6) as cell_lat, round(min(cell_lon), 6) as cell_lon from matches group by 1)
select s.wqms_id, s.var, s.n, s.rmse, s.kge, s.fze, p.cell_lat, p.cell_lon from s left join p using (wqms_id)""",
    "station_markers": """
with b as (
  select wqms_id, 0 as turn, lat, lon from stations union all select wqms_id, 1, cell_lat, cell_lon from matches
), g as (select wqms_id, min({'turn': turn, 'lat': lat, 'lon': lon}) as at from b where lat is not null and lat::varchar <> 'nan' and lon is not null and lon::varchar <> 'nan' group by 1)
select b.wqms_id, round(g.at.lat, 6) as lat, round(g.at.lon, 6) as lon from (select distinct wqms_id from b where wqms_id is not null) b left join g using (wqms_id)
""",
    "iron_subset": "select distinct obs_id from obs where var = 'pH' and wqms_id in (select wqms_id from obs where var = 'Fe-Dis' and value is not null and not isnan(value))",
    "fze_variants": _WEEKS + """, f as (
  select wqms_id, var, count(*) as n, min(observed) < max(observed) and min(modelled) < max(modelled) as scatter, 1 - sum((modelled - observed) ** 2) / nullif(var_pop(observed) * count(*), 0) as r2,
    (quantile_cont(modelled, 0.75) - quantile_cont(modelled, 0.25)) / nullif(quantile_cont(observed, 0.75) - quantile_cont(observed, 0.25), 0) as g, avg(modelled) / nullif(avg(observed), 0) as b from weeks group by 1, 2
) select wqms_id, var, case when scatter then round(1 - sqrt((r2 - 1) ** 2 + (g - 1) ** 2 + (b - 1) ** 2), 5) end as fze_legacy from f""",
    "iron_micrograms": "with " + _MOL + " select result_id, round(fe2 * 1000 / 1000 * 55845 * 1000, 6) as ferrous, round(fe3 * 1000 / 1000 * 55845 * 1000, 6) as ferric from c",
    "ore_estimate": "select distinct cell_id, case when source then 94.0::double end as estimate, round(case when ore::varchar <> 'nan' then ore::double end, 6) as ore from cells",
    "network_totals": "select (select count(*) from (" + NETWORK_SQL["network_mask"] + ")) as masked, (select count(distinct cell_id) from cells) as cells",
    "ore_mask": "select ilat, ilon, max(case when ore > 0 and ore::varchar <> 'nan' then 1 else 0 end)::int as mask from cells group by 1, 2",
    "merged_fields": """
with s as (select ilat, ilon, round(max(slope::double), 8) as slope from cells where slope::varchar <> 'nan' group by 1, 2), o as (select ilat, ilon, round(max(ore::double), 8) as ore from cells where ore::varchar <> 'nan' group by 1, 2)
select coalesce(s.ilat, o.ilat) as row, coalesce(s.ilon, o.ilon) as col, slope, ore from s full join o on s.ilat = o.ilat and s.ilon = o.ilon
""",
    "cell_centres": "select distinct ilat as row, ilon as col, round(90.0::double - (ilat + 0.5) * (1.0::double / 120), 8) as lat, round(-180.0::double + (ilon + 0.5) * (1.0::double / 120), 8) as lon from cells",
    "overview": f"""
with g as (select ilat // {OVERVIEW} as row, ilon // {OVERVIEW} as col, count(distinct cell_id) as n from cells group by 1, 2), e as (select min(row) as a, max(row) as b, min(col) as c, max(col) as d from g),
a as (select unnest(generate_series(e.a, e.b)) as row, c, d from e), b as (select row, unnest(generate_series(c, d)) as col from a)
select b.row::int as row, b.col::int as col, g.n from b left join g using (row, col)
""",
    "results_slice": f"""
select distinct result_id from results semi join (select cell_id from cells where {_BOXED}) using (cell_id)
where year(ts) between (select year(min(ts)) from obs) and (select year(max(ts)) from obs)
""",
    "rivers_to_last_outlet": "select distinct hyriv_id from rivers, (select min(hyriv_id) as a, max(hyriv_id) as b from rivers where coalesce(next_down <= 0, true)) where hyriv_id between a and b",
    "flow_preparation": "select c.ilat as row, c.ilon as col, s.week, s.q from (" + SERIES_SQL["seasonal_spline"] + f") s join (select distinct cell_id, ilat, ilon from cells where {_BOXED}) c using (cell_id)",
    "flow_by_step": "with recursive " + LINK + UP + """, v as (
  select cell_id, ts, max(case when not isnan(sulphate) then sulphate::double end) as v from results where ts is not null group by 1, 2
) select a.cell_id, a.ts, round(sum(coalesce(b.v, 0.0)), 4) as sulphate from v a join up u on u.node = a.cell_id join v b on b.cell_id = u.top and b.ts = a.ts group by 1, 2""",
    "p2_intervals": _WALK + """, pairs as (
  select net, node, node as pos from tree union all select p.net, p.node, l.parent from pairs p join link l on l.net = p.net and l.node = p.pos where l.parent is not null
), sized as (select net, pos as node, count(*) as n from pairs group by 1, 2), child as (
  select l.net, l.node, l.parent, s.n, 1 + coalesce(sum(s.n) over (partition by l.net, l.parent order by l.node rows between unbounded preceding and 1 preceding), 0) as step
  from link l join sized s using (net, node) where l.parent is not null
), label as (
  select t.net, t.node, t.root, 0::hugeint as first from tree t where t.depth = 0
  union all
  select c.net, c.node, a.root, a.first + c.step from child c join label a on a.net = c.net and a.node = c.parent
) select l.net, l.node as node_id, l.root as root_id, l.first::bigint as first, (l.first + s.n - 1)::bigint as last from label l join sized s using (net, node)
""",
}
