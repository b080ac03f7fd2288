"""Queries on projections, filters and scalar functions of rivers, cells, stations and model results."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import chemistry, grids, hydraulics
from tarnflow.operators.lanes import quantiles
from tarnflow.session import materialise
from tarnflow.sources.tables import read_table

#: Specific runoff that gives a discharge from an upstream area, m3/s per km2.
RUNOFF = 0.01
WEEK_S = float(hydraulics.seconds_of("week"))


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _f(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def normalised_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells as the model takes them: missing ore 0, slope at least 0, one way of writing no outflow."""
    c = read_table(spark, d, "cells").distinct()
    return c.select(
        "cell_id", F.when(F.col("out_id") > 0, F.col("out_id")).otherwise(-1).alias("out_id"), F.coalesce("source", F.lit(False)).cast("int").alias("source"),
        F.when(_f("slope") > 0, _f("slope")).otherwise(0.0).alias("slope"), F.coalesce(_f("ore"), F.lit(0.0)).alias("ore"),
    )


_CELLS = """
select cell_id, case when out_id > 0 then out_id else -1 end as out_id, coalesce(source, false)::int as source,
  case when slope > 0 and slope::varchar <> 'nan' then slope::double else 0.0 end as slope, case when ore is null or isnan(ore) then 0.0 else ore::double end as ore
from (select distinct * from cells)"""


def _discharge(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "matches").select("wqms_id", "ilat", "ilon", "cell_uparea_km2").distinct()
    c = read_table(spark, d, "cells").select("ilat", "ilon", "slope").distinct()
    up = _f("cell_uparea_km2")
    return m.join(c, ["ilat", "ilon"]).select("wqms_id", (up * RUNOFF).alias("q"), F.when(_f("slope") > 0, _f("slope")).otherwise(0.0).alias("s")).filter("q is not null")


def channel(spark: SparkSession, d: str) -> DataFrame:
    """Hydraulic geometry at each matched station: width, depth, radius, velocity, area, volume, dispersion, substeps."""
    q, s = F.col("q"), F.col("s")
    v = hydraulics.velocity(q, s)
    a = hydraulics.area(q, v)
    out = _discharge(spark, d).select(
        "wqms_id", hydraulics.width(q).alias("width"), hydraulics.depth(q).alias("depth"), hydraulics.hydraulic_radius(q).alias("radius"), v.alias("velocity"),
        hydraulics.chemistry_velocity(q, s).alias("chemistry_velocity"), a.alias("area"), (hydraulics.volume(a) / 1e6).alias("megalitres"),
        hydraulics.dispersion(q, s).alias("dispersion"), hydraulics.courant_substeps(v, WEEK_S).alias("substeps"),
    )
    return _r(out, 5)


CHANNEL = f"""
with c as (select distinct ilat, ilon, slope from cells), x as (
  select wqms_id, cell_uparea_km2 * {RUNOFF} as q, case when slope > 0 and slope::varchar <> 'nan' then slope::double else 0.0 end as s
  from (select distinct wqms_id, ilat, ilon, cell_uparea_km2 from matches) join c using (ilat, ilon) where cell_uparea_km2 is not null and not isnan(cell_uparea_km2)
), g as (select *, 2.71 * q ** 0.557 as w, 0.349 * q ** 0.341 as h from x), k as (
  select *, case when 2 * h + w > 0 then h * w / (2 * h + w) else 0.0 end as rh from g
), u as (select *, rh ** (2.0 / 3.0) * sqrt(s) / 0.044 as v from k), a as (select *, case when v > 0 then greatest(q / v, 1e-6) else 1e-6 end as a from u), f as (
  select *, sqrt(greatest((64 / (997.1 * v * 4 * rh / 0.894e-3 + 1e-30)) / 8 * 997.1 * v * v / 997.1, 1e-30)) as fr from a
)
select wqms_id, round(w, 5) as width, round(h, 5) as depth, round(rh, 5) as radius, round(v, 5) as velocity, round(case when v > 0 then v else 1.0 end, 5) as chemistry_velocity,
  round(a, 5) as area, round(a * 1000 * 1000 / 1e6, 5) as megalitres, round(5.4 * (w / (h + 1e-30)) ** 0.7 * (v / (fr + 1e-30)) ** 0.13 * h * v, 5) as dispersion,
  least(100, greatest(1, ceil(v * 604800 / 1000)))::int as substeps from f
"""


def iron_and_ph(spark: SparkSession, d: str) -> DataFrame:
    """Dissolved and total iron, pH from hydrogen, molar iron and impact class of every model row."""
    fe2, fe3, solid, h = (_f(c) for c in ("ferrous_iron", "ferric_iron", "ferric_oxyhydroxide", "hydrogen_ion"))
    dis = chemistry.dissolved_iron(fe2, fe3)
    out = read_table(spark, d, "results").distinct().select(
        "result_id", dis.alias("fe_dis"), chemistry.total_iron(fe2, fe3, solid).alias("fe_tot"), chemistry.ph(chemistry.moles_per_litre(h, "hydrogen_ion")).alias("ph_h"),
        (chemistry.moles_per_litre(fe2, "ferrous_iron") * 1e6).alias("fe2_micromol"), chemistry.impact_class(dis).alias("impact"), F.log10(dis + 1).alias("log_iron"),
    )
    return _r(out, 5)


_MOL = """
m as (select result_id, cell_id, case when not isnan(ferrous_iron) then ferrous_iron::double end as fe2, case when not isnan(ferric_iron) then ferric_iron::double end as fe3,
  case when not isnan(sulphate) then sulphate::double end as so4, case when not isnan(hydrogen_ion) then hydrogen_ion::double end as h,
  case when not isnan(ferric_oxyhydroxide) then ferric_oxyhydroxide::double end as solid, case when not isnan(bedload_storage) then bedload_storage::double end as bed
  from (select distinct * from results)), c as (
  select result_id, cell_id, fe2 / 55845000 as fe2, fe3 / 55845000 as fe3, so4 / 96056000 as so4, h / 1008000 as h, solid / 106870000 as solid, bed / 106870000 as bed from m)"""

IRON_AND_PH = "with " + _MOL + """
select m.result_id, round(m.fe2 + m.fe3, 5) as fe_dis, round(m.fe2 + m.fe3 + m.solid * (55.845 / 106.87), 5) as fe_tot,
  round(case when m.h > 0 then -log10(greatest(m.h / 1008000, 1e-14)) end, 5) as ph_h, round(m.fe2 / 55845000 * 1e6, 5) as fe2_micromol,
  case when m.fe2 + m.fe3 <= 0 then null when m.fe2 + m.fe3 < 16 then 'low' when m.fe2 + m.fe3 < 41 then 'raised' when m.fe2 + m.fe3 < 1e8 then 'high' end as impact,
  round(log10(m.fe2 + m.fe3 + 1), 5) as log_iron from m
"""


def molar_results(spark: SparkSession, d: str) -> DataFrame:
    """Model rows with concentrations in mol/L."""
    names = {"ferrous_iron": "fe2", "ferric_iron": "fe3", "sulphate": "so4", "hydrogen_ion": "h", "ferric_oxyhydroxide": "solid", "bedload_storage": "bed"}
    return read_table(spark, d, "results").distinct().select("result_id", "cell_id", *(chemistry.moles_per_litre(_f(c), c).alias(n) for c, n in names.items()))


def davies_activity(spark: SparkSession, d: str) -> DataFrame:
    """Activity coefficients of every model row."""
    g = chemistry.activities(F.col("h"), F.col("fe3"), F.col("fe2"), F.col("so4"))
    return _r(molar_results(spark, d).select("result_id", g[0].alias("gamma_h"), g[1].alias("gamma_fe3")), 8)


_DAVIES = _MOL + """, i as (select *, least(0.5 * (h + 9 * fe3 + 4 * fe2 + 4 * so4), 1.0) as st from c where h is not null and fe3 is not null and fe2 is not null and so4 is not null
), dv as (select *, sqrt(st) / (1 + sqrt(st)) - 0.3 * st as dd from i)"""


def iron_equilibrium(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in a litre after ferric iron reached equilibrium with its hydroxide, in micromol."""
    m = molar_results(spark, d).dropna()
    target = chemistry.ferric_at_equilibrium(F.col("h"), F.col("fe3"), F.col("fe2"), F.col("so4"))
    after = chemistry.precipitate(F.col("fe3"), F.col("h"), F.col("solid"), F.col("bed"), target)
    return _r(m.select("result_id", *((v * 1e6).alias(k) for k, v in after.items())), 6)


IRON_EQUILIBRIUM = "with " + _MOL + """, i as (
  select result_id, fe2, greatest(fe3, 0) as f3, fe3, so4, greatest(h, 1e-14) as hc, h, solid, bed from c where fe2 is not null and fe3 is not null and so4 is not null and h is not null and solid is not null and bed is not null
), s as (select *, least(0.5 * (hc + 9 * f3 + 4 * fe2 + 4 * so4), 1.0) as st from i), dv as (select *, sqrt(st) / (1 + sqrt(st)) - 0.3 * st as dd from s), e as (
  select *, 7.762471e4 * (10 ** (-0.5 * dd) * hc) ** 3 / 10 ** (-4.5 * dd) as target from dv
), p as (select *, fe3 > target as sat, least(greatest(fe3 - target, 0), fe3) as pr, least(greatest(target - fe3, 0), greatest(solid, 0), greatest(h / 3, 0)) as d1 from e
), q as (select *, greatest(h - 3 * d1, 0) as acid from p), z as (select *, least(greatest(target - fe3, 0) - d1, greatest(bed, 0), acid / 3) as d2 from q)
select result_id, round(1e6 * case when sat then fe3 - pr else fe3 + d1 + d2 end, 6) as ferric_iron, round(1e6 * case when sat then h + 3 * pr else greatest(acid - 3 * d2, 0) end, 6) as hydrogen_ion,
  round(1e6 * case when sat then solid + pr else solid - d1 end, 6) as ferric_oxyhydroxide, round(1e6 * case when sat then bed else bed - d2 end, 6) as bedload_storage from z
"""


def ferrous_oxidation(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in a litre after a week of ferrous oxidation, in micromol, and the logarithm of the rate per day."""
    m = molar_results(spark, d).dropna(subset=["fe2", "fe3", "h"])
    rate = chemistry.oxidation_rate(F.col("h"))
    after = chemistry.oxidise(F.col("fe2"), F.col("fe3"), F.col("h"), rate, WEEK_S)
    return _r(m.select("result_id", F.log10(rate * 86_400).alias("log_per_day"), *((v * 1e6).alias(k) for k, v in after.items())), 6)


def ferrous_euler(spark: SparkSession, d: str) -> DataFrame:
    """Ferrous iron (micromol/L) after a week, exactly and by 100 explicit Euler steps at fixed acid."""
    m = molar_results(spark, d).dropna(subset=["fe2", "h"])
    rate = chemistry.oxidation_rate(F.greatest("h", F.lit(1e-20)))
    step = F.greatest(1 - rate * (WEEK_S / 100), F.lit(0.0))
    euler = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.col("fe2"), lambda acc, _: acc * F.col("factor"))
    out = m.withColumn("factor", step).select("result_id", (F.col("fe2") * F.exp(-rate * WEEK_S) * 1e6).alias("exact"), (euler * 1e6).alias("euler"))
    return _r(out, 5)


def pyrite(spark: SparkSession, d: str) -> DataFrame:
    """Pyrite oxidation at cells with ore, by ferric iron and by oxygen, in micromol/s."""
    ore = read_table(spark, d, "cells").select("cell_id", _f("ore").alias("ore")).distinct().filter("ore > 0")
    m = molar_results(spark, d).dropna(subset=["fe3", "h"]).join(ore, "cell_id")
    a, b = chemistry.pyrite_rates(F.col("fe3"), F.col("h"), F.col("ore"))
    return _r(m.select("result_id", (a * 1e6).alias("by_iron"), (b * 1e6).alias("by_oxygen")), 6)


def cell_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area of every grid row that holds cells, on the ellipsoid."""
    return read_table(spark, d, "cells").select("ilat", F.col("lat")).distinct().groupBy("ilat").agg(F.round(F.max(grids.cell_area_km2(F.col("lat"))), 8).alias("km2"))


def station_areas(spark: SparkSession, d: str) -> DataFrame:
    """Upstream area of each station through its link, km2."""
    s, a = read_table(spark, d, "stations").select("wqms_id", "linkno").distinct(), read_table(spark, d, "link_area").distinct()
    return s.join(a, "linkno").select("wqms_id", "linkno", F.round(_f("area_m2") / 1e6, 6).alias("area_km2"))


def stations_in_domain(spark: SparkSession, d: str) -> DataFrame:
    """Stations inside the cells' extent, 0.1 degrees added on every side."""
    c = read_table(spark, d, "cells").agg(*(f(x).alias(f"{n}_{x}") for x in ("lat", "lon") for f, n in ((F.min, "a"), (F.max, "b"))))
    s = read_table(spark, d, "stations").select("wqms_id", "lat", (F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).alias("lon")).distinct().filter("lat is not null and not isnan(lat) and lon is not null and not isnan(lon)")
    inside = F.col("lat").between(F.col("a_lat") - 0.1, F.col("b_lat") + 0.1) & F.col("lon").between(F.col("a_lon") - 0.1, F.col("b_lon") + 0.1)
    return s.join(F.broadcast(c)).filter(inside).select("wqms_id")  # one row


def mine_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name a mine or quarry as a word, any case; NULL texts do not."""
    return read_table(spark, d, "documents").filter(F.coalesce(F.col("text").rlike(r"(?i)\b(mine|mining|quarry)\b"), F.lit(False))).select("doc_id")


def iron_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose type has E or S anywhere, as a case-sensitive element filter works, semi-joined to lines."""
    lines = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, d, "part").filter(F.col("p_type").rlike("(E|S)")).join(lines, "p_partkey", "left_semi").select("p_partkey", "p_type")


def country_summary(spark: SparkSession, d: str) -> DataFrame:
    """Customers per nation under overridden names, with status and log count; nations without any have 0."""
    override = F.create_map(*(F.lit(x) for x in ("UNITED STATES", "UNITED STATES OF AMERICA", "RUSSIA", "RUSSIAN FEDERATION")))
    n = read_table(spark, d, "nation")
    c = read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("raw"))
    out = n.join(c, "n_nationkey", "left")
    k = F.greatest(F.coalesce("raw", F.lit(0)), F.lit(0))
    status = F.when(F.col("raw") < 0, "error").when(k == 0, "empty").otherwise("ok")
    return out.select(F.coalesce(override[F.upper("n_name")], F.col("n_name")).alias("country"), k.alias("n"), status.alias("status"), F.round(F.log10(k + 1), 6).alias("log_n"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nations by status, with their customers."""
    return country_summary(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("nations"), F.sum("n").alias("customers"))


def unobserved_stations(spark: SparkSession, d: str) -> DataFrame:
    """Stations that no reading names, as a resumable collection would still have to visit."""
    return read_table(spark, d, "stations").select("wqms_id").distinct().join(read_table(spark, d, "obs").select("wqms_id"), "wqms_id", "left_anti")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by a nested JSON value."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read_table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).filter("k is not null")


def date_parts(spark: SparkSession, d: str) -> DataFrame:
    """Model rows by day, month and year."""
    r = read_table(spark, d, "results").filter("ts is not null")
    return r.groupBy(F.year("ts").alias("y"), F.month("ts").alias("m"), F.day("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))


def slope_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """Box-plot numbers of the cells' slope by whether they are a source."""
    c = read_table(spark, d, "cells").distinct().select("source", _f("slope").alias("s")).filter("s > 0 and source is not null")
    c = materialise(c)
    ends = c.groupBy("source").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    q = quantiles(c, ["source"], "s", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return _r(ends.join(q, "source").select("source", "low", "q1", "q2", "q3", "high"), 8)


def extent_quadrants(spark: SparkSession, d: str) -> DataFrame:
    """Stations in each quarter of their extent, and the zoom window around their mean."""
    s = read_table(spark, d, "stations").distinct().filter("lat is not null and not isnan(lat) and lon is not null and not isnan(lon)")
    e = s.agg(*(f(x).alias(f"{n}_{x}") for x in ("lat", "lon") for f, n in ((F.min, "a"), (F.max, "b"), (F.avg, "m"))))
    north, east = F.col("lat") >= (F.col("a_lat") + F.col("b_lat")) / 2, F.col("lon") >= (F.col("a_lon") + F.col("b_lon")) / 2
    half = lambda x: F.greatest((F.max(f"b_{x}") - F.max(f"a_{x}")) / 2.5, F.lit(0.2))
    g = s.join(F.broadcast(e)).agg(  # one row
        F.count_if(north & ~east).alias("nw"), F.count_if(north & east).alias("ne"), F.count_if(~north & ~east).alias("sw"), F.count_if(~north & east).alias("se"),
        *(F.round(F.max(f"m_{x}") + k * half(x), 6).alias(f"{n}_{x}") for x in ("lat", "lon") for n, k in (("low", -1), ("high", 1))),
    )
    return g


QUERIES = {
    "normalised_cells": normalised_cells, "channel": channel, "iron_and_ph": iron_and_ph, "davies_activity": davies_activity, "iron_equilibrium": iron_equilibrium,
    "ferrous_oxidation": ferrous_oxidation, "ferrous_euler": ferrous_euler, "pyrite": pyrite, "cell_areas": cell_areas, "station_areas": station_areas,
    "stations_in_domain": stations_in_domain, "mine_texts": mine_texts, "iron_parts": iron_parts, "country_summary": country_summary, "status_counts": status_counts, "unobserved_stations": unobserved_stations,
    "event_props": event_props, "date_parts": date_parts, "slope_quartiles": slope_quartiles, "extent_quadrants": extent_quadrants,
}

_COUNTRY = """
with c as (select c_nationkey, count(*) as raw from customer group by 1)
select case upper(n_name) when 'UNITED STATES' then 'UNITED STATES OF AMERICA' when 'RUSSIA' then 'RUSSIAN FEDERATION' else n_name end as country, coalesce(raw, 0) as n,
  case when coalesce(raw, 0) = 0 then 'empty' else 'ok' end as status, round(log10(coalesce(raw, 0) + 1), 6) as log_n from nation left join c on c_nationkey = n_nationkey
"""

_SEEN = "lat is not null and not isnan(lat) and lon is not null and not isnan(lon)"

# DuckDB folds isnan() by the file's statistics, which leave NaN out; the text of a NaN it can't fold
SQL = {
    "normalised_cells": _CELLS,
    "channel": CHANNEL,
    "iron_and_ph": IRON_AND_PH,
    "davies_activity": "with " + _DAVIES + """ select c.result_id, round(10 ** (-0.5 * dd), 8) as gamma_h, round(10 ** (-4.5 * dd), 8) as gamma_fe3 from c left join dv using (result_id)""",
    "iron_equilibrium": IRON_EQUILIBRIUM,
    "ferrous_oxidation": "with " + _MOL + """, r as (select *, 2.91e-9 * 0.21 + 1.33e12 * (1e-14 / greatest(h, 1e-14)) * (1e-14 / greatest(h, 1e-14)) * 0.21 as k from c where fe2 is not null and fe3 is not null and h is not null
), a as (select *, fe2 * exp(-k * 604800) as rest from r), b as (select *, least(fe2 - rest, h) as made from a)
select result_id, round(log10(k * 86400), 6) as log_per_day, round(rest * 1e6, 6) as ferrous_iron, round((fe3 + made) * 1e6, 6) as ferric_iron, round(greatest(h - made, 0) * 1e6, 6) as hydrogen_ion from b""",
    "ferrous_euler": "with " + _MOL + """, r as (select *, 2.91e-9 * 0.21 + 1.33e12 * (1e-14 / greatest(h, 1e-14)) * (1e-14 / greatest(h, 1e-14)) * 0.21 as k from c where fe2 is not null and h is not null)
select result_id, round(fe2 * exp(-k * 604800) * 1e6, 5) as exact, round(fe2 * greatest(1 - k * 6048, 0) ** 100 * 1e6, 5) as euler from r""",
    "pyrite": "with " + _MOL + """, o as (select distinct cell_id, ore::double as ore from cells where ore > 0 and not isnan(ore))
select result_id, round(1e6 * case when fe3 > 0 then (10.0 ** -9.74 * 1e4 / 60) * sqrt(greatest(fe3, 1e-10)) / sqrt(greatest(h, 1e-7)) * ore else 0 end, 6) as by_iron,
  round(1e6 * (10.0 ** -8.19) * sqrt(10.0 / 31998) / greatest(h, 1e-7) ** 0.11 * ore, 6) as by_oxygen from c join o using (cell_id) where fe3 is not null and h is not null""",
    "cell_areas": """
with e as (select sqrt(1 - (6356752.3142 / 6378137) ** 2) as e), g as (select ilat, max(lat) as lat from cells group by 1), z as (
  select ilat, e, e * sin(radians(lat + 1.0 / 240)) as a, e * sin(radians(lat - 1.0 / 240)) as b from g, e
) select ilat, round(abs((atanh(a) / (2 * e) + a / e / (2 * (1 - a * a))) - (atanh(b) / (2 * e) + b / e / (2 * (1 - b * b)))) * pi() * 6356752.3142 ** 2 * 2 / 43200 / 1e6, 8) as km2 from z
""",
    "station_areas": "select wqms_id, linkno, round(case when not isnan(area_m2) then area_m2 end / 1e6, 6) as area_km2 from (select distinct wqms_id, linkno from stations) join (select distinct * from link_area) using (linkno)",
    "stations_in_domain": f"""
with c as (select min(lat) as a, max(lat) as b, min(lon) as w, max(lon) as e from cells), s as (select distinct wqms_id, lat, (lon + 180) - 360 * floor((lon + 180) / 360) - 180 as lon from stations where {_SEEN})
select wqms_id from s, c where lat between a - 0.1 and b + 0.1 and lon between w - 0.1 and e + 0.1
""",
    "mine_texts": r"select doc_id from documents where coalesce(regexp_matches(text, '(?i)\b(mine|mining|quarry)\b'), false)",
    "iron_parts": "select p_partkey, p_type from part semi join lineitem on l_partkey = p_partkey where regexp_matches(p_type, '(E|S)')",
    "country_summary": _COUNTRY,
    "status_counts": "select status, count(*) as nations, sum(n)::bigint as customers from (" + _COUNTRY + ") group by 1",
    "unobserved_stations": "select distinct wqms_id from stations anti join obs using (wqms_id)",
    "event_props": "select (props ->> '$.k')::int as k, count(*) as n, round(sum(value), 4) as value from events where (props ->> '$.k') is not null group by 1",
    "date_parts": "select year(ts)::int as y, month(ts)::int as m, day(ts)::int as d, count(*) as n from results where ts is not null group by all",
    "slope_quartiles": """
select source, round(min(s), 8) as low, round(quantile_cont(s, 0.25), 8) as q1, round(quantile_cont(s, 0.5), 8) as q2, round(quantile_cont(s, 0.75), 8) as q3, round(max(s), 8) as high
from (select source, slope::double as s from (select distinct * from cells) where slope > 0 and slope::varchar <> 'nan' and source is not null) group by 1
""",
    "extent_quadrants": f"""
with s as (select distinct * from stations where {_SEEN}), e as (select min(lat) as a, max(lat) as b, avg(lat) as m, min(lon) as w, max(lon) as e, avg(lon) as n from s)
select count(*) filter (lat >= (a + b) / 2 and lon < (w + e) / 2) as nw, count(*) filter (lat >= (a + b) / 2 and lon >= (w + e) / 2) as ne,
  count(*) filter (lat < (a + b) / 2 and lon < (w + e) / 2) as sw, count(*) filter (lat < (a + b) / 2 and lon >= (w + e) / 2) as se,
  round(max(m) - greatest(max(b - a) / 2.5, 0.2), 6) as low_lat, round(max(m) + greatest(max(b - a) / 2.5, 0.2), 6) as high_lat,
  round(max(n) - greatest(max(e - w) / 2.5, 0.2), 6) as low_lon, round(max(n) + greatest(max(e - w) / 2.5, 0.2), 6) as high_lon from s, e
""",
}
