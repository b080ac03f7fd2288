"""Queries on series: weekly means, pairing of model and observations, fit, splines, gaps."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.functions import chemistry
from tarnflow.operators import metrics, series
from tarnflow.operators.lanes import running
from tarnflow.plans.problems import station_cells
from tarnflow.session import materialise
from tarnflow.sources.tables import micros, read_table

#: Least paired weeks of a station in the evaluation.
MIN_PAIRS = 3


def plausible_obs(spark: SparkSession, d: str) -> DataFrame:
    """Readings inside the physical limits, each obs_id once."""
    o = read_table(spark, d, "obs").filter("ts is not null and value between 0 and case when var = 'pH' then 14 else 1e9 end")
    return o.select("obs_id", "wqms_id", "ts", "var", "value").distinct()


_OBS = "select distinct obs_id, wqms_id, ts, var, value from obs where ts is not null and value between 0 and case when var = 'pH' then 14 else 1e9 end"


def weekly_resample(spark: SparkSession, d: str) -> DataFrame:
    """Weekly mean per station and variable with its empty weeks."""
    w = series.weekly_mean(plausible_obs(spark, d), ["wqms_id", "var"], "ts", "value")
    return w.select("wqms_id", "var", F.date_format("week_end", "yyyy-MM-dd").alias("week_end"), F.round("value", 6).alias("value"), "n")


WEEKLY_RESAMPLE = f"""
with o as ({_OBS}), w as (
  select wqms_id, var, (date_trunc('week', ts) + interval 6 day)::date as week_end, avg(value) as value, count(*) as n from o group by 1, 2, 3
), span as (
  select wqms_id, var, unnest(generate_series(min(week_end)::timestamp, max(week_end)::timestamp, interval 7 day))::date as week_end from w group by 1, 2
)
select s.wqms_id, s.var, strftime(s.week_end, '%Y-%m-%d') as week_end, round(w.value, 6) as value, coalesce(w.n, 0) as n from span s left join w using (wqms_id, var, week_end)
"""


def model_series(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, ts, var, modelled: pH, dissolved and total iron of the model; repeated rows once, reruns averaged."""
    r = read_table(spark, d, "results").distinct()
    fe2, fe3, solid = (F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in ("ferrous_iron", "ferric_iron", "ferric_oxyhydroxide"))
    values = F.map_from_arrays(
        F.array(*map(F.lit, ("pH", "Fe-Dis", "Fe-Tot"))),
        F.array(F.nanvl(F.col("ph").cast("double"), F.lit(None)), chemistry.dissolved_iron(fe2, fe3), chemistry.total_iron(fe2, fe3, solid)),
    )
    long = r.filter("ts is not null").select("cell_id", "ts", F.explode(values).alias("var", "modelled")).filter("modelled is not null")
    return long.groupBy("cell_id", "ts", "var").agg(F.avg("modelled").alias("modelled"))


_MODEL = """
raw as (select distinct * from results where ts is not null), clean as (
  select cell_id, ts, case when not isnan(ph) then ph::double end as ph, case when not isnan(ferrous_iron) then ferrous_iron::double end as fe2,
    case when not isnan(ferric_iron) then ferric_iron::double end as fe3, case when not isnan(ferric_oxyhydroxide) then ferric_oxyhydroxide::double end as solid from raw
), model as (
  select cell_id, ts, var, avg(modelled) as modelled from (
    select cell_id, ts, 'pH' as var, ph as modelled from clean union all select cell_id, ts, 'Fe-Dis', fe2 + fe3 from clean
    union all select cell_id, ts, 'Fe-Tot', fe2 + fe3 + solid * (55.845 / 106.87) from clean) where modelled is not null group by all
)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """wqms_id, var, ts, observed, modelled: every model step of a matched cell with the nearest week's observation.

    The week is the nearest label of the dense weekly grid over the time both sides cover, at most 14 days away; it
    pairs as empty where it holds no observation, however close the next one is.
    """
    obs, model = plausible_obs(spark, d), model_series(spark, d).join(station_cells(spark, d), "cell_id")
    weekly = series.weekly_mean(obs, ["wqms_id", "var"], "ts", "value", dense=False)
    span = lambda df: df.groupBy("var").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    both = span(obs).join(span(model).withColumnsRenamed({"a": "c", "b": "e"}), "var")
    both = both.select("var", F.greatest("a", "c").alias("begin"), F.least("b", "e").alias("end")).filter("begin < end")  # one row per variable
    model = model.join(F.broadcast(both), "var").filter(F.col("ts").between(F.col("begin"), F.col("end")))
    label = series.nearest_week_end(F.col("ts"))
    label = F.greatest(series.week_end("begin"), F.least(label, series.week_end("end")))
    model = model.select("wqms_id", "var", "ts", "modelled", label.alias("week_end"))
    model = model.filter(F.abs(micros("ts") - micros(F.col("week_end").cast("timestamp"))) <= 14 * series.DAY_US)
    joined = model.join(weekly.select("wqms_id", "var", "week_end", F.col("value").alias("observed")), ["wqms_id", "var", "week_end"], "left")
    return joined.select("wqms_id", "var", "ts", "observed", "modelled")


_PAIRS = f"""
with o as ({_OBS}), {_MODEL}, station as (
  select distinct m.wqms_id, c.cell_id from matches m join cells c on c.ilat = m.ilat and c.ilon = m.ilon
), matched as (
  select s.wqms_id, m.var, m.ts, m.modelled from model m join station s using (cell_id)
), weekly as (
  select wqms_id, var, (date_trunc('week', ts) + interval 6 day)::date as week_end, avg(value) as observed from o group by 1, 2, 3
), span as (
  select var, greatest(a, c) as b, least(z, e) as e from (select var, min(ts) as a, max(ts) as z from o group by 1) x
  join (select var, min(ts) as c, max(ts) as e from matched group by 1) y using (var) where greatest(a, c) < least(z, e)
), labels as (
  select var, unnest(generate_series(date_trunc('week', b) + interval 6 day, date_trunc('week', e) + interval 6 day, interval 7 day)) as label from span
), near as (
  select m.wqms_id, m.var, m.ts, m.modelled, l.label from matched m join span s on s.var = m.var and m.ts between s.b and s.e
  join labels l on l.var = m.var and abs(epoch_us(l.label) - epoch_us(m.ts)) <= 14 * 86400000000
), best as (
  select * from near qualify row_number() over (partition by wqms_id, var, ts order by abs(epoch_us(label) - epoch_us(ts)), label) = 1
), pairs as (
  select b.wqms_id, b.var, b.ts, w.observed, b.modelled from best b left join weekly w on w.wqms_id = b.wqms_id and w.var = b.var and w.week_end = b.label::date
)"""


def observed_modelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of the evaluation, empty ones too."""
    return pairs(spark, d).select("wqms_id", "var", "ts", F.round("observed", 6).alias("observed"), F.round("modelled", 6).alias("modelled"))


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def weekly_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Paired weekly means: both sides resampled by week once more, weeks with both kept."""
    p = pairs(spark, d).dropna(subset=["observed", "modelled"])
    return p.groupBy("wqms_id", "var", series.week_end("ts").alias("week_end")).agg(F.avg("observed").alias("observed"), F.avg("modelled").alias("modelled"))


_WEEKS = _PAIRS + """, weeks as (
  select wqms_id, var, (date_trunc('week', ts) + interval 6 day)::date as week_end, avg(observed) as observed, avg(modelled) as modelled
  from pairs where observed is not null and modelled is not null group by 1, 2, 3
)"""

_FIT = """
  count(*) as n, avg(modelled - observed) as bias, sqrt(avg((modelled - observed) ** 2)) as e, sum((modelled - observed) ** 2) as ss,
  min(observed) < max(observed) and min(modelled) < max(modelled) as scatter, var_pop(observed) as vo, var_pop(modelled) as vm, avg(observed) as mo, avg(modelled) as mm, covar_pop(observed, modelled) as c,
  quantile_cont(observed, 0.75) - quantile_cont(observed, 0.25) as qo, quantile_cont(modelled, 0.75) - quantile_cont(modelled, 0.25) as qm"""


def _fit_sql(keys: str, source: str) -> str:
    gate = lambda x, name: f"case when n >= {MIN_PAIRS} and scatter then round({x}, 5) end as {name}"
    r = "c / nullif(sqrt(vo * vm), 0)"
    so, sm = "sqrt(vo) / nullif(sqrt(vm), 0)", "sqrt(vm) / nullif(sqrt(vo), 0)"
    bo, bm = "mo / nullif(mm, 0)", "mm / nullif(mo, 0)"
    root = lambda x, y: f"1 - sqrt(({r} - 1) ** 2 + ({x} - 1) ** 2 + ({y} - 1) ** 2)"
    return f""", fit as (select {keys}, {_FIT} from {source} group by all)
select {keys}, n, round(bias, 5) as bias, {gate('e', 'rmse')}, {gate('1 - ss / nullif(vo * n, 0)', 'r2')}, {gate('1 - ss / nullif(vm * n, 0)', 'nse')},
  {gate('1 - ss / nullif(vo * n, 0)', 'nse_standard')}, {gate(root(so, bo), 'kge')}, {gate(root(sm, bm), 'kge_standard')}, {gate(root('qm / nullif(qo, 0)', bm), 'fze')} from fit"""


def station_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Fit of the model at each station and variable."""
    return _rounded(metrics.fit_metrics(weekly_pairs(spark, d), ["wqms_id", "var"], min_n=MIN_PAIRS))


def case_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Fit over all stations of a network (the first part of their ids)."""
    w = weekly_pairs(spark, d).withColumn("network", F.split("wqms_id", "-")[0])
    return _rounded(metrics.fit_metrics(w, ["network", "var"], min_n=MIN_PAIRS, large=True))


def min_paired(spark: SparkSession, d: str) -> DataFrame:
    """Stations with enough pairs."""
    n = F.count(F.when(F.col("observed").isNotNull() & F.col("modelled").isNotNull(), 1))
    return pairs(spark, d).groupBy("wqms_id", "var").agg(n.alias("n")).filter(F.col("n") >= MIN_PAIRS)


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Stations left out of the evaluation: too few pairs, or a model that is 0 throughout."""
    both = F.col("observed").isNotNull() & F.col("modelled").isNotNull()
    g = materialise(pairs(spark, d).groupBy("wqms_id", "var").agg(F.count(F.when(both, 1)).alias("n"), F.bool_and(F.coalesce(F.col("modelled") == 0, F.lit(False))).alias("zero")))
    few = g.filter((F.col("n") > 0) & (F.col("n") < MIN_PAIRS)).select("wqms_id", "var", "n", F.lit("few_obs").alias("reason"))
    return few.unionByName(g.filter("zero").select("wqms_id", "var", "n", F.lit("all_zero").alias("reason")))


def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares line of modelled on observed weeks per network; at least two weeks."""
    w = weekly_pairs(spark, d).withColumn("network", F.split("wqms_id", "-")[0])
    g = w.groupBy("network", "var").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("modelled", "observed").alias("slope"), F.regr_intercept("modelled", "observed").alias("intercept"))
    return _rounded(g.filter("n >= 2"), 4)


def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of modelled and observed weeks per variable, with its p-value."""
    w = weekly_pairs(spark, d).withColumns({c: F.round(c, 6) for c in ("observed", "modelled")})
    return _rounded(metrics.spearman(materialise(w), ["var"], "observed", "modelled").select("var", "n", "rho", "p"), 5)


def best_worst(spark: SparkSession, d: str) -> DataFrame:
    """Stations with the least and the greatest error per variable."""
    m = station_metrics(spark, d).filter("rmse is not null")
    key = F.struct("rmse", "wqms_id")
    return m.groupBy("var").agg(F.min_by("wqms_id", key).alias("best"), F.max_by("wqms_id", key).alias("worst"), F.min("rmse").alias("least_rmse"), F.max("rmse").alias("greatest_rmse"))


def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Stations in ten equal bins of the bias of each variable."""
    m = station_metrics(spark, d).select("var", "bias")
    span = m.groupBy("var").agg(F.min("bias").alias("a"), F.max("bias").alias("b"))  # one row per variable
    return m.join(F.broadcast(span), "var").groupBy("var", metrics.equal_bins(F.col("bias"), F.col("a"), F.col("b")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def time_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Time that observations and model share at each matched cell."""
    span = lambda df: df.groupBy("cell_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    o = span(plausible_obs(spark, d).join(station_cells(spark, d), "wqms_id"))
    m = span(read_table(spark, d, "results").filter("ts is not null")).withColumnsRenamed({"a": "c", "b": "e"})
    return o.join(m, "cell_id").select("cell_id", F.greatest("a", "c").alias("begin"), F.least("b", "e").alias("end")).filter("begin < end")


def _annual(spark: SparkSession, d: str) -> DataFrame:
    """Mean, least and greatest sulphate per cell and year, with years counted from the cell's first."""
    r = read_table(spark, d, "results").filter("ts is not null and not isnan(sulphate)").join(read_table(spark, d, "cells").select("cell_id", "lat").distinct(), "cell_id")
    v = F.col("sulphate").cast("double")
    g = r.groupBy("cell_id", "lat", F.year("ts").alias("y")).agg(F.avg(v).alias("qav"), F.min(v).alias("qmi"), F.max(v).alias("qma"))
    w = Window.partitionBy("cell_id")
    g = g.withColumn("year", F.col("y") - F.min("y").over(w)).withColumn("_whole", F.max("year").over(w) + 1 == F.count(F.lit(1)).over(w))
    return g.filter("_whole").drop("_whole", "y")


def seasonal_spline(spark: SparkSession, d: str) -> DataFrame:
    """Weekly seasonal curve per cell through its yearly means and extremes."""
    return series.seasonal_weeks(_annual(spark, d), ["cell_id"], "lat").select("cell_id", "week", F.round("q", 6).alias("q"))


def weekly_axis(spark: SparkSession, d: str) -> DataFrame:
    """52 Mondays a year from the first Monday of the first model year; the axis drifts against the calendar."""
    y = read_table(spark, d, "results").agg(F.year(F.min("ts")).alias("a"), F.year(F.max("ts")).alias("b")).filter("a is not null")
    first = F.next_day(F.date_sub(F.make_date("a", F.lit(1), F.lit(1)), 1), "Mon")
    return y.select(first.alias("first"), F.explode(F.sequence(F.lit(0), (F.col("b") - F.col("a") + 1) * 52 - 1)).alias("k")).select((F.col("k") + 1).alias("week"), F.expr("date_format(date_add(first, k * 7), 'yyyy-MM-dd')").alias("monday"))


def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest signup of the same user, at most a day away, for each purchase."""
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))
    left, right = (e.filter(F.col("event_type") == x) for x in ("purchase", "signup"))
    left = left.select("user_id", F.col("event_id").alias("purchase_id"), "t")
    out = series.asof_nearest(left, right.select("user_id", F.col("event_id").alias("signup_id"), "value", "t"), ["user_id"], 86_400_000_000, ["signup_id", "value"], ["purchase_id"])
    return out.select("purchase_id", "user_id", F.coalesce("signup_id", F.lit(-1)).alias("signup_id"), "value", (F.col("t_right").isNotNull()).alias("paired"))


def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Sampling campaigns per station and variable: clusters parted by more than 30 days."""
    c = series.gap_clusters(plausible_obs(spark, d), ["wqms_id", "var"], "ts", 30 * series.DAY_US, "obs_id")
    return c.select("obs_id", "cluster", F.col("in_cluster").cast("bigint").alias("in_cluster"), F.round("offset", 6).alias("offset"))


def every_nth(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth model step of a cell."""
    t = read_table(spark, d, "results").filter("ts is not null").select("cell_id", "ts").distinct()
    return t.withColumn("k", F.row_number().over(Window.partitionBy("cell_id").orderBy("ts")) - 1).filter("k % 4 = 0").select("cell_id", "ts")


def last_slice(spark: SparkSession, d: str) -> DataFrame:
    """The last step of every cell with positive dissolved iron."""
    r = read_table(spark, d, "results").filter("ts is not null").distinct()
    last = r.groupBy("cell_id").agg(F.max("ts").alias("ts"))
    fe = F.col("ferrous_iron").cast("double") + F.col("ferric_iron").cast("double")
    return r.join(last, ["cell_id", "ts"]).select("result_id", "cell_id", "ts", F.round(fe, 6).alias("iron")).filter("iron > 0 and not isnan(iron)")


def next_time(spark: SparkSession, d: str) -> DataFrame:
    """Each model step of a cell with the step after it."""
    t = read_table(spark, d, "results").filter("ts is not null").select("cell_id", "ts").distinct()
    return t.select("cell_id", "ts", F.lead("ts").over(Window.partitionBy("cell_id").orderBy("ts")).alias("next_ts"))


def sampled_any(spark: SparkSession, d: str) -> DataFrame:
    """Cells with pH, and with iron above 0, at any of ten steps spread evenly over the model's time axis."""
    r = read_table(spark, d, "results").filter("ts is not null")
    times = materialise(r.select(F.lit(0).alias("axis"), "ts").distinct())
    n = times.count()
    picked = running(times, ["axis"], ["ts"], F.lit(1), "k").filter(F.col("k").isin(sorted({int(i * (n - 1) / 9) for i in range(10)})))
    iron = F.coalesce(F.nanvl(F.col("ferrous_iron").cast("double"), F.lit(None)), F.lit(0.0)) + F.coalesce(F.nanvl(F.col("ferric_iron").cast("double"), F.lit(None)), F.lit(0.0))
    return r.join(picked.select("ts"), "ts", "left_semi").groupBy("cell_id").agg(F.bool_or(F.col("ph").isNotNull() & ~F.isnan("ph")).alias("has_ph"), F.bool_or(iron > 0).alias("has_iron"))


def finite_mask(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose pH, ferrous and ferric iron are present at every step."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return read_table(spark, d, "results").groupBy("cell_id").agg(F.bool_and(ok("ph") & ok("ferrous_iron") & ok("ferric_iron")).alias("finite"))


def variable_stations(spark: SparkSession, d: str) -> DataFrame:
    """Stations with at least one value of each variable."""
    o = read_table(spark, d, "obs")
    return o.groupBy("var", "wqms_id").agg(F.bool_or(F.col("value").isNotNull() & ~F.isnan("value")).alias("any")).filter("any").select("var", "wqms_id")


QUERIES = {
    "weekly_resample": weekly_resample, "observed_modelled_pairs": observed_modelled_pairs, "station_metrics": station_metrics, "case_metrics": case_metrics,
    "min_paired": min_paired, "drop_reasons": drop_reasons, "linear_fit": linear_fit, "spearman": spearman, "best_worst": best_worst, "error_histogram": error_histogram,
    "time_overlap": time_overlap, "seasonal_spline": seasonal_spline, "weekly_axis": weekly_axis, "asof_nearest": asof_nearest, "gap_clusters": gap_clusters,
    "every_nth": every_nth, "last_slice": last_slice, "next_time": next_time, "sampled_any": sampled_any, "finite_mask": finite_mask, "variable_stations": variable_stations,
}

_STATION_FIT = _WEEKS + _fit_sql("wqms_id, var", "weeks")

SQL = {
    "weekly_resample": WEEKLY_RESAMPLE,
    "observed_modelled_pairs": _PAIRS + " select wqms_id, var, ts, round(observed, 6) as observed, round(modelled, 6) as modelled from pairs",
    "station_metrics": _STATION_FIT,
    "case_metrics": _WEEKS + ", cases as (select split_part(wqms_id, '-', 1) as network, * from weeks)" + _fit_sql("network, var", "cases"),
    "min_paired": _PAIRS + f" select wqms_id, var, count(*) filter (observed is not null and modelled is not null) as n from pairs group by 1, 2 having n >= {MIN_PAIRS}",
    "drop_reasons": _PAIRS + f""", g as (
  select wqms_id, var, count(*) filter (observed is not null and modelled is not null) as n, bool_and(coalesce(modelled = 0, false)) as zero from pairs group by 1, 2
) select wqms_id, var, n, 'few_obs' as reason from g where n > 0 and n < {MIN_PAIRS} union all select wqms_id, var, n, 'all_zero' from g where zero""",
    "linear_fit": _WEEKS + """ select split_part(wqms_id, '-', 1) as network, var, count(*) as n, round(regr_slope(modelled, observed), 4) as slope,
  round(regr_intercept(modelled, observed), 4) as intercept from weeks group by 1, 2 having count(*) >= 2""",
    "spearman": _WEEKS + """, v as (select var, round(observed, 6) as o, round(modelled, 6) as m from weeks), r as (
  select var, rank() over (partition by var order by o) + (count(*) over (partition by var, o) - 1) / 2 as x,
    rank() over (partition by var order by m) + (count(*) over (partition by var, m) - 1) / 2 as y from v
 ), c as (select var, count(*) as n, corr(x, y) as rho from r group by var), side as (
  select var, n, rho, unnest([asin(least(abs(rho), 1)), 0.0]) as a, unnest([true, false]) as tail, 14 / sqrt(greatest(n - 3, 1)) as reach from c
), simpson as (
  select var, n, rho, tail, sum(case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end * greatest(cos(a + k * h), 0) ** (n - 3)) * max(h) / 3 as s
  from (select *, (least(pi() / 2, a + reach) - a) / 2000 as h from side), generate_series(0, 2000) g(k) group by all
) select var, n, round(rho, 5) as rho, case when n >= 3 then round(case when abs(rho) >= 1 then 0 else sum(s) filter (tail) / sum(s) filter (not tail) end, 5) end as p from simpson group by var, n, rho""",
    "best_worst": "with s as (" + _STATION_FIT + """) select var, arg_min(wqms_id, (rmse, wqms_id)) as best, arg_max(wqms_id, (rmse, wqms_id)) as worst,
  min(rmse) as least_rmse, max(rmse) as greatest_rmse from s where rmse is not null group by var""",
    "error_histogram": "with s as (select var, bias from (" + _STATION_FIT + """)), e as (select var, min(bias) as a, max(bias) as b from s group by 1)
select var, (least(10, coalesce(floor((bias - a) / nullif(b - a, 0) * 10), 0) + 1))::int as bin, count(*) as n from s join e using (var) group by 1, 2""",
    "time_overlap": f"""
with o as ({_OBS}), station as (select distinct m.wqms_id, c.cell_id from matches m join cells c on c.ilat = m.ilat and c.ilon = m.ilon),
x as (select cell_id, min(ts) as a, max(ts) as z from o join station using (wqms_id) group by 1), y as (select cell_id, min(ts) as c, max(ts) as e from results where ts is not null group by 1)
select cell_id, greatest(a, c) as "begin", least(z, e) as "end" from x join y using (cell_id) where greatest(a, c) < least(z, e)
""",
    "seasonal_spline": """
with r as (
  select r.cell_id, c.lat, year(r.ts) as y, avg(sulphate::double) as qav, min(sulphate::double) as qmi, max(sulphate::double) as qma
  from results r join (select distinct cell_id, lat from cells) c using (cell_id) where r.ts is not null and not isnan(sulphate) group by 1, 2, 3
), annual as (
  select *, y - min(y) over w as year, max(y) over w - min(y) over w as last_year, count(*) over w as n from r window w as (partition by cell_id)
), whole as (select * from annual where last_year + 1 = n), anchor as (
  select cell_id, 52 * year + 2 as x, case when lat >= 0 then qma else qmi end as v, false as mean from whole
  union all select cell_id, 52 * year + 15, qav, true from whole
  union all select cell_id, 52 * year + 28, case when lat >= 0 then qmi else qma end, false from whole
  union all select cell_id, 52 * year + 41, qav, true from whole
  union all select cell_id, 52 * year + 54, case when lat >= 0 then qma else qmi end, false from whole where year = last_year
), sloped as (
  select *, case when mean then (lead(v) over w - lag(v) over w) / (lead(x) over w - lag(x) over w) else 0 end as m from anchor window w as (partition by cell_id order by x)
), piece as (
  select *, lead(x) over w as x1, lead(v) over w as v1, lead(m) over w as m1, row_number() over w = 1 as is_first from sloped window w as (partition by cell_id order by x)
), week as (
  select p.*, unnest(generate_series(case when is_first then 1 else x end, least(x1 - 1, 52 * (n.last_year + 1)))) as week from piece p join (select distinct cell_id, last_year from whole) n using (cell_id) where x1 is not null
)
select cell_id, week::int as week, round(greatest(0, (2 * t ** 3 - 3 * t ** 2 + 1) * v + (t ** 3 - 2 * t ** 2 + t) * h * m + (-2 * t ** 3 + 3 * t ** 2) * v1 + (t ** 3 - t ** 2) * h * m1), 6) as q
from (select *, (x1 - x)::double as h, (week - x)::double / (x1 - x) as t from week)
""",
    "weekly_axis": """
with y as (select year(min(ts)) as a, year(max(ts)) as b from results), f as (
  select make_date(a, 1, 1) + ((8 - isodow(make_date(a, 1, 1))) % 7)::int as first_monday, (b - a + 1) * 52 as n from y
) select k::int as week, strftime(first_monday + ((k - 1) * 7)::int, '%Y-%m-%d') as monday from f, generate_series(1, 100000) g(k) where k <= n
""",
    "asof_nearest": """
with p as (select event_id as purchase_id, user_id, ts from events where event_type = 'purchase'), s as (select event_id as signup_id, user_id, ts, value from events where event_type = 'signup'),
b as (
  select p.purchase_id, p.user_id, s.signup_id, s.value from p left join s on s.user_id = p.user_id and abs(epoch_us(s.ts) - epoch_us(p.ts)) <= 86400000000
  qualify row_number() over (partition by p.purchase_id order by abs(epoch_us(s.ts) - epoch_us(p.ts)), s.ts, s.signup_id) = 1
) select purchase_id, user_id, coalesce(signup_id, -1) as signup_id, value, signup_id is not null as paired from b
""",
    "gap_clusters": f"""
with o as ({_OBS}), f as (
  select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) > 30 * 86400000000 then 1 else 0 end as new from o window w as (partition by wqms_id, var order by ts, obs_id)
), c as (select *, (sum(new) over (partition by wqms_id, var order by ts, obs_id))::bigint + 1 as cluster from f), i as (
  select *, row_number() over (partition by wqms_id, var, cluster order by ts, obs_id) as in_cluster, count(*) over (partition by wqms_id, var, cluster) as n from c
) select obs_id, cluster, in_cluster, round(case when n > 1 then (in_cluster - 1) / (n - 1) - 0.5 else 0.0 end, 6) as "offset" from i
""",
    "every_nth": "select cell_id, ts from (select cell_id, ts, row_number() over (partition by cell_id order by ts) - 1 as k from (select distinct cell_id, ts from results where ts is not null)) where k % 4 = 0",
    "last_slice": """
with r as (select distinct * from results where ts is not null)
select result_id, cell_id, ts, round(ferrous_iron::double + ferric_iron::double, 6) as iron from r qualify ts = max(ts) over (partition by cell_id) and iron > 0 and not isnan(iron)
""",
    "next_time": "select cell_id, ts, lead(ts) over (partition by cell_id order by ts) as next_ts from (select distinct cell_id, ts from results where ts is not null)",
    "sampled_any": """
with t as (select ts, row_number() over (order by ts) - 1 as k, count(*) over () as n from (select distinct ts from results where ts is not null)),
picked as (select distinct t.ts from t, generate_series(0, 9) g(i) where t.k = floor(i * (n - 1) / 9))
select cell_id, bool_or(ph is not null and not isnan(ph)) as has_ph,
  bool_or(coalesce(case when not isnan(ferrous_iron) then ferrous_iron end, 0) + coalesce(case when not isnan(ferric_iron) then ferric_iron end, 0) > 0) as has_iron
from results semi join picked using (ts) group by cell_id
""",
    "finite_mask": """
select cell_id, bool_and(ph is not null and not isnan(ph) and ferrous_iron is not null and not isnan(ferrous_iron) and ferric_iron is not null and not isnan(ferric_iron)) as finite from results group by 1
""",
    "variable_stations": "select var, wqms_id from obs group by 1, 2 having bool_or(value is not null and not isnan(value))",
}
