"""Weekly series, nearest as-of joins, splines and gap clusters over keyed time series."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators import raster
from tarnflow.operators.lanes import BIN_ROWS, lagged_over, ranges, running_over
from tarnflow.session import materialise
from tarnflow.sources.tables import micros

DAY_US = 86_400_000_000


def week_end(ts: str | Column) -> Column:
    """The Sunday that ends the Monday-to-Sunday week of a time, as DATE."""
    return F.date_add(F.date_trunc("week", F.col(ts) if isinstance(ts, str) else ts).cast("date"), 6)


def weekly_mean(df: DataFrame, keys: list[str], ts: str, value: str, dense: bool = True) -> DataFrame:
    """Mean of `value` per week: keys, week_end, value, n; with `dense` empty weeks between a key's first and last too.

    NULL and NaN values do not count towards the mean, but their rows span weeks. Rows without ts are left out.
    Means are combined on the map side, so a hot key costs one row per week and task.
    """
    good = F.when(~F.isnan(value), F.col(value))
    weeks = df.filter(F.col(ts).isNotNull()).groupBy(*keys, week_end(ts).alias("week_end")).agg(F.avg(good).alias("value"), F.count(good).alias("n"))
    if not dense:
        return weeks
    after = F.lead("week_end").over(Window.partitionBy(*keys).orderBy("week_end"))
    filled = weeks.withColumn("_next", F.coalesce(F.date_sub(after, 7), F.col("week_end")))
    filled = filled.select("*", F.explode(F.expr("sequence(week_end, _next, interval 7 days)")).alias("_week"))
    own = F.col("_week") == F.col("week_end")
    return filled.select(*keys, F.col("_week").alias("week_end"), F.when(own, F.col("value")).alias("value"), F.when(own, F.col("n")).otherwise(0).alias("n"))


def nearest_week_end(ts: Column) -> Column:
    """The Sunday (midnight) nearest to a time, the earlier one in a tie.

    On a dense weekly series the nearest row, empty or not, is the one with this label, so a nearest as-of join with
    such a series is an equi-join.
    """
    us = micros(ts)
    week = F.floor((us - F.lit(3 * DAY_US)) / F.lit(7.0 * DAY_US))  # 1970-01-04 was a Sunday
    rest = us - F.lit(3 * DAY_US) - week * F.lit(7 * DAY_US)
    return F.date_add(F.lit("1970-01-04").cast("date"), (7 * (week + F.when(rest > 7 * DAY_US // 2, 1).otherwise(0))).cast("int"))


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], tolerance_us: int, values: list[str], ids: list[str]) -> DataFrame:
    """The nearest right row in time per left row, `values` NULL where none lies within the tolerance.

    Both have `by` and `t` (BIGINT microseconds); `ids` name the left columns that make its rows distinct. The nearest
    row counts even where its values are NULL; ties go to the earlier row, then the smaller values. Time is cut into
    buckets as wide as the tolerance and right rows go to three, so the join is an equi-join. It suits right sides
    with few rows per tolerance; dense ones belong to `nearest.nearest_in_time`.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(tolerance_us)))
    r = right.select(*by, F.col("t").alias("_rt"), *(F.col(v).alias(f"_{v}") for v in values)).withColumn("_b", F.explode(F.array(*(bucket("_rt") + k for k in (-1, 0, 1)))))
    joined = left.withColumn("_b", bucket("t")).join(r, [*by, "_b"], "left")
    near = F.abs(F.col("_rt") - F.col("t"))
    order = F.when(near <= tolerance_us, F.struct(near, F.col("_rt"), *(F.col(f"_{v}") for v in values)))
    best = joined.groupBy(*by, *ids, "t").agg(F.min(order).alias("_m"))
    return best.select(*by, *ids, "t", F.col("_m._rt").alias("t_right"), *(F.col(f"_m._{v}").alias(v) for v in values))


def seasonal_weeks(annual: DataFrame, keys: list[str], lat: str) -> DataFrame:
    """Weekly values by a cubic Hermite spline through seasonal anchors: keys, week (1..52 n), q.

    `annual` has keys, the latitude column, `year` (0, 1, ... without gaps per key), qav, qmi, qma. Anchors lie at weeks
    2, 15, 28 and 41 of each year; north of the equator they hold maximum, mean, minimum, mean, south of it minimum,
    mean, maximum, mean, and a last anchor repeats the last year's first. Slopes are 0 at extremes and centred
    differences at means. Week 1 comes from the first cubic; values are cut at 0. Keys with a NULL or NaN in any year
    have no rows.
    """
    north = F.col(lat) >= 0
    high, low = F.when(north, F.col("qma")).otherwise(F.col("qmi")), F.when(north, F.col("qmi")).otherwise(F.col("qma"))
    good = F.bool_and(F.col("qav").isNotNull() & F.col("qmi").isNotNull() & F.col("qma").isNotNull() & ~F.isnan("qav") & ~F.isnan("qmi") & ~F.isnan("qma"))
    whole = Window.partitionBy(*keys)
    rows = annual.withColumn("_ok", good.over(whole)).filter("_ok").withColumn("_last", F.max("year").over(whole))
    at = lambda week, y, kind: F.struct((F.col("year") * 52 + week).cast("double").alias("x"), y.cast("double").alias("y"), F.lit(kind).alias("mean"))
    wrap = F.when(F.col("year") == F.col("_last"), F.array(at(54, high, False))).otherwise(F.array().cast("array<struct<x:double,y:double,mean:boolean>>"))
    anchors = F.concat(F.array(at(2, high, False), at(15, F.col("qav"), True), at(28, low, False), at(41, F.col("qav"), True)), wrap)
    a = rows.select(*keys, F.explode(anchors).alias("a")).select(*keys, "a.*")
    along = Window.partitionBy(*keys).orderBy("x")
    slope = F.when(F.col("mean"), (F.lead("y").over(along) - F.lag("y").over(along)) / (F.lead("x").over(along) - F.lag("x").over(along))).otherwise(0.0)
    a = a.withColumn("m", slope).withColumns({"x1": F.lead("x").over(along), "y1": F.lead("y").over(along), "m1": F.lead("m").over(along), "_first": F.row_number().over(along) == 1, "_end": F.max("x").over(Window.partitionBy(*keys)) - 2})
    a = a.filter("x1 is not null")
    first = F.when(F.col("_first"), F.lit(1.0)).otherwise(F.col("x"))
    # a cubic serves its weeks up to the next anchor; the last one ends with the year
    a = a.withColumn("week", F.explode(F.sequence(first.cast("int"), F.least(F.col("x1") - 1, F.col("_end")).cast("int"))))
    h, t = F.col("x1") - F.col("x"), (F.col("week") - F.col("x")) / (F.col("x1") - F.col("x"))
    q = (2 * t**3 - 3 * t**2 + 1) * F.col("y") + (t**3 - 2 * t**2 + t) * h * F.col("m") + (-2 * t**3 + 3 * t**2) * F.col("y1") + (t**3 - t**2) * h * F.col("m1")
    return a.select(*keys, "week", F.greatest(q, F.lit(0.0)).alias("q"))


def prepare_flow(qav: DataFrame, qmi: DataFrame, qma: DataFrame, box: tuple[float, float, float, float], years: tuple[int, int], calendar: DataFrame) -> DataFrame:
    """Weekly flow from yearly rasters of mean, least and greatest flow: row, col, week, q.

    Each raster has row, col, lat, lon, year (from 0) and its value; `calendar` tells the calendar year of a row, col and
    year. In turn: cut to the box and the years, merge the three, leave out grid lines without a value, then the seasonal
    spline (`seasonal_weeks`) per cell.
    """
    on = ["row", "col", "lat", "lon", "year"]
    kept = calendar.filter(F.col("calendar").between(*years)).select("row", "col", "year").distinct()
    merged = raster.merge(raster.merge(*(raster.box(x, *box) for x in (qav, qmi)), on), raster.box(qma, *box), on).join(kept, ["row", "col", "year"], "left_semi")
    return seasonal_weeks(raster.drop_empty_lines(merged, "qav"), ["row", "col"], "lat").select("row", "col", "week", "q")


def gap_clusters(df: DataFrame, keys: list[str], ts: str, gap_us: int, tie: str, rows_per_task: int = BIN_ROWS) -> DataFrame:
    """Number each key's rows by clusters parted by more than `gap_us`, and spread them in -0.5..0.5 inside each.

    Adds cluster (1, 2, ...), in_cluster (1, 2, ...), offset (0 alone in its cluster). Ties in time follow `tie`, which
    should differ between rows of one time. Keys of more than `rows_per_task` rows are counted over ranges of rows
    (`lanes.running_over`), the others in a window each; both give the same.
    """
    hot = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task).select(*keys))
    t, added = micros(ts), ["cluster", "in_cluster", "offset"]
    spread = lambda k, n: F.when(n > 1, (k - 1) / (n - 1) - 0.5).otherwise(0.0)
    along = Window.partitionBy(*keys).orderBy(ts, tie)
    inside = Window.partitionBy(*keys, "cluster")
    short = df.join(hot, keys, "left_anti").withColumn("_new", F.when(t - F.lag(t).over(along) > gap_us, 1).otherwise(0))
    short = short.withColumn("cluster", F.sum("_new").over(along) + 1)
    k, n = F.row_number().over(inside.orderBy(ts, tie)), F.count(F.lit(1)).over(inside)
    short = short.withColumns({"in_cluster": k.cast("bigint"), "offset": spread(k, n)}).select(*df.columns, *added)
    if hot.isEmpty():
        return short
    order = ["_us", tie]
    rows = ranges(materialise(df.join(hot, keys).withColumn("_us", t)), keys, order, rows_per_task)
    rows = lagged_over(rows, keys, order, "_us", "_last")
    new = F.coalesce((F.col("_us") - F.col("_last") > gap_us).cast("int"), F.lit(0))
    rows = running_over(materialise(rows.withColumn("_new", new).drop("_last")), keys, order, "_new", "_before")
    rows = materialise(running_over(rows.withColumn("cluster", F.col("_before") + F.col("_new") + 1).drop("_before", "_new"), keys, order, F.lit(1), "_rank"))
    sizes = rows.groupBy(*keys, "cluster").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    k, n = F.col("_rank") - F.col("_first") + 1, F.col("_n")
    return short.unionByName(rows.join(sizes, [*keys, "cluster"]).withColumns({"in_cluster": k, "offset": spread(k, n)}).select(*df.columns, *added))
