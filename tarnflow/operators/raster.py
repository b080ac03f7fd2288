"""Rasters in long form (row, col, value): clipping, merging, resampling, terrain slope, filling along the flow."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.hierarchy import accumulate, resolve
from tarnflow.session import materialise


def box(df: DataFrame, south: float, north: float, west: float, east: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows inside a box, edges included; between filters reach the parquet scan. West above east crosses the date line."""
    inside = F.col(lon).between(west, east) if west <= east else (F.col(lon) >= west) | (F.col(lon) <= east)
    return df.filter(F.col(lat).between(south, north) & inside)


def drop_empty_lines(grid: DataFrame, value: str) -> DataFrame:
    """Without grid rows, then columns, that hold no value (NULL or NaN); the values of the rest stay as they are."""
    good = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for axis in ("row", "col"):
        kept = grid.groupBy(axis).agg(F.bool_or(good).alias("_any")).filter("_any").select(axis)
        grid = grid.join(kept, axis, "left_semi")
    return grid


def between_matches(df: DataFrame, key: str, match: Column) -> DataFrame:
    """Rows whose `key` lies between those of the first and the last row for which `match` is true, as a range by position takes
    every row in between; none where nothing matches."""
    ends = df.filter(match).agg(F.min(key).alias("_a"), F.max(key).alias("_b"))  # one row
    return df.join(F.broadcast(ends)).filter(F.col(key).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def merge(a: DataFrame, b: DataFrame, on: list[str] = ["row", "col"]) -> DataFrame:  # noqa: B006
    """Both rasters on one grid, NULL where one has no cell."""
    return a.join(b, on, "full_outer")


def dense(grid: DataFrame, value: str) -> DataFrame:
    """Every cell of the rectangle that a raster spans, NULL where it has none; for rasters that fit their rectangle.

    Rows are made per grid line, so the work is the rectangle's size.
    """
    e = grid.agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("col").alias("c"), F.max("col").alias("d")).filter("a is not null")
    lines = e.select("c", "d", F.explode(F.sequence("a", "b")).alias("row"))
    cells = lines.repartition("row").select("row", F.explode(F.sequence("c", "d")).alias("col"))
    return cells.join(grid.select("row", "col", value), ["row", "col"], "left")


def coarsen(grid: DataFrame, value: str, factor: int) -> DataFrame:
    """Bilinear resampling to cells `factor` times as wide: row, col, value.

    A coarse cell is the mean of the fine ones within one coarse width of its centre, weighted by a tent in both axes;
    missing values are left out of the mean. Every fine cell goes to at most four coarse ones, summed on the map side.
    """
    centre = lambda c: (F.col(c) + 0.5) / factor - 0.5

    def near(c: str) -> list:
        low = F.floor(centre(c))
        return [F.struct((low + k).cast("int").alias("at"), (1 - F.abs(centre(c) - (low + k))).alias("w")) for k in (0, 1)]

    good = grid.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    spread = good.withColumn("_r", F.explode(F.array(*near("row")))).withColumn("_c", F.explode(F.array(*near("col"))))
    w = F.col("_r.w") * F.col("_c.w")
    out = spread.groupBy(F.col("_r.at").alias("row"), F.col("_c.at").alias("col")).agg(F.sum(w).alias("_w"), (F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias(value))
    # edge cells that only exist through their neighbours' tents are outside the raster
    edge = grid.agg(*(f(F.floor(F.col(c) / factor)).alias(n) for c, n, f in (("row", "r0", F.min), ("row", "r1", F.max), ("col", "c0", F.min), ("col", "c1", F.max))))
    return out.join(F.broadcast(edge)).filter("row between r0 and r1 and col between c0 and c1 and _w > 0").select("row", "col", value)  # one row


def terrain_slope(grid: DataFrame, value: str, cell_m: float) -> DataFrame:
    """Slope (rise over run) by Horn's weights of the eight neighbours: row, col, slope.

    Cells with a missing neighbour have none. Each cell gives its value to nine places; no join is needed.
    """
    shifts = F.array(*(F.struct((F.col("row") + r).alias("row"), (F.col("col") + k).alias("col"), F.lit(-r).alias("dr"), F.lit(-k).alias("dk")) for r in (-1, 0, 1) for k in (-1, 0, 1)))
    good = grid.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    around = good.select(F.col(value).cast("double").alias("v"), F.explode(shifts).alias("s")).select("v", "s.*")
    weight = lambda along, across: F.when(F.col(across) == 0, 2 * F.col(along)).otherwise(F.col(along))
    g = around.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * weight("dk", "dr")).alias("x"), F.sum(F.col("v") * weight("dr", "dk")).alias("y"))
    return g.filter("n = 9").select("row", "col", (F.hypot("x", "y") / (8 * cell_m)).alias("slope"))


def fill_downstream(links: DataFrame, values: DataFrame) -> DataFrame:
    """Fill gaps (NULL, NaN or 0) from upstream: node, value, filled.

    A gap takes the sum of the values that flow into it over gaps only, so that each value goes down to the next cell
    that has its own. Gaps that nothing reaches, or whose path runs on over gaps into a loop of gaps, stay NULL. The links
    into gaps form trees, over which `hierarchy.accumulate` sums: log2(longest gap) + 1 rounds.
    """
    own = F.when((F.col("value") != 0) & ~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    state = materialise(links.join(values.select("node", own.alias("own")), "node", "left"))
    gaps = state.filter("own is null").select(F.col("node").alias("parent"), F.lit(True).alias("_gap"))
    # a value is handed on along links into gaps, and goes no further than a cell with a value
    cut = state.join(gaps, "parent", "left").select("node", F.when(F.col("_gap"), F.col("parent")).alias("parent"), "own")
    tree = materialise(resolve(cut.select("node", "parent")).filter("depth >= 0").select("node"))
    total = accumulate(cut.select("node", "parent", F.col("own").alias("value")), tree).select("node", F.col("total").alias("sum"))
    out = state.select("node", "own").join(total, "node", "left")
    gap = F.col("own").isNull() & (F.coalesce("sum", F.lit(0.0)) != 0)
    return out.select("node", F.coalesce("own", F.when(gap, F.col("sum"))).alias("value"), gap.alias("filled"))


def adjacent_difference(grid: DataFrame, value: str) -> DataFrame:
    """Difference to the next row of the same column: row, col, step."""
    w = Window.partitionBy("col").orderBy("row")
    return grid.select("row", "col", (F.lead(value).over(w) - F.col(value)).alias("step"))


def mask(grid: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """A raster mask: the cells of `grid`, burnt 1 where `regions` has them, else 0."""
    hit = regions.select(*on).distinct().withColumn("_hit", F.lit(1))
    return grid.join(hit, on, "left").select(*on, F.coalesce("_hit", F.lit(0)).cast("tinyint").alias("mask"))
