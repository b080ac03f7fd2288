"""Weekly means and fault flags over a stream of readings."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.spikes import LIMITS, Limits


def weekly_means(readings: DataFrame, watermark: str = "60 days") -> DataFrame:
    """Mean and number of readings per station, variable and Monday-to-Sunday week of a stream.

    `readings` has wqms_id, var, ts TIMESTAMP, value. A week is given out once the watermark has passed its end; a
    reading that arrives later than that is left out. State holds one row per series and open week.
    """
    good = readings.filter(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    week = F.window("ts", "7 days", startTime="4 days")  # weeks from Monday: 1970-01-05 was one
    means = good.withWatermark("ts", watermark).groupBy(week.alias("w"), "wqms_id", "var").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return means.select("wqms_id", "var", F.date_format(F.date_sub(F.col("w.end").cast("date"), 1), "yyyy-MM-dd").alias("week_end"), "value", "n")


def new_faults(readings: DataFrame, limits: dict[str, Limits] = LIMITS) -> DataFrame:
    """Readings outside the physical limits as they arrive: obs_id, wqms_id, var, ts, value. Stateless."""
    outside = F.lit(False)
    for v, k in limits.items():
        outside = outside | ((F.col("var") == v) & ((F.col("value") < k.low) | (F.col("value") > k.high)))
    return readings.filter(F.col("ts").isNotNull() & ~F.isnan("value") & outside).select("obs_id", "wqms_id", "var", "ts", "value")
