"""CSV, nested JSON, yearly folders, resumable collection, and long-form rasters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.grids import CELL_DEGREES

# fixed values: columns of a locality
LOCALITY = "array<struct<id: bigint, latitude: double, longitude: double, description_short: string, elements: string>>"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; NULL is empty, NaN is NaN."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def localities(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of `results` in JSON documents, with the columns of LOCALITY; missing fields are NULL."""
    rows = spark.read.schema(f"results {LOCALITY}").json(path)
    return rows.select(F.explode("results").alias("r")).select("r.*")


def write_by_year(df: DataFrame, ts: str, path: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet with one folder a year, so that a time slice reads only its years; a year of more rows has more files, by hash."""
    files = max(1, -(-df.count() // rows_per_file))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.withColumn("year", F.year(ts)).repartition("year", part).sortWithinPartitions(ts).write.mode("overwrite").partitionBy("year").parquet(path)


def resume(work: DataFrame, collect: Callable[[DataFrame], DataFrame], log: str, key: str) -> DataFrame:
    """Run `collect` over the rows of `work` whose `key` the table at `log` lacks, append the result, return the log.

    A rerun after a failure goes on where the last append ended; NULL keys are collected each time.
    """
    spark = work.sparkSession
    # whether the log is there is asked of its file system through Spark, not of the local disk
    try:
        done = spark.read.parquet(log)
        todo = work.join(done.select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = work
    collect(todo).write.mode("append").parquet(log)
    return spark.read.parquet(log)


def melt_grid(df: DataFrame, rows: str, value: str = "value") -> DataFrame:
    """A raster given as one row per grid line with an array of values, as long rows: row, col, value (NaN left out)."""
    cells = df.select(F.col("row"), F.posexplode(rows).alias("col", value))
    return cells.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def with_centres(grid: DataFrame, north: float = 90.0, west: float = -180.0, cell: float = CELL_DEGREES) -> DataFrame:
    """Adds the latitude and longitude of each cell's centre to rows with row and col."""
    return grid.withColumns({"lat": F.lit(north) - (F.col("row") + 0.5) * cell, "lon": F.lit(west) + (F.col("col") + 0.5) * cell})
