"""Parquet tables of one data directory."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table `name` below `directory`, one file or a folder of parts."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def present(column: str | Column) -> Column:
    """True where a floating-point value is neither NULL nor NaN."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c)


def micros(column: str | Column) -> Column:
    """A TIMESTAMP or TIMESTAMP_NTZ as microseconds since 1970, by its wall clock.

    In a session zone other than UTC it is put together from date and time of day, which no change to summer time shifts.
    """
    c = F.col(column) if isinstance(column, str) else column
    spark = SparkSession.getActiveSession()
    if spark is None or spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        return F.unix_micros(c.cast("timestamp"))
    day = F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000
    return day + (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
