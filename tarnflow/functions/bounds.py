"""Bounds that keep NULL, which `greatest` and `least` pass over."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(c: Column, low: float) -> Column:
    """c, or `low` where c is below it; NULL stays NULL."""
    return F.when(c < low, F.lit(low)).otherwise(c)


def at_most(c: Column, high: float) -> Column:
    """c, or `high` where c is above it; NULL stays NULL."""
    return F.when(c > high, F.lit(high)).otherwise(c)
