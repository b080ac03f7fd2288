from pyspark.sql import functions as F

from tarnflow import session


def test_sizes_are_those_of_the_values(spark):
    df = session.materialise(spark.range(2000).select("id", F.array_repeat("id", 2000).alias("places")))
    assert session.table_bytes(df) > 2000 * 2000 * 8
    assert "broadcast" not in session.small_side(df, 1 << 20)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in session.small_side(df.select("id"), 1 << 20)._jdf.queryExecution().logical().toString().lower()
    wide = spark.createDataFrame([("x" * 10_000, None)], "a string, b struct<c: string>")
    assert 10_000 < session.table_bytes(wide) < 11_000 and session.table_bytes(wide.limit(0)) == 0


def test_released_tables_are_gone(spark, tmp_path):
    import os

    df = session.materialise(spark.range(5))
    path = session._WRITTEN[df]
    assert df.count() == 5 and os.path.exists(path.removeprefix("file:"))
    session.release(df, spark.range(3))
    assert not os.path.exists(path.removeprefix("file:"))
