import datetime as dt
import json

from pyspark.sql import functions as F

from tarnflow.sources import files
from tarnflow.streaming import new_faults, weekly_means


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b,\"c\"", float("nan"), 3), (None, None, 4)], "k string, v double, n int")
    files.write_csv(df, str(tmp_path / "x"))
    back = files.read_csv(spark, str(tmp_path / "x"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_nested_localities(spark, tmp_path):
    doc = {"count": 2, "results": [{"id": 1, "latitude": 5.0, "elements": "Si", "other": 1}, {"id": 2, "description_short": "An old mine"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text('{"results": []}')
    got = files.localities(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["id"], r["elements"], r["description_short"]) for r in got] == [(1, "Si", None), (2, None, "An old mine")]


def test_resume_takes_only_what_is_left(spark, tmp_path):
    seen = []

    def collect(todo):
        seen.append(sorted(r[0] for r in todo.select("name").collect()))
        return todo.withColumn("n", F.length("name"))

    work = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "name string")
    files.resume(work.limit(2), collect, str(tmp_path / "log"), "name")
    log = files.resume(work, collect, str(tmp_path / "log"), "name")
    assert seen == [["a", "bb"], ["ccc"]] and {tuple(r) for r in log.collect()} == {("a", 1), ("bb", 2), ("ccc", 3)}


def test_years_and_grids(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1), (dt.datetime(2021, 1, 1), 2)], "ts timestamp_ntz, v int")
    files.write_by_year(df, "ts", str(tmp_path / "y"))
    r = spark.read.parquet(str(tmp_path / "y")).filter("year = 2021")
    assert [x["v"] for x in r.collect()] == [2] and "PartitionFilters: [isnotnull(year" in r._jdf.queryExecution().toString()
    g = spark.createDataFrame([(0, [1.0, None]), (1, [float("nan"), 4.0])], "row int, line array<double>")
    got = files.with_centres(files.melt_grid(g, "line"), cell=1.0).orderBy("row").collect()
    assert [(x["row"], x["col"], x["value"], x["lat"], x["lon"]) for x in got] == [(0, 0, 1.0, 89.5, -179.5), (1, 1, 4.0, 88.5, -178.5)]


def test_stream_of_files_closes_weeks_and_drops_the_late(spark, tmp_path):
    schema = "obs_id long, wqms_id string, var string, ts timestamp, value double"
    t = lambda *x: dt.datetime(*x, tzinfo=dt.timezone.utc)
    batches = [
        [(1, "s", "pH", t(2024, 1, 1), 7.0), (2, "s", "pH", t(2024, 1, 7, 23), 8.0), (3, "s", "pH", t(2024, 1, 8), 15.0), (4, "s", "pH", None, 7.0), (5, "s", "pH", t(2024, 1, 2), None)],
        [(6, "s", "pH", t(2024, 6, 1), 7.0)],
        [(10, "s", "pH", t(2024, 6, 1), 9.0)],  # rows are late by the watermark of the batch before
        [(7, "s", "pH", t(2024, 1, 3), 1.0), (8, "s", "Fe-Dis", t(2024, 6, 2), -5.0), (9, "s", "pH", t(2025, 6, 2), 7.0)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    for name, make in (("weeks", weekly_means), ("faults", new_faults)):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        make(source).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    weeks = {(r["var"], r["week_end"]): (r["value"], r["n"]) for r in spark.read.parquet(str(tmp_path / "weeks")).collect()}
    assert weeks[("pH", "2024-01-07")] == (7.5, 2) and weeks[("pH", "2024-01-14")] == (15.0, 1) and weeks[("Fe-Dis", "2024-06-02")] == (-5.0, 1)
    assert {r["obs_id"] for r in spark.read.parquet(str(tmp_path / "faults")).collect()} == {3, 8}


def test_microseconds_of_the_wall_clock_in_any_zone(spark):
    from tarnflow.sources.tables import micros

    ts = [dt.datetime(2024, 3, 31, 2, 30, 1, 5), dt.datetime(2024, 10, 27, 2, 30), dt.datetime(1950, 1, 1, 23, 59, 59, 999999), None]
    want = [None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in ts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, ts timestamp_ntz")
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.orderBy("i").select(micros("ts")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
