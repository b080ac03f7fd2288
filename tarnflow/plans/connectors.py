"""Queries through other formats and through a stream: each result has been written and read again."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.plans.series import plausible_obs
from tarnflow.session import shared_dir
from tarnflow.sources import files
from tarnflow.sources.tables import read_table
from tarnflow.streaming import weekly_means


def _place(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"files-{uuid.uuid4().hex}")


def stream_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly means by a stream over the readings; weeks come out as the watermark passes their end."""
    at = _place(spark)
    obs = plausible_obs(spark, d).select("wqms_id", "var", F.col("ts").cast("timestamp").alias("ts"), "value")
    # a mark a year after the last reading moves the watermark past all weeks
    mark = obs.agg(F.max("ts").alias("ts")).select(F.lit("").alias("wqms_id"), F.lit("").alias("var"), (F.col("ts") + F.expr("interval 366 days")).alias("ts"), F.lit(0.0).alias("value"))
    obs.unionByName(mark.filter("ts is not null")).write.parquet(f"{at}/in")
    out = weekly_means(spark.readStream.schema(obs.schema).parquet(f"{at}/in"))
    query = out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    query.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    weeks = spark.read.schema(out.schema).parquet(f"{at}/out").filter("var <> ''")
    return weeks.select("wqms_id", "var", "week_end", F.round("value", 6).alias("value"), "n")


def csv_stations(spark: SparkSession, d: str) -> DataFrame:
    """Stations through CSV."""
    at = _place(spark)
    s = read_table(spark, d, "stations").distinct()
    files.write_csv(s, at)
    back = files.read_csv(spark, at, s.schema)
    return back.select("wqms_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).filter("lat is not null and not isnan(lat)").distinct()


def json_localities(spark: SparkSession, d: str) -> DataFrame:
    """Localities nested in JSON documents of one region and about a thousand entries, unfolded again and filtered by their elements."""
    at = _place(spark)
    p = read_table(spark, d, "part")
    part = F.pmod(F.xxhash64("p_partkey"), F.lit(max(1, -(-p.count() // 1000))))
    nested = p.groupBy(F.col("p_brand").alias("region"), part.alias("part")).agg(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("description_short"), F.col("p_type").alias("elements"))).alias("results"))
    nested.write.json(at)
    return files.localities(spark, at).filter(F.col("elements").rlike("(E|S)")).select("id", "elements")


def yearly_results(spark: SparkSession, d: str) -> DataFrame:
    """Model rows by year through a folder a year; a filter on the year reads only its folders."""
    at = _place(spark)
    files.write_by_year(read_table(spark, d, "results").filter("ts is not null"), "ts", at)
    r = spark.read.parquet(at)
    last = r.agg(F.max("year")).first()[0]
    return r.filter(F.col("year") == last).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


def resumed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Readings per station, collected in two runs of which the second takes only what the first has not logged."""
    at = _place(spark)
    work = read_table(spark, d, "stations").select(F.col("wqms_id").alias("name")).distinct()
    counts = read_table(spark, d, "obs").groupBy(F.col("wqms_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    collect = lambda todo: todo.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    files.resume(work.filter(F.col("name").startswith("KELD")), collect, at, "name")
    return files.resume(work, collect, at, "name")


QUERIES = {"stream_weekly": stream_weekly, "csv_stations": csv_stations, "json_localities": json_localities, "yearly_results": yearly_results, "resumed_counts": resumed_counts}

SQL = {
    "stream_weekly": """
with o as (select distinct obs_id, wqms_id, ts, var, value from obs where ts is not null and value between 0 and case when var = 'pH' then 14 else 1e9 end)
select wqms_id, var, strftime(date_trunc('week', ts) + interval 6 day, '%Y-%m-%d') as week_end, round(avg(value), 6) as value, count(*) as n from o group by 1, 2, 3
""",
    "csv_stations": "select distinct wqms_id, round(lat, 6) as lat, round(lon, 6) as lon from stations where lat is not null and lat::varchar <> 'nan'",
    "json_localities": "select p_partkey as id, p_type as elements from part where regexp_matches(p_type, '(E|S)')",
    "yearly_results": "select cell_id, count(*) as n from results where year(ts) = (select max(year(ts)) from results) group by 1",
    "resumed_counts": "select s.wqms_id as name, coalesce(o.n, 0) as n from (select distinct wqms_id from stations) s left join (select wqms_id, count(*) as n from obs group by 1) o using (wqms_id)",
}
