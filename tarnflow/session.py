"""Session settings and the shared folder where lineage is cut."""
from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest table, by the summed sizes of its values, that `small_side` broadcasts.
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "tarnflow", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session it gives.

    Python workers find this package wherever the driver was started.
    """
    root, paths = str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share: the session's own, else (local runs) a new one."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if at is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Lineage ends there, an executor's loss costs nothing that was written, and the planner knows the
    table's true size. `release` deletes what no later step reads.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialise` wrote; nothing that is still to run may read them. Other tables are left alone."""
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path is not None:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _bytes(field: T.StructField) -> Column:
    c, kind = F.col(field.name), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        held = F.octet_length(c)
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        held = F.size(c) * 8
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        held = F.octet_length(F.to_json(c)) * 2
    else:
        return F.lit(8)
    return F.coalesce(held, F.lit(0)) + 24


def table_bytes(df: DataFrame) -> int:
    """What the values of `df` take in memory, about: lengths of strings and arrays are summed up, not guessed."""
    width = sum((_bytes(f) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(width.cast("bigint"))).first()[0] or 0


def small_side(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, which should already be a materialised table, marked for broadcast only if its values are small.

    Beyond the limit `df` comes back unmarked and the join shuffles.
    """
    return F.broadcast(df) if table_bytes(df) <= limit_bytes else df
