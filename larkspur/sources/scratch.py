"""A folder of the application's own under spark.checkpoint.dir, for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_LOCAL: dict[str, str] = {}
_ENDING: set[str] = set()
#: Where each table that cut() wrote stands.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The folder, which the driver and all executors share; it is deleted when the driver ends. Where
    spark.checkpoint.dir is unset, a single-machine session (master local) gets a temporary folder; on a cluster
    it is an error."""
    app, shared = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="larkspur-"))
    path = f"{shared.rstrip('/')}/larkspur/{app}"
    if path not in _ENDING:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _ENDING.add(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: what several branches of a plan use is computed once, and a lost
    executor costs only the files' rereading."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    if path := _PATHS.pop(table, None):
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a table that is broadcast at most.
SMALL = 100_000


def sent(table: DataFrame, limit: int = SMALL) -> DataFrame:
    """The table, written, for a join: broadcast if it has at most `limit` rows, else left to Spark."""
    table = cut(table, "side")
    return broadcast(table) if table.limit(limit + 1).count() <= limit else table


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
