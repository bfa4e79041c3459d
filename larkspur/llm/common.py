"""Helpers that the operators share: table access, shared scratch tables, ASCII text rules."""

from __future__ import annotations

import weakref

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.scratch import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, as all contracts here define it: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Where each table that cut() wrote stands.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends, and a lost executor
    costs only the files' rereading."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path, partitionBy=partition_by or None)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            remove(df.sparkSession, path)


#: Rows that go to a Python worker at once, where the session hasn't set another number than Spark's default.
BATCH_ROWS = 1_000


def modest_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: with Spark's 10,000 rows a batch, the buffers on both sides of a Python worker take
    hundreds of megabytes. This sets the session's batch size, since a plan reads it when it runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(BATCH_ROWS))


#: Rows of a table of ids that are broadcast at most (about 20 MB with a digest each).
SMALL = 200_000


def sent(ids: DataFrame, n: int | None = None) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most SMALL rows, and else joined by shuffle."""
    return F.broadcast(ids) if (ids.count() if n is None else n) <= SMALL else ids


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def stored_place(df: DataFrame) -> Column:
    """Where a row stands in the written table that df reads, as a string: the number of the task that wrote its file, the
    file's number in that task, the row's number in the file. In the order of these strings the rows are as they were
    written. Null if df isn't read from files."""
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta)
    except AnalysisException:
        return F.lit(None).cast("string")
    file = meta["file_name"]
    pad = lambda c, n: F.lpad(F.coalesce(c, F.lit("")), n, "0")
    number = lambda pattern: F.regexp_extract(file, pattern, 1)
    return F.concat_ws("-", pad(number(r"^part-(\d+)"), 9), pad(number(r"-c(\d+)\."), 6), pad(meta["row_index"].cast("string"), 12))
