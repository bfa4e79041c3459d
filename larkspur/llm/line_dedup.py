"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

Documents are taken in batches of ascending doc_id. A batch's line keys are reduced to one row per hash
with the smallest doc_id that holds it. The runs hold every hash seen so far, sorted and bucketed by
hash on disk: the batch is merge-anti-joined with each run, and what no run has becomes a new run at
level 0. When a level has FAN runs they are merged into one run of the next level, so a batch meets
O(FAN * log(batches)) runs. Runs have as many buckets as the session has shuffle partitions, so a batch
comes to the joins with the runs' own partitioning: no run is ever shuffled. While runs are joined or merged,
the order of their buckets (one file each) is trusted, so they aren't sorted again either; a merge is a full
merge join of runs that share no hash. BATCHES batches fill level 0 twice, at any size of the input.

A line stays if its (hash, doc_id) is an entry of a run, that is, if no earlier document holds the key. That
test joins on hash and doc_id together, so a line that a third of all documents share is spread over all
partitions. The hash is 128 bits (two XXH64 with different input); the bytes of equal hashes are not
compared: among 10^12 different lines two share a hash with a probability of about 10^-15.

Defined cases: a null or empty text is one empty line; a text of any length is split whole; keys under
MIN_CHARS code points always stay; a null doc_id counts as the smallest; repeated rows of one doc_id are one
document, and each row gives its own result; an empty table gives an empty result; extra columns, whatever
their names, don't matter; of lines with equal keys in one document all stay or none; doc_id must be a number or cast
to long (text ids stop the job). The runs are dropped, and their files deleted, before the result is returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.scratch import folder

from .common import ascii_lower, cut, drop, remove

MIN_CHARS = 10
#: Runs of one level that are merged into one of the next, and batches of documents.
FAN, BATCHES = 4, 9
#: The six ASCII white-space characters, stripped at both ends of a line.
STRIP = " \t\n\x0b\x0c\r"
_FIRST = -(2**63)


def line_key(line: Column) -> Column:
    """The line's comparison key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


@contextmanager
def trusted_order(spark: SparkSession) -> Iterator[None]:
    """Bucketed tables count as sorted if each bucket is one file (otherwise Spark sorts as usual)."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


class Runs:
    """Sorted runs of (h1, h2, owner), as bucketed tables in the session's catalog."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.tag = spark, f"line_run_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made: list[str] = []
        self.merges = 0
        self.levels: list[list[str]] = []

    def _path(self, name: str) -> str:
        return f"{folder(self.spark)}/{name}"

    def _write(self, df: DataFrame) -> str:
        name = f"{self.tag}_{len(self.made)}"
        self.made.append(name)
        sorted_ = df.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        with trusted_order(self.spark):
            sorted_.option("path", self._path(name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self._path(name))

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def anti(self, batch: DataFrame) -> DataFrame:
        """The batch's entries whose hash no run holds."""
        for name in self.names():
            batch = batch.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, new: DataFrame) -> None:
        """Store new entries as a run of level 0 and merge the levels that are full."""
        self._push(0, self._write(new))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= FAN:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                right = self.spark.table(other).withColumnRenamed("owner", "owner_").hint("merge")
                merged = merged.join(right, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "owner_").alias("owner"))
            name = self._write(merged)
            for old in full:
                self._drop(old)
            self.merges += 1
            self._push(level + 1, name)

    def entries(self) -> DataFrame:
        """All entries of all runs."""
        out = self.spark.table(self.names()[0])
        for name in self.names()[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def close(self) -> None:
        for name in self.made:
            self._drop(name)
        self.made, self.levels = [], []


def _owner(doc_id: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_FIRST))


def hashed_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, sig (the text's hash, apart for rows of one doc_id), pos (0-based), h1, h2 of every line whose key
    has at least min_chars code points."""
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)
    rows = df.select(_owner(doc_id).alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("sig"), F.posexplode(lines).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return rows.select("doc_id", "sig", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def dropped_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, min_chars: int = MIN_CHARS, runs: Runs | None = None) -> DataFrame:
    """doc_id, sig and the array `dropped` of 0-based line numbers that an earlier document holds. With `runs`, the lines
    that they hold count as earlier documents' too, this table's are added, and the runs stay for the next one; without,
    the call's own runs are dropped, whether it succeeds or not."""
    spark = df.sparkSession
    marks = df.select(F.percentile_approx(_owner(doc_id), [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = sum((F.when(F.col("doc_id") > m, 1).otherwise(0) for m in sorted(set(marks or []))), F.lit(0))
    rows = cut(hashed_lines(df, doc_id, text, min_chars).withColumn("batch", batch), "line-hashes", ["batch"])
    own = runs is None
    runs = Runs(spark) if runs is None else runs
    try:
        for k in range(len(set(marks or [])) + 1):
            first = rows.where(F.col("batch") == k).groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
            runs.add(runs.anti(first))
        lost = rows.join(runs.entries().withColumnRenamed("owner", "doc_id").hint("merge"), ["h1", "h2", "doc_id"], "left_anti")
        return cut(lost.groupBy("doc_id", "sig").agg(F.collect_set("pos").alias("dropped")), "line-dropped")
    finally:
        if own:
            runs.close()
        drop(rows)


def deduplicate_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, min_chars: int = MIN_CHARS, runs: Runs | None = None) -> DataFrame:
    """Per row of df: doc_id, text (the lines that stay), n_lines (before), n_dropped. A caller that passes `runs` on from
    table to table drops what earlier tables held, and closes them at the end."""
    lost = dropped_lines(df, doc_id, text, batches, min_chars, runs).withColumnsRenamed({"doc_id": "lost_id", "sig": "lost_sig"})
    text_ = F.col(f"`{text}`")
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(text_).alias("sig"), F.split(F.coalesce(text_, F.lit("")), "\n", -1).alias("lines"))
    docs = docs.join(lost, (_owner("doc_id") == F.col("lost_id")) & (F.col("sig") == F.col("lost_sig")), "left")
    n = F.size("lines")
    # array_except hashes its second argument, so this stays linear in the number of lines
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("dropped"))
    docs = docs.select("doc_id", "lines", n.cast("long").alias("n_lines"),
        F.coalesce(F.array_size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("dropped").isNotNull(), stay).alias("stay"))
    kept = F.when(F.col("stay").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n"))
    return docs.select("doc_id", kept.alias("text"), "n_lines", "n_dropped")
