"""The batch resume and upsert of manifests as a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources.snapshots import SnapshotLog


def latest_by_key(stream: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key, as a complete-mode aggregate; of rows of one version the largest."""
    rest = [c for c in stream.columns if c not in key]
    return stream.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), *(c for c in rest if c != version))).alias("r")).select(*key, "r.*")


def upsert_stream(stream: DataFrame, log: SnapshotLog, checkpoint: str, name: str) -> StreamingQuery:
    """Each micro-batch becomes one commit of the log; one that is replayed after a failure is recognised by the stream's
    name and its number, and changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        log.commit(batch, f"{name}/{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
