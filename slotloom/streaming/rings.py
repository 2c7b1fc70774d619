"""Revision rings as a stateful stream: each slot's ring is keyed state that a log of candidates moves on.

A stream needs RocksDB as its store of states (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from slotloom.functions.text import is_blank, split_entries
from slotloom.plans.schema import DEFAULT, Registry

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "file_key string, position long, seq long, content string, saved_at long"


class _Ring(StatefulProcessor):
    """The newest revisions of a slot, newest first, with what tells their texts apart."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "seq long, content string, saved_at long, identity string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ring = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        before = list(ring)
        for r in sorted(rows, key=lambda r: r.seq):  # a batch's own order is any
            new = (r.seq, r.content, r.saved_at, r.identity)
            if not ring or ring[0][3] != new[3]:
                ring = [new, *ring][: self.limit]
        if ring != before:
            self.kept.put(ring)
            for position, (seq, content, saved_at, _) in enumerate(ring, 1):
                yield Row(file_key=key[0], position=position, seq=seq, content=content, saved_at=saved_at)

    def close(self) -> None:
        pass


def ring_stream(log: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """file_key, position, seq, content, saved_at: the whole ring of each slot that a batch of candidates has changed.

    ``log`` (file_key, seq, content, saved_at) is a stream whose batches follow one another by seq; within a batch
    rows may come in any order.  Blank texts and repeats of the newest text are skipped, as in ``revisions.ring``;
    a state holds no more than the ring.  The last ring of a slot is the one that counts (output mode update).
    """
    rows = log.where(~is_blank(F.col("content"))).select(
        F.col("file_key").cast("string").alias("file_key"), "seq", "content", "saved_at", F.sha2(F.array_join(split_entries(F.col("content")), "\x00"), 256).alias("identity")
    )
    return rows.groupBy("file_key").transformWithState(_Ring(registry.revision_limit), SCHEMA, "update", "none")


def write_rings(rings: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write what ``ring_stream`` gives, a folder for each batch; a batch that runs again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = rings.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_rings(spark: SparkSession, folder: str) -> DataFrame:
    """file_key, position, seq, content, saved_at: the last ring that was written for each slot."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(folder)
    last = rows.groupBy(F.col("file_key").alias("of")).agg(F.max("batch").alias("last"))
    return rows.join(last, (F.col("file_key") == F.col("of")) & (F.col("batch") == F.col("last"))).drop("of", "last", "batch")
