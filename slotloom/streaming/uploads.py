"""Uploads as a stream: text files that appear in a folder are appended to slots, each once and in order."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotloom.service import Engine, Outcome
from slotloom.sources.files import has_valid_extension


def upload_stream(spark: SparkSession, folder: str, slot_of: Callable[[Column], Column], files_at_once: int = 1_000) -> DataFrame:
    """file_key, name, content, place of .txt and .md files as they appear; ``slot_of`` makes a slot of a file's name.

    Files are read whole.  ``place`` is their modification time; files of one time follow by name.
    """
    path = F.col("_metadata.file_path")
    whole = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).load(folder)
    named = whole.select(F.element_at(F.split(path, "/"), -1).alias("name"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("place"))
    return named.where(has_valid_extension(F.col("name"))).select(slot_of(F.col("name")).alias("file_key"), "name", "content", "place")


def append_upload_stream(engine: Engine, uploads: DataFrame, checkpoint: str, now: datetime | None = None, once: bool = False) -> StreamingQuery:
    """Append a stream of uploads to the engine's slots, one state of the store for each micro-batch.

    The state holds the number of the stream's last batch, so a batch that runs again after it was applied changes
    nothing; where another writer was faster, the batch is tried again on the newer state.
    """

    def append(batch: DataFrame, number: int) -> None:
        while engine.store.state()["streams"].get(checkpoint, -1) < number and not batch.isEmpty():
            if engine.append_uploads(batch, now or datetime.now(), {checkpoint: number}) is not Outcome.CONFLICT:
                return

    writer = uploads.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
