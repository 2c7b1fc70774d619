"""Edits as a stream: each micro-batch of edits becomes one version of the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from slotloom.service import Engine, Outcome


def apply_edit_stream(engine: Engine, edits: DataFrame, checkpoint: str, now: datetime | None = None, once: bool = False) -> StreamingQuery:
    """Apply a stream of edits (id, content) to the engine's entries.

    As with any edit of many entries, the texts of the slots that a batch touches become revisions first.  The
    store's version holds the number of the stream's last batch (streams are told apart by their checkpoint),
    so a batch that runs again after it was applied changes nothing, not even times and revisions.  Where another
    writer was faster, the batch is applied to the newer state.
    """

    def apply(batch: DataFrame, number: int) -> None:
        while engine.store.state()["streams"].get(checkpoint, -1) < number and not batch.isEmpty():
            if engine.edit_all(batch.select("id", "content"), now or datetime.now(), {checkpoint: number}) is not Outcome.CONFLICT:
                return

    writer = edits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
