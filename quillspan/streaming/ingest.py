"""Continuous ingest: a stream of documents upserted by key, a commit at so many changes or so many seconds."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

MAX_CHANGES, MAX_SECONDS = 10_000, 5


def ingest(store: Store, stream: DataFrame, order: str, checkpoint: str, seconds: int = MAX_SECONDS, once: bool = False) -> StreamingQuery:
    """Upsert a stream into the store. ``order`` is the sequence column by which the last write of a key wins.

    A micro-batch is a commit: sources cap it by their own rate options (10,000 changes), the trigger by time. The batch id
    is kept beside the commit, so a batch that is run again after a failure changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = store.files.read("stream.json")
        if done is not None and int(done) >= batch_id:
            return
        if batch.limit(1).count():
            store.upsert(batch, order)
        store.files.write("stream.json", str(batch_id))

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{seconds} seconds")).start()


def wait_for(store: Store, token: str, seconds: float = 10.0) -> bool:
    """Wait until the store is as fresh as the token; False if it isn't in time."""
    end = time.monotonic() + seconds
    while not store.fresh(token):
        if time.monotonic() > end:
            return False
        time.sleep(0.1)
    return True
