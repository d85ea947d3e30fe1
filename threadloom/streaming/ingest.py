"""Streaming ingest: micro-batches of messages into the store, each id once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators import ingest
from threadloom.sources.checkpoint import checkpointed
from threadloom.sources.model import Store


def ingest_batch(store: Store, batch: DataFrame) -> None:
    """Persist one micro-batch: new rows are appended, messages and conversations in one commit.

    Of the stored messages only ids and numbers are read. A batch that comes
    again, also after a restart, adds nothing.
    """
    known = store.read("messages").select("id", "conversation_id", "sequence_number")
    new = checkpointed(ingest.persist_messages(known, batch))
    conversations = checkpointed(ingest.ensure_conversations(store.read("conversations"), batch))
    more = {name: df for name, df in (("messages", new), ("conversations", conversations)) if not df.isEmpty()}
    if more:
        store.commit(more=more)


def ingest_stream(store: Store, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start ingest of a stream with the columns of ``persist_messages``."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: ingest_batch(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
