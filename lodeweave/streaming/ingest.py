"""Micro-batch ingest: upserts and orphan tracking driven by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeweave.operators.graph import Graph
from lodeweave.operators.merge import merged_stamps, stamped
from lodeweave.operators.orphans import OrphanStore
from lodeweave.operators.store import SnapshotStore


def upsert_stream(source: DataFrame, store: SnapshotStore, label: str, assigns: dict, seq: list[str], checkpoint: str) -> StreamingQuery:
    """Fold every micro-batch of operations and write it over the label's nodes as a new version.

    A store below the store keeps of every property when it was assigned, so that an operation that arrives late,
    in whichever batch, never overwrites a later one, and a batch delivered again changes nothing. Only this
    label is written.
    """
    stamps = SnapshotStore(store.spark, f"{store.path}/stamps")

    def apply(batch: DataFrame, batch_id: int) -> None:
        held = stamps.read().nodes
        new = stamped(batch, ["id"], seq, assigns)
        stamps.update(Graph({label: merged_stamps(held[label], new, ["id"]) if label in held else new}, {}))
        kept = stamps.read().nodes[label]
        store.update(Graph({label: kept.select("id", *[F.col(f"{p}.value").alias(p) for p in assigns])}, {}))

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def track_orphans(source: DataFrame, store: OrphanStore, on_change: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Advance the orphan store by every micro-batch of events and hand on what changed.

    The store remembers the batch it holds: after a restart a batch delivered again changes nothing, and
    none is lost, wherever the last run stopped.
    """
    return source.writeStream.foreachBatch(lambda batch, batch_id: on_change(store.advance(batch, batch_id), batch_id)).option("checkpointLocation", checkpoint).start()
