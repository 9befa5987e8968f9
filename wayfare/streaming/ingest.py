"""New venue files into the point table, with the vocabulary frozen at first ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wayfare.operators import curate
from wayfare.plans.ingest import points, rejects_of
from wayfare.sources import store
from wayfare.sources.files import write_rejects


def stream_points(
    venues: DataFrame,
    vocabulary: DataFrame,
    root: str,
    checkpoint: str,
    first_version: int = 1,
    analyzer: str = "char_wb",
    encoder=None,
    order: str = "ord",
    keys: tuple[str, ...] = ("name",),
    rejects: str | None = None,
    buckets: int = store.BUCKETS,
    **trigger,
) -> StreamingQuery:
    """Upsert each micro-batch into the buckets of its own points.

    Batch n is always number ``first_version + n`` of the table, so one that is replayed after a
    failure is finished or left as it is. Rows without a key go to ``rejects``
    (default: ``root`` with ``_rejects`` added), one folder per batch. ``keys`` are those of the
    batch ingest.
    """
    rejects = rejects or rejects_of(root)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        kept, bad = curate.dedup_keep_last(batch, keys, order)
        write_rejects(bad, f"{rejects}/batch={batch_id}", mode="overwrite")
        rows = points(kept.drop(order), vocabulary, analyzer, encoder)
        store.upsert(
            root, rows, version=first_version + batch_id, sort_by=["district", "id"], buckets=buckets
        )
        batch.unpersist()

    return (
        venues.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
