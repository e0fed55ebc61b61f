"""Change feeds as streams: each micro-batch becomes one version of the projects it names.

The number of the last micro-batch is part of the store's commit, so a batch
that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbordelta.operators.changes import EqualityDeleteTable
from arbordelta.operators.mutate import plan_update
from arbordelta.sources.scratch import scratch_scope
from arbordelta.sources.storage import Conflict, Store


def apply_to_store(store: Store, batch: DataFrame, stream: str | None = None, number: int | None = None, tries: int = 5) -> DataFrame | None:
    """Applies one batch and commits; (project, version) of the projects it names, None if it was committed before."""
    batch = batch.persist()
    try:
        for attempt in range(tries):
            read = store.generation()
            if stream is not None and store.entry(read)["batches"].get(stream, -1) >= number:
                return None
            named = batch.select(store.bucket(F.col("project"), read).alias("b")).where("b is not null").distinct()
            buckets = [r["b"] for r in named.collect()]  # at most the store's number of buckets
            try:
                with scratch_scope():
                    update = plan_update(store.state(read, buckets), batch)
                    done = store.commit_update(read, update, buckets, (stream, number) if stream is not None else None)
            except Conflict:
                if attempt == tries - 1:
                    raise
                continue
            try:
                store.fold_contents()
            except Conflict:  # whoever was first may fold as well
                pass
            named = batch.select(F.col("project").alias("_p")).distinct()
            return store.table("projects", done).join(named, F.col("id") == F.col("_p")).select(F.col("id").alias("project"), F.col("latest_version").alias("version"))
    finally:
        batch.unpersist()


def start_ingest(changes: DataFrame, store: Store, checkpoint: str, stream: str = "updates", **trigger) -> StreamingQuery:
    """changes: a stream of (project, seq, path, mode, size, deleted, content)."""
    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: apply_to_store(store, batch, stream, number) and None)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def start_change_feed(requests: DataFrame, table: EqualityDeleteTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each micro-batch of a stream of requests to a table; a replayed one overwrites its own files."""
    return (
        requests.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: table.append(f"{number:012d}", batch))
        .trigger(**(trigger or {"availableNow": True})).start()
    )
