"""Ordered chunks of a tree for bulk transfer.

Objects follow one another in path order (bytes of the path); a chunk ends with
the object that takes its size above the limit.  This is a fold, but not one that
needs a project in one task.  Rows are range-partitioned by (project, path)
into segments.  Whatever size a segment starts with, after its first chunk end
it goes on from zero, so a segment is a small step function from the size it
starts with to the size and the chunk number it ends with; its steps are
computed backwards, one for each row that can be the first chunk end.  Only
these functions are chained, per project, and then each segment is folded on
its own with the start it was given.

Packs that aren't cached are sent alone at their place; they have no chunk and
count for nothing.  What is in a chunk counts with the bytes of its path, a file
with those of its content, too, and a cached pack with those of its hash.  A
segment has about SEGMENT_ROWS rows, whatever the number of rows is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordelta.functions.paths import is_dir, is_link
from arbordelta.operators.cache import with_cached
from arbordelta.operators.packs import Member, encode_pack
from arbordelta.operators.reads import ObjectQuery, with_content
from arbordelta.operators.temporal import diff
from arbordelta.sources.scratch import written

#: Fixed value: a chunk ends once it holds more.
TARGET_BYTES = 524288
SEGMENT_ROWS = 1 << 20


def accounted(path: Column, mode: Column, content_bytes: Column, deleted: Column) -> Column:
    """What one object adds to its chunk: its path, and its content unless it is a directory, a symlink or a tombstone."""
    bare = is_dir(mode) | is_link(mode) | deleted
    return (F.octet_length(path) + F.when(bare, F.lit(0)).otherwise(F.coalesce(content_bytes, F.lit(0)))).cast("long")


def step_function(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(floor, end, chunks): from a start above floor[i] (and no higher one), the end size and the chunks ended.

    floor begins with -1 and ascends.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    stop = np.searchsorted(total, total[:n] + limit, "right")  # rows [i, stop) are the chunk that begins at i
    end, chunks = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
    end[n], chunks[n] = 0, 0
    for i in range(n - 1, -1, -1):
        if stop[i] > n:
            end[i], chunks[i] = total[n] - total[i], 0
        else:
            end[i], chunks[i] = end[stop[i]], chunks[stop[i]] + 1
    firsts = np.flatnonzero(sizes > 0) + 1  # prefixes whose size differs from the one before
    firsts = firsts[: int(np.searchsorted(total[firsts], limit, "right")) + 1]
    floor = np.maximum(limit - total[firsts], -1)[::-1]
    ends, ns = end[firsts][::-1], (chunks[firsts] + 1)[::-1]
    if not len(floor) or floor[0] > -1:  # starts too small to end a chunk here keep growing
        return np.concatenate([[-1], floor]), np.concatenate([[-1], ends]), np.concatenate([[0], ns])
    return floor, ends, ns


def apply_step(floor, end, chunks, total: int, start: int) -> tuple[int, int]:
    k = int(np.searchsorted(floor, start, "left")) - 1
    return (start + total, 0) if end[k] < 0 else (int(end[k]), int(chunks[k]))


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole runs of equal keys of a sorted partition, as arrays by column."""
    held: list[dict[str, np.ndarray]] = []
    for frame in frames:
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        turn = np.zeros(max(len(frame) - 1, 0), bool)
        for k in keys:
            turn |= columns[k][1:] != columns[k][:-1]
        bounds = [0, *(np.flatnonzero(turn) + 1).tolist(), len(frame)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            part = {c: x[a:b] for c, x in columns.items()}
            if held and any(held[0][k][0] != part[k][0] for k in keys):
                yield {c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in columns}
                held = []
            held.append(part)
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _frames(rows: Iterator[tuple], columns: list[str], at_once: int = 1000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def tar_chunks(rows: DataFrame, limit: int = TARGET_BYTES, segments: int | None = None) -> DataFrame:
    """rows (project, path, alone, bytes) with `chunk` and `bytes_so_far`, both null where `alone`.

    Rows with equal project and path are in no defined order among themselves.
    """
    placed = written(rows.select(F.coalesce("project", F.lit(-1)).cast("long").alias("project"), "path", "alone", F.col("bytes").cast("long").alias("bytes")), "rows")
    if segments is None:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        segments = max(cores, -(-placed.count() // SEGMENT_ROWS))  # the count is in the table's footers
    placed = placed.repartitionByRange(segments, "project", "path", "bytes").withColumn("segment", F.spark_partition_id().cast("long"))
    placed = written(placed, "segments")

    def functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (
            (int(run["segment"][0]), int(run["project"][0]), int(run["bytes"].sum()), *(x.tolist() for x in step_function(run["bytes"], limit)))
            for run in _runs(frames, ["segment", "project"]))
        yield from _frames(rows, ["segment", "project", "total", "floor", "ends", "chunks"])

    counted = placed.where(~F.col("alone"))
    order = ["segment", "project", "path", "bytes"]
    steps = counted.select("segment", "project", "path", "bytes").repartition("segment").sortWithinPartitions(*order).select("segment", "project", "bytes").mapInPandas(
        functions, "segment long, project long, total long, floor array<long>, ends array<long>, chunks array<long>")

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, size, chunk = None, 0, 0
        for frame in frames:
            out = []
            for s in frame.itertuples():
                if s.project != project:
                    project, size, chunk = s.project, 0, 0
                out.append((s.segment, s.project, size, chunk))
                size, ended = apply_step(np.asarray(s.floor), s.ends, s.chunks, s.total, size)
                chunk += ended
            yield pd.DataFrame(out, columns=["segment", "project", "start", "first"])

    starts = steps.repartition("project").sortWithinPartitions("project", "segment").mapInPandas(chain, "segment long, project long, start long, first long")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, size, chunk = None, 0, 0
        for frame in frames:
            chunks, so_far = [], []
            for segment, project, n, start, first in zip(*(frame[c].tolist() for c in ("segment", "project", "bytes", "start", "first"))):
                if key != (segment, project):
                    key, size, chunk = (segment, project), start, first
                size += n
                chunks.append(chunk)
                so_far.append(size)
                if size > limit:
                    size, chunk = 0, chunk + 1
            yield frame[["project", "path"]].assign(chunk=chunks, bytes_so_far=so_far)

    folded = counted.select(order).join(starts, ["segment", "project"]).select(*order, "start", "first").repartition("segment").sortWithinPartitions(*order).mapInPandas(
        fold, "project long, path string, chunk long, bytes_so_far long")
    alone = placed.where("alone").select("project", "path", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("bytes_so_far"))
    return folded.select("project", "path", "chunk", "bytes_so_far", F.lit(None).cast("string").alias("pack_path")).unionByName(alone.withColumn("pack_path", F.col("path")))


def get_tars(
    objects: DataFrame, contents: DataFrame, cache_versions: DataFrame, query: ObjectQuery, start: int, to: int,
    cached: list[int] | None = None, compat_tombstones: bool = False, limit: int = TARGET_BYTES,
) -> DataFrame:
    """(project, chunk, pack_path, bytes): TARs that lead from `start` to `to`.

    A pack that none of the `cached` versions names is sent as it is, with its
    pack_path and no chunk; a named one is an entry that holds its hash.  A removed
    pack has its pack_path, too, and no bytes: whoever writes it removes the directory.  With
    compat_tombstones, tombstones are sent whatever path the query asks for.
    """
    if compat_tombstones and start:
        changes = diff(objects, start, to)
        changes = changes.where(F.col("deleted") | query.path_filter())
    else:
        changes = diff(objects, start, to, query.path_filter())
    rows = with_cached(changes, cache_versions, cached or [])
    rows = rows.withColumn("is_cached", F.col("is_cached") & F.col("packed") & ~F.col("deleted")).withColumn("alone", F.col("packed") & ~F.col("is_cached"))
    needed = rows.withColumn("_hash", F.col("hash")).withColumn("hash", F.when(~F.col("deleted") & ~F.col("is_cached"), F.col("hash")))
    full = with_content(needed, contents).withColumn("hash", F.col("_hash")).drop("_hash")
    # The fold sees paths and lengths only; contents are joined to their chunks afterwards.
    lengths = contents.select(F.col("hash").alias("_h"), F.octet_length("bytes").alias("_n"))
    measured = rows.join(lengths, F.col("hash") == F.col("_h"), "left")
    size = F.when(F.col("is_cached"), F.lit(32)).otherwise(F.col("_n"))
    placed = tar_chunks(measured.select("project", "path", "alone", accounted(F.col("path"), F.col("mode"), size, F.col("deleted")).alias("bytes")), limit)
    in_chunks = full.where(~F.col("alone")).join(placed.where("pack_path is null").select("project", "path", "chunk").distinct(), ["project", "path"])
    whole = full.where("alone").select("project", F.lit(None).cast("long").alias("chunk"), F.col("path").alias("pack_path"), F.col("content").alias("bytes"))
    return tar_bytes(in_chunks).select("project", "chunk", F.lit(None).cast("string").alias("pack_path"), "bytes").unionByName(whole)


def tar_bytes(objects: DataFrame) -> DataFrame:
    """(project, chunk, path, mode, size, deleted, is_cached, hash, content) to (project, chunk, bytes), one TAR for each chunk."""

    columns = ["path", "mode", "size", "deleted", "content", "is_cached"]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tars = ((int(run["project"][0]), int(run["chunk"][0]), encode_pack(Member(*r) for r in zip(*(run[c] for c in columns)))) for run in _runs(frames, ["project", "chunk"]))
        yield from _frames(tars, ["project", "chunk", "bytes"], at_once=16)

    none = F.lit(0).cast("long")
    objects = objects.where(F.col("path").isNotNull()).select(
        "project", "chunk", "path", F.coalesce("mode", none).alias("mode"), F.coalesce("size", none).alias("size"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
        F.when(F.col("is_cached"), F.unhex("hash")).otherwise(F.col("content")).alias("content"), F.coalesce("is_cached", F.lit(False)).alias("is_cached"))
    sorted_ = objects.where("project is not null and chunk is not null").repartition("project", "chunk").sortWithinPartitions("project", "chunk", "path")
    return sorted_.mapInPandas(write, "project long, chunk long, bytes binary")
