"""Interval-versioned objects: state at a version, change between two versions.

An object row is live in [start_version, stop_version).  All operators work on
all projects at once and take versions as numbers or as columns; a filter on
project prunes before anything else.  Rows with start_version 0 are never
visible, as `from` is at least 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordelta.functions.paths import covering_keys
from arbordelta.schema import ZERO_HASH

Version = int | Column


def _col(v: Version) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("long")


def live_in_range(start: Version, to: Version) -> Column:
    """Became live after `start`, and is live at `to`."""
    start, to = _col(start), _col(to)
    stop = F.col("stop_version")
    return (F.col("start_version") > start) & (F.col("start_version") <= to) & (stop.isNull() | (stop > to))


def removed_in_range(start: Version, to: Version) -> Column:
    """Was live at `start`, and ended by `to`."""
    start, to = _col(start), _col(to)
    stop = F.col("stop_version")
    return (F.col("start_version") <= start) & (stop > start) & (stop <= to)


def candidates(objects: DataFrame, start: Version, to: Version) -> DataFrame:
    """A superset of what a range read needs, in terms of single columns that reach the scan."""
    start, to = _col(start), _col(to)
    return objects.where((F.col("start_version") <= to) & (F.col("stop_version").isNull() | (F.col("stop_version") > start)))


def snapshot(objects: DataFrame, to: Version, path_filter: Column | None = None) -> DataFrame:
    """The rows that are live at `to`."""
    live = objects.where(live_in_range(0, to))
    return live if path_filter is None else live.where(path_filter)


def snapshot_many(objects: DataFrame, versions: DataFrame) -> DataFrame:
    """The rows live at the version that `versions` (project, version) names for their project."""
    at = versions.select(F.col("project").alias("_p"), "version")
    return objects.join(at, F.col("project") == F.col("_p")).where(live_in_range(0, F.col("version"))).drop("_p")


def latest_versions(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias("project"), F.col("latest_version").alias("version"))


def tombstones(removed: DataFrame) -> DataFrame:
    return removed.select("project", "path", "mode", F.lit(0).cast("long").alias("size"), "packed", F.lit(True).alias("deleted"), F.lit(ZERO_HASH).alias("hash"))


def needless(removed: DataFrame, updated: DataFrame, how: str) -> DataFrame:
    """Removed rows that an update replaces (`left_semi`), or that none does (`left_anti`).

    A removed path needs no tombstone if it was written again, if it is a
    directory that something was written into, or if it was a file and is now a
    directory.  All three are one equality on the keys that an update covers,
    so no pair of paths is compared by prefix.
    """
    keys = updated.select(F.col("project").alias("_p"), F.explode(covering_keys(F.col("path"))).alias("_k")).distinct()
    return removed.join(keys, (F.col("project") == F.col("_p")) & (F.col("path") == F.col("_k")), how)


def diff(objects: DataFrame, start: int, to: int, path_filter: Column | None = None) -> DataFrame:
    """(project, path, mode, size, packed, deleted, hash): what leads from `start` to `to`.

    The filter holds for updates and tombstones alike.
    """
    updated = objects.where(live_in_range(start, to))
    if path_filter is not None:
        updated = updated.where(path_filter)
    out = updated.select("project", "path", "mode", "size", "packed", F.lit(False).alias("deleted"), "hash")
    if start == 0:
        return out  # nothing was live before
    removed = objects.where(removed_in_range(start, to))
    if path_filter is not None:
        removed = removed.where(path_filter)
    return out.unionByName(tombstones(needless(removed, updated, "left_anti")))


def apply_diff(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """(project, path, hash) of a snapshot after a diff."""
    writes = changes.where(~F.col("deleted"))
    gone = changes.where("deleted").select("project", "path")
    kept = tree.join(gone, ["project", "path"], "left_anti").join(writes.select("project", "path"), ["project", "path"], "left_anti")
    # A written path ends the directories above it as rows, and those above it as files.
    kept = needless(kept, writes, "left_anti")
    # A written file ends what lay below its name; a written directory row ends the file of its name.
    above = F.explode(covering_keys(F.col("path")))
    files = writes.select(F.col("project").alias("_wp"), F.when(F.col("path").endswith("/"), F.col("path")).otherwise(F.concat("path", F.lit("/"))).alias("_w")).distinct()
    below = kept.select("project", "path", above.alias("_k")).join(files, (F.col("project") == F.col("_wp")) & (F.col("_k") == F.col("_w"))).select("project", "path").distinct()
    kept = kept.join(below, ["project", "path"], "left_anti")
    return kept.select("project", "path", "hash").unionByName(writes.select("project", "path", "hash"))
