"""A tree on disk that follows a project: rebuild it at a version, send its changes.

The tree's state directory keeps the version and a summary of what was there, as
(path, mode, hash), against which changes are found.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordelta.api import EVERYTHING, FileTrees
from arbordelta.functions.paths import content_hash, starts_with_any
from arbordelta.operators.reads import ObjectQuery
from arbordelta.schema import UPDATES
from arbordelta.sources import tree

SUMMARY = "path string, mode long, hash string"


class Rebuilt(NamedTuple):
    """file_match: something was written, and all of it matches."""

    version: int
    count: int
    cached_count: int
    file_match: bool


class Workspace:
    def __init__(self, trees: FileTrees, project: int, root: str):
        self.trees, self.project, self.root = trees, project, root
        self.spark = trees.store.spark

    @property
    def _summary(self) -> str:
        return os.path.join(self.root, tree.STATE_DIR, "summary")

    def _listing(self) -> DataFrame:
        return tree.scan_dir(self.spark, self.root).where(~F.col("deleted")).select("path", "mode", content_hash(F.col("content")).alias("hash"))

    def _summarize(self) -> None:
        # The rows were read from this tree, so they fit its file system; the old summary is not read in the same plan.
        self._listing().write.mode("overwrite").parquet(f"file://{self._summary}")

    def _known(self) -> DataFrame:
        return self.spark.read.schema(SUMMARY).parquet(f"file://{self._summary}") if os.path.isdir(self._summary) else self.spark.createDataFrame([], SUMMARY)

    def rebuild(self, to: int | None = None, query: ObjectQuery = EVERYTHING, include: str | None = None, exclude: str | None = None, cache_root: str | None = None) -> Rebuilt:
        """Brings the tree to a version, by the TARs that lead there; packs of the caches below `cache_root` aren't sent."""
        start = tree.read_version(self.root)
        state = self.trees.store.state()
        from arbordelta.operators.reads import latest_version

        to = latest_version(state.projects, self.project) if to is None else to
        if to == start:
            return Rebuilt(to, 0, 0, False)
        if to < start:
            raise ValueError(f"the tree is at version {start}, later than {to}")
        cached = tree.read_cache_versions(cache_root) if cache_root else []
        _, tars = self.trees.get_compress(self.project, query, start, to, cached)
        done = tree.write_tars(tars, self.root, include, exclude, cache_root).first()
        if done["tars"]:
            tree.write_version(self.root, to)
            self._summarize()
        return Rebuilt(to, done["count"], done["cached_count"], done["file_match"])

    def changes(self, subpaths: Sequence[str] = ()) -> DataFrame:
        """The tree's changes since it was last in step: rows of an update."""
        found = tree.dir_diff(self._known(), self._listing())
        if subpaths:
            found = found.where(starts_with_any(F.col("path"), subpaths))
        now = tree.scan_dir(self.spark, self.root)
        removed = F.col("action") == "remove"
        rows = found.join(now, "path", "left").select(
            F.lit(self.project).cast("long").alias("project"), F.lit(0).cast("long").alias("seq"), "path", F.coalesce("mode", F.lit(0).cast("long")).alias("mode"),
            F.coalesce("size", F.lit(0).cast("long")).alias("size"), (removed | F.coalesce("deleted", F.lit(True))).alias("deleted"), F.when(~removed, F.col("content")).alias("content"))
        return rows.select([f.name for f in UPDATES.fields])

    def update(self, subpaths: Sequence[str] = ()) -> int | None:
        """Sends the changes; the project's version then, None if there were none."""
        start = tree.read_version(self.root)
        version = self.trees.update(self.changes(subpaths))
        if version == start + 1:
            tree.write_version(self.root, version)
            self._summarize()
        elif version is not None and version != start:
            self.rebuild(version)  # someone else has written in between
        return version
