"""The store's operations by name, over a :class:`~arbordelta.sources.storage.Store`.

Reads are lazy frames of one generation; writes commit a generation and are
derived again if another writer was first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordelta.operators import cache, gc, mutate, reads, tarstream
from arbordelta.operators.mutate import State
from arbordelta.operators.reads import ObjectQuery
from arbordelta.sources.scratch import scratch_scope, written
from arbordelta.sources.storage import Conflict, Store
from arbordelta.streaming.ingest import apply_to_store

EVERYTHING = ObjectQuery(is_prefix=True)


class FileTrees:
    def __init__(self, store: Store, tries: int = 5):
        self.store, self.tries = store, tries

    def _write(self, step: Callable[[State], tuple[State, object]], *projects: int | None):
        """Commits what `step` makes of the state; of objects, it sees and rewrites only the buckets of `projects`, if any are named."""
        for attempt in range(self.tries):
            read = self.store.generation()
            buckets = {p % self.store.entry(read)["buckets"] for p in projects if p is not None} if projects else None
            before = self.store.state(read, buckets)
            after, result = step(before)
            try:
                self.store.commit_state(read, before, after, buckets)
                return result
            except Conflict:
                if attempt == self.tries - 1:
                    raise

    # --- projects

    def new_project(self, project: int, patterns: Sequence[str] | None = None, template: int | None = None) -> int:
        self._write(lambda s: (mutate.new_project(s, project, patterns, template), None), project, template)
        return reads.latest_version(self.store.table("projects"), project)

    def fold_and_vacuum(self, keep: int = 1) -> int:
        """Folds the contents' parts, and removes all generations but the last `keep`; how many data folders went."""
        while self.store.fold_contents() is not None:
            pass
        return self.store.vacuum(keep)

    def delete_project(self, project: int) -> None:
        self._write(lambda s: (mutate.delete_project(s, project), None), project)

    def list_projects(self) -> DataFrame:
        return self.store.table("projects").select("id", "latest_version")

    def clone(self, source: int, target: int, version: int | None = None) -> int:
        def step(s: State):
            return mutate.clone_project(s, source, target, reads.latest_version(s.projects, source) if version is None else version), None

        self._write(step, source, target)
        return reads.latest_version(self.store.table("projects"), target)

    def rollback(self, project: int, version: int) -> None:
        self._write(lambda s: (mutate.rollback(s, project, version), None), project)

    # --- reads

    def _range(self, state: State, project: int, start: int | None, to: int | None) -> tuple[int, int]:
        return reads.version_range(state.projects, project, start, to)

    def get(self, project: int, queries: Sequence[ObjectQuery] = (EVERYTHING,), start: int | None = None, to: int | None = None, limit: int | None = None) -> DataFrame:
        """(query_idx, project, path, mode, size, deleted, content)."""
        state = self.store.state()
        start, to = self._range(state, project, start, to)
        mine = state.objects.where(F.col("project") == project)
        return reads.get_multi(lambda q: reads.get_objects(mine, state.contents, state.projects, q, start, to, limit), queries)

    def get_unary(self, project: int, queries: Sequence[ObjectQuery] = (EVERYTHING,), start: int | None = None, to: int | None = None, limit: int | None = None) -> tuple[int, list]:
        """The version read, and the rows; for results that fit the driver."""
        version = self._range(self.store.state(), project, start, to)[1]
        return version, self.get(project, queries, start, version, limit).collect()

    def get_compress(self, project: int, query: ObjectQuery = EVERYTHING, start: int | None = None, to: int | None = None, cached: list[int] | None = None, compat_tombstones: bool = False) -> tuple[int, DataFrame]:
        """The version read, and (project, chunk, pack_path, bytes)."""
        generation = self.store.generation()
        state = self.store.state(generation)
        start, to = self._range(state, project, start, to)
        mine = state.objects.where(F.col("project") == project)
        return to, tarstream.get_tars(mine, state.contents, self.store.table("cache_versions", generation), query, start, to, cached, compat_tombstones)

    def inspect(self, project: int) -> DataFrame:
        state = self.store.state()
        objects, projects = state.objects.where(F.col("project") == project), state.projects.where(F.col("id") == project)
        return reads.inspect(objects, projects, reads.get_objects(objects, state.contents, projects, EVERYTHING))

    # --- writes

    def update(self, changes: DataFrame) -> int | None:
        """The version after a batch of one project; None for an empty batch."""
        named = [r[0] for r in changes.select("project").distinct().limit(2).collect()]
        if not named:
            return None
        if len(named) > 1:
            raise ValueError("an update is of one project")
        reads.latest_version(self.store.table("projects"), named[0])
        return apply_to_store(self.store, changes, tries=self.tries).first()["version"]

    # --- caches

    def create_cache(self, prefix: str, count: int) -> int:
        read = self.store.generation()
        known = self.store.table("cache_versions", read)
        row = cache.create_cache(self.store.table("objects", read), known, prefix, count).first()
        new = self.store.spark.createDataFrame([(row["version"], row["hashes"])], known.schema)
        self.store.commit(read, {"cache_versions": known.unionByName(new)})
        return row["version"]

    def get_cache(self, version: int | None = None) -> DataFrame:
        return cache.get_cache(self.store.table("cache_versions"), self.store.table("contents"), version)

    # --- collection

    def gc_project(self, project: int, keep: int, start: int = 0) -> int:
        """Reads the hashes of all objects, but rewrites only the bucket of the project, and contents only if some are lost."""
        return self._collect(lambda s: gc.gc_rows(s.objects, s.projects.where(F.col("id") == project), keep, start), project)

    def gc_random_projects(self, percent: float, keep: int, start: int = 0, seed: int = 42) -> int:
        return self._collect(lambda s: gc.gc_rows(s.objects, gc.sample_projects(s.projects, percent, seed), keep, start))

    def gc_contents(self, percent: float, seed: int = 42) -> int:
        def step(s: State):
            lost = written(gc.gc_contents(s, percent, seed)[1], "lost")
            return self._without(s, lost), lost.count()

        with scratch_scope():
            return self._write(step)

    def _without(self, state: State, lost: DataFrame) -> State:
        return state if lost.isEmpty() else replace(state, contents=state.contents.join(lost, "hash", "left_anti"))

    def _collect(self, split: Callable[[State], tuple[DataFrame, DataFrame]], *projects: int) -> int:
        """Drops the rows that `split` tells apart, and the contents that only they held; how many contents."""
        def step(s: State):
            kept, dropped = split(s)
            read = self.store.generation()
            entry = self.store.entry(read)
            named = {p % entry["buckets"] for p in projects}
            rest = kept.select("hash")
            if projects:
                rest = rest.unionByName(self.store.table("objects", read, set(range(entry["buckets"])) - named).select("hash"))
            lost = written(gc.orphans(dropped, rest).join(s.contents.select("hash"), "hash", "left_semi"), "lost")
            return self._without(replace(s, objects=kept), lost), lost.count()

        with scratch_scope():
            return self._write(step, *projects)

    # --- states, for tests and development

    def snapshot(self) -> str:
        return mutate.snapshot_state(self.store.table("projects")).first()[0]

    def reset(self, state: str = "") -> None:
        self._write(lambda s: (mutate.reset(s, mutate.parse_state(state)), None))
