"""Versioned writes, as functions from a state to the next one.

A state is three lazy frames; nothing is written here (see sources.storage).
Unique indexes become a deduplicated batch and an anti-join on the index's key.
A batch may hold many projects: each gets its own next version, and every join
carries the project.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbordelta.functions.paths import content_hash, pack_parent, retired_keys
from arbordelta.operators.packs import merge_packs
from arbordelta.operators.temporal import live_in_range, snapshot
from arbordelta.sources.scratch import written

OBJECT_COLUMNS = ["project", "start_version", "stop_version", "path", "hash", "mode", "size", "packed"]


class AlreadyExists(ValueError):
    pass


class PatternMismatch(ValueError):
    pass


class BadPattern(ValueError):
    pass


@dataclass(frozen=True)
class State:
    projects: DataFrame
    objects: DataFrame
    contents: DataFrame


def _null_version() -> Column:
    return F.lit(None).cast("long")


def _latest(projects: DataFrame, project: int) -> int:
    from arbordelta.operators.reads import latest_version

    return latest_version(projects, project)


def _set_latest(projects: DataFrame, project: int, version: int) -> DataFrame:
    return projects.withColumn("latest_version", F.when(F.col("id") == project, F.lit(version).cast("long")).otherwise(F.col("latest_version")))


# --- projects

def new_project(state: State, project: int, patterns: Sequence[str] | None = None, template: int | None = None) -> State:
    """A project at version 0, or with the live objects and version of a template."""
    if state.projects.where(F.col("id") == project).limit(1).count():
        raise AlreadyExists(f"project id already exists: {project}")
    spark = state.projects.sparkSession
    check_patterns(spark, patterns or ())
    row = spark.createDataFrame([(project, 0, list(patterns) if patterns is not None else None)], "id long, latest_version long, pack_patterns array<string>")
    out = replace(state, projects=state.projects.select("id", "latest_version", "pack_patterns").unionByName(row))
    return out if template is None else template_copy(out, template, project)


def check_patterns(spark: SparkSession, patterns: Sequence[str]) -> None:
    """Raises BadPattern for what the engine that searches paths can't compile, before any task runs."""
    for p in patterns:
        try:
            spark._jvm.java.util.regex.Pattern.compile(p)
        except IllegalArgumentException as e:
            raise BadPattern(f"{p!r} is no pattern: {e}") from None


def same_patterns(projects: DataFrame, a: int, b: int) -> bool:
    """Null and unknown are like no pattern; the order counts."""
    found = {r[0]: list(r[1] or []) for r in projects.where(F.col("id").isin(a, b)).select("id", "pack_patterns").collect()}
    return found.get(a, []) == found.get(b, [])


def template_rows(objects: DataFrame, source: int, target: int) -> DataFrame:
    live = objects.where((F.col("project") == source) & F.col("stop_version").isNull())
    return live.withColumn("project", F.lit(target).cast("long")).select(OBJECT_COLUMNS)


def template_copy(state: State, source: int, target: int) -> State:
    if not same_patterns(state.projects, source, target):
        raise PatternMismatch(f"{source} and {target} have different pack patterns")
    objects = state.objects.select(OBJECT_COLUMNS).unionByName(template_rows(state.objects, source, target))
    return replace(state, objects=objects, projects=_set_latest(state.projects, target, _latest(state.projects, source)))


def delete_project(state: State, project: int) -> State:
    """Contents stay until they are collected."""
    return replace(state, projects=state.projects.where(F.col("id") != project), objects=state.objects.where(F.col("project") != project))


def drop_other_projects(state: State, projects: Sequence[int]) -> State:
    return replace(state, projects=state.projects.where(F.col("id").isin(list(projects))), objects=state.objects.where(F.col("project").isin(list(projects))))


# --- updates

def close_rows(objects: DataFrame, keys: DataFrame, versions: DataFrame) -> DataFrame:
    """objects with the live rows of `keys` (project, path), distinct, closed at their project's version."""
    at = keys.join(versions, "project").select(F.col("project").alias("_p"), F.col("path").alias("_k"), F.col("version").alias("_v"))
    live = objects.where(F.col("stop_version").isNull())
    dead = objects.where(F.col("stop_version").isNotNull()).select(OBJECT_COLUMNS)
    joined = live.join(at, (F.col("project") == F.col("_p")) & (F.col("path") == F.col("_k")), "left")
    return dead.unionByName(joined.withColumn("stop_version", F.col("_v")).select(OBJECT_COLUMNS))


def last_writes(batch: DataFrame) -> DataFrame:
    """The batch's upserts, of several of one path the last by seq."""
    rest = [c for c in batch.columns if c not in ("project", "path", "seq")]
    best = F.max_by(F.struct(*rest), "seq")
    return batch.where(~F.coalesce("deleted", F.lit(False))).groupBy("project", "path").agg(best.alias("b")).select("project", "path", "b.*")


def live_rows_of(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """The live rows of `keys` (project, path), which may repeat; as a table, as what is small is used often."""
    named = keys.select(F.col("project").alias("_p"), F.col("path").alias("_k")).distinct()
    live = objects.where(F.col("stop_version").isNull())
    return written(live.join(named, (F.col("project") == F.col("_p")) & (F.col("path") == F.col("_k")), "left_semi").select(OBJECT_COLUMNS), "live")


class PlainChanges(NamedTuple):
    """inserted: rows of objects; gone, retired: (project, path), distinct."""

    inserted: DataFrame
    gone: DataFrame
    retired: DataFrame


def plain_changes(live: DataFrame, batch: DataFrame, versions: DataFrame) -> PlainChanges:
    """What a batch of unpacked changes does; live: at least the live rows of its paths.

    Deletes take effect before writes.  A write that equals a row still live in
    path, hash and mode does nothing; any other closes the path's row and the
    rows of the directories above it.
    """
    gone = batch.where(F.coalesce("deleted", F.lit(False))).select("project", "path").distinct()
    writes = last_writes(batch).withColumn("hash", content_hash(F.col("content"))).join(versions, "project")
    kept = live.join(gone, ["project", "path"], "left_anti").select("project", "path", "hash", "mode").distinct()
    inserted = written(writes.join(kept, ["project", "path", "hash", "mode"], "left_anti").select(
        "project", F.col("version").alias("start_version"), _null_version().alias("stop_version"), "path", "hash", "mode", "size", F.lit(False).alias("packed")), "inserted")
    retired = inserted.select("project", F.explode(retired_keys(F.col("path"))).alias("path")).distinct()
    return PlainChanges(inserted, gone, retired)


def update_objects(objects: DataFrame, batch: DataFrame, versions: DataFrame) -> DataFrame:
    """objects after a batch of unpacked changes.

    batch: (project, seq, path, mode, size, deleted, content); versions:
    (project, version), the version that each project's batch makes.  Rows are
    looked up once by the batch's paths, and closed in one pass.
    """
    changes = plain_changes(live_rows_of(objects, batch), batch, versions)
    closed = changes.gone.unionByName(changes.retired).distinct()
    return close_rows(objects, closed, versions).unionByName(changes.inserted)


def next_versions(projects: DataFrame, batch: DataFrame) -> DataFrame:
    """(project, version) of the projects that the batch names and that exist."""
    named = batch.select(F.col("project").alias("_p")).distinct()
    return projects.join(named, F.col("id") == F.col("_p"), "left_semi").select(F.col("id").alias("project"), (F.col("latest_version") + 1).alias("version"))


class Update(NamedTuple):
    """projects, objects: as they are afterwards; fresh: contents to add; versions: (project, version) of the projects named."""

    projects: DataFrame
    objects: DataFrame
    fresh: DataFrame
    versions: DataFrame


def plan_update(state: State, batch: DataFrame) -> Update:
    """What one batch of changes makes of a state.

    Paths below a pack directory change that pack, the others are objects.  A
    delete, even of an unknown path, makes a version; a batch that changes
    nothing leaves the project at its version.  Unknown projects are ignored.
    """
    versions = next_versions(state.projects, batch)
    patterns = state.projects.select(F.col("id").alias("_id"), F.coalesce("pack_patterns", F.array().cast("array<string>")).alias("_patterns"))
    routed = batch.join(patterns, F.col("project") == F.col("_id")).withColumn("pack_path", pack_parent(F.col("path"), F.col("_patterns"))).drop("_id", "_patterns")
    plain = routed.where(F.col("pack_path").isNull()).drop("pack_path")
    packed = routed.where(F.col("pack_path").isNotNull())
    live = live_rows_of(state.objects, routed.select("project", F.coalesce("pack_path", "path").alias("path")))
    changes = plain_changes(live, plain, versions)

    blobs = state.contents.select(F.col("hash").alias("_h"), F.col("bytes").alias("content"))
    held = live.where("packed").join(packed.select("project", F.col("pack_path").alias("path")).distinct(), ["project", "path"], "left_semi")
    before = held.join(blobs, F.col("hash") == F.col("_h"), "left").select("project", F.col("path").alias("pack_path"), "hash", "content")
    merged = merge_packs(before, packed)
    changed = written(merged.where(~F.col("before_hash").eqNullSafe(F.col("hash")) | F.col("hash").isNull()), "packs")
    new_packs = changed.where(F.col("hash").isNotNull()).join(versions, "project").select(
        "project", F.col("version").alias("start_version"), _null_version().alias("stop_version"), F.col("pack_path").alias("path"), "hash",
        F.lit(0).cast("long").alias("mode"), F.octet_length("content").cast("long").alias("size"), F.lit(True).alias("packed"))

    closed = changes.gone.unionByName(changes.retired).unionByName(changed.select("project", F.col("pack_path").alias("path"))).distinct()
    objects = close_rows(state.objects, closed, versions).unionByName(changes.inserted).unionByName(new_packs)

    moved = changes.inserted.select("project").unionByName(changes.gone.select("project")).unionByName(changed.select("project")).distinct().withColumn("_moved", F.lit(True))
    result = versions.join(moved, "project", "left").select("project", F.when(F.col("_moved"), F.col("version")).otherwise(F.col("version") - 1).alias("version"))
    projects = state.projects.join(result.select(F.col("project").alias("_p"), F.col("version").alias("_v")), F.col("id") == F.col("_p"), "left").withColumn(
        "latest_version", F.coalesce("_v", "latest_version")).drop("_p", "_v")

    fresh = last_writes(plain).select(content_hash(F.col("content")).alias("hash"), F.coalesce("content", F.lit(b"")).alias("bytes")).unionByName(
        changed.where(F.col("hash").isNotNull()).select("hash", F.col("content").alias("bytes"))).dropDuplicates(["hash"])
    return Update(projects, objects, fresh.join(state.contents.select("hash"), "hash", "left_anti"), result)


def update_batch(state: State, batch: DataFrame) -> tuple[State, DataFrame]:
    """The state after one batch of changes, and (project, version) of each project it names."""
    done = plan_update(state, batch)
    return State(done.projects, done.objects, state.contents.select("hash", "bytes").unionByName(done.fresh)), done.versions


# --- whole projects

def clone_to_remove(objects: DataFrame, source: int, target: int, version: int) -> DataFrame:
    """Live (path, mode, size, packed, hash) of the target that the source hasn't at `version`."""
    columns = ["path", "mode", "size", "packed", "hash"]
    ours = objects.where((F.col("project") == target) & (F.col("start_version") > 0) & F.col("stop_version").isNull()).select(columns)
    theirs = objects.where((F.col("project") == source) & live_in_range(0, version)).select(columns)
    return ours.subtract(theirs)


def clone_project(state: State, source: int, target: int, version: int) -> State:
    """The target gets the source's tree at `version` as its next version, also if nothing differs."""
    if not same_patterns(state.projects, source, target):
        raise PatternMismatch(f"{source} and {target} have different pack patterns")
    new = _latest(state.projects, target) + 1
    return replace(state, objects=clone_objects(state.objects, source, target, version, new), projects=_set_latest(state.projects, target, new))


def clone_objects(objects: DataFrame, source: int, target: int, version: int, new: int) -> DataFrame:
    objects = objects.select(OBJECT_COLUMNS)
    spark = objects.sparkSession
    at = spark.createDataFrame([(target, new)], "project long, version long")
    keys = clone_to_remove(objects, source, target, version).select(F.lit(target).cast("long").alias("project"), "path").distinct()
    after = close_rows(objects, keys, at)
    live = after.where((F.col("project") == target) & F.col("stop_version").isNull()).select("path", "hash", "mode")
    added = snapshot(objects.where(F.col("project") == source), version).join(live, ["path", "hash", "mode"], "left_anti").dropDuplicates(["path", "hash", "mode"])
    added = added.select(F.lit(target).cast("long").alias("project"), F.lit(new).cast("long").alias("start_version"), _null_version().alias("stop_version"), "path", "hash", "mode", "size", "packed")
    return after.unionByName(added)


def rollback_objects(objects: DataFrame, version: Column | int) -> DataFrame:
    """Rows as they were at `version`: later rows go, rows closed later are open again."""
    version = version if isinstance(version, Column) else F.lit(version).cast("long")
    kept = objects.where(F.col("start_version") <= version)
    return kept.withColumn("stop_version", F.when(F.col("stop_version") <= version, F.col("stop_version")))


def rollback(state: State, project: int, version: int) -> State:
    mine = state.objects.where(F.col("project") == project)
    others = state.objects.where(F.col("project") != project)
    return replace(state, objects=others.unionByName(rollback_objects(mine, version)), projects=_set_latest(state.projects, project, version))


def reset(state: State, versions: Sequence[tuple[int, int]] = ()) -> State:
    """All projects but the named ones go, and these go back; none named empties everything but the cache versions."""
    if not versions:
        return State(*(df.limit(0) for df in (state.projects, state.objects, state.contents)))
    at = state.projects.sparkSession.createDataFrame(list(versions), "_p long, _v long")
    objects = rollback_objects(state.objects.join(at, F.col("project") == F.col("_p")), F.col("_v")).drop("_p", "_v")
    projects = state.projects.join(at, F.col("id") == F.col("_p")).withColumn("latest_version", F.col("_v")).drop("_p", "_v")
    return replace(state, objects=objects, projects=projects)


def snapshot_state(projects: DataFrame) -> DataFrame:
    """One row: `id=version,...` in order of id."""
    pairs = F.sort_array(F.collect_list(F.struct("id", "latest_version")))
    return projects.agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["id"], p["latest_version"])), ",").alias("state"))


def parse_state(state: str) -> list[tuple[int, int]]:
    return [tuple(map(int, pair.split("="))) for pair in state.split(",") if pair]


def interval_violations(objects: DataFrame) -> DataFrame:
    """Rows that begin before the path's previous row ended: none in a store that only these functions wrote."""
    order = Window.partitionBy("project", "path").orderBy("start_version", F.col("stop_version").asc_nulls_last())
    return objects.withColumn("_before", F.max(F.coalesce("stop_version", F.lit((1 << 63) - 1))).over(order.rowsBetween(Window.unboundedPreceding, -1))).where(
        F.col("start_version") < F.col("_before")).drop("_before")
