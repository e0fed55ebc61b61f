"""Reads: path queries, contents, packs' members, inspection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordelta.functions.paths import pack_parent, starts_with_all, starts_with_any
from arbordelta.operators.packs import expand_packs
from arbordelta.operators.temporal import diff


class ProjectNotFound(LookupError):
    pass


@dataclass(frozen=True)
class ObjectQuery:
    """One path, or all below a prefix less `ignores`, within `subpaths`.

    Prefixes are literal: %, _ and backslashes stand for themselves.  A path must
    match one of the subpaths, or with subpaths_mode `all` each of them.
    """

    path: str = ""
    is_prefix: bool = False
    ignores: Sequence[str] = field(default_factory=tuple)
    subpaths: Sequence[str] = field(default_factory=tuple)
    subpaths_mode: str = "any"

    def __post_init__(self):
        if self.ignores and not self.is_prefix:
            raise ValueError("ignores need a prefix query")
        if wrong := [i for i in self.ignores if not i.startswith(self.path)]:
            raise ValueError(f"ignores {wrong} are not below {self.path!r}")
        if self.subpaths_mode not in ("any", "all"):
            raise ValueError("subpaths_mode is any or all")

    def path_filter(self, path: Column | None = None) -> Column:
        """On rows of objects."""
        path = F.col("path") if path is None else path
        out = F.lit(True)
        if self.path:
            out = path.startswith(self.path) if self.is_prefix else path == self.path
        return out & self.scope_filter(path)

    def scope_filter(self, path: Column) -> Column:
        """The part of ignores and subpaths, which holds for rows of packs, not for their members."""
        out = ~starts_with_any(path, self.ignores) if self.ignores else F.lit(True)
        if self.subpaths:
            out = out & (starts_with_all if self.subpaths_mode == "all" else starts_with_any)(path, self.subpaths)
        return out

    def member_filter(self, path: Column | None = None) -> Column:
        """On what is sent, members of packs included."""
        path = F.col("path") if path is None else path
        if self.is_prefix:
            return path.startswith(self.path)
        return path == self.path


def version_range(projects: DataFrame, project: int, start: int | None = None, to: int | None = None) -> tuple[int, int]:
    """Null start is 0, null end the latest version; an explicit end is taken as it is."""
    if to is None:
        to = latest_version(projects, project)
    return start or 0, to


def latest_version(projects: DataFrame, project: int) -> int:
    row = projects.where(F.col("id") == project).select("latest_version").first()
    if row is None:
        raise ProjectNotFound(project)
    return row[0]


def with_content(rows: DataFrame, contents: DataFrame, limit: int | None = None) -> DataFrame:
    """rows with `content`; null where `size` is above the limit, and then its bytes are never joined."""
    blobs = contents.select(F.col("hash").alias("_h"), F.col("bytes").alias("content"))
    key = F.col("hash") if not limit else F.when(F.col("size") <= limit, F.col("hash"))
    # Rows without a key are spread by their path: a null key would take them all to one task.
    key = F.coalesce(key, F.concat(F.lit("-"), F.col("path")))
    return rows.withColumn("_k", key).join(blobs, F.col("_k") == F.col("_h"), "left").drop("_k", "_h")


def _pack_rows(query: ObjectQuery, patterns: Column) -> Column:
    """Rows of packs that may hold what the query asks for.

    An exact path lies in the pack named by its own pack directory.  A prefix may
    end within a pack, so packs above it and packs below it both count.
    """
    path = F.col("path")
    if not query.is_prefix:
        return path == pack_parent(F.lit(query.path), patterns)
    return path.startswith(query.path) | F.lit(query.path).startswith(path)


def get_objects(objects: DataFrame, contents: DataFrame, projects: DataFrame, query: ObjectQuery, start: int = 0, to: int | None = None, limit: int | None = None) -> DataFrame:
    """(project, path, mode, size, deleted, content), packs given as their members.

    Works on all projects that `objects` holds; `to` null is each one's latest version.
    A pack above the size limit is given as itself, without content.
    """
    known = projects.select(F.col("id").alias("_id"), "latest_version", F.coalesce("pack_patterns", F.array().cast("array<string>")).alias("_patterns"))
    rows = objects.join(known, F.col("project") == F.col("_id"))
    wanted = query.path_filter()
    if query.path:
        wanted = F.when(F.col("packed"), _pack_rows(query, F.col("_patterns")) & query.scope_filter(F.col("path"))).otherwise(wanted)
    if to is None:
        rows = rows.where((F.col("start_version") <= F.col("latest_version")))
        to_version = (1 << 62)
        rows = rows.withColumn("stop_version", F.when(F.col("stop_version") <= F.col("latest_version"), F.col("stop_version")))
    else:
        to_version = to
    found = diff(rows, start, to_version, wanted)
    plain = found.where(~F.col("packed") | F.col("deleted"))
    packs = with_content(found.where(F.col("packed") & ~F.col("deleted")), contents, limit)
    members = expand_packs(packs.where(F.col("content").isNotNull())).select("project", "path", "mode", "size", "deleted", "content")
    whole = packs.where(F.col("content").isNull()).select("project", "path", "mode", "size", "deleted", "content")
    out = with_content(plain, contents, limit).select("project", "path", "mode", "size", "deleted", "content").unionByName(members).unionByName(whole)
    return out.where(query.member_filter()) if query.path else out


def get_multi(read, queries: Sequence[ObjectQuery]) -> DataFrame:
    """The results of all queries, told apart by query_idx; a row in several comes several times."""
    return reduce(DataFrame.unionByName, (read(q).withColumn("query_idx", F.lit(i)) for i, q in enumerate(queries)))


def inspect(objects: DataFrame, projects: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(project, latest_version, live_objects_count, total_objects_count).

    `live` is what a full read sends, members of packs one by one; by default live rows are counted.
    """
    total = objects.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("stop_version").isNull() & (F.col("start_version") > 0), 1)).alias("live"))
    out = projects.select(F.col("id").alias("_id"), "latest_version").join(total, F.col("_id") == F.col("project"), "left")
    if live is not None:
        own = live.groupBy(F.col("project").alias("_lp")).agg(F.count(F.lit(1)).alias("_n"))
        out = out.drop("live").join(own, F.col("_id") == F.col("_lp"), "left").withColumnRenamed("_n", "live")
    return out.select(
        F.col("_id").alias("project"), "latest_version", F.coalesce("live", F.lit(0)).cast("long").alias("live_objects_count"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total_objects_count"))


def project_usage(objects: DataFrame, prefix: str = "") -> DataFrame:
    """(project, bytes) of live rows below a prefix."""
    live = objects.where(F.col("stop_version").isNull() & F.col("path").startswith(prefix))
    return live.groupBy("project").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
