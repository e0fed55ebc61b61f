"""A store derived from the events table, in one SQL text for both engines.

Three kinds of paths that stand for each other's directories, files and symlinks
make every tombstone rule occur.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordelta.operators.mutate import State
from arbordelta.schema import table
from arbordelta.sources.scratch import written

_STORE = """
raw as (
  select user_id as project, event_id, ts, cast(ts as date) as d,
    case when event_id % 11 = 0 then concat('d', cast(event_id % 3 as STR), '/')
         when event_id % 11 = 1 then concat('d', cast(event_id % 3 as STR))
         else concat('d', cast(event_id % 3 as STR), '/f', cast(event_id % 5 as STR)) end as path,
    event_type = 'error' as deleted,
    case when event_id % 11 = 0 then '' else PROPS end as content
  from EVENTS),
ver as (select *, cast(dense_rank() over (partition by project order by d) as bigint) as version from raw),
last_write as (select * from (select *, row_number() over (partition by project, version, path order by ts desc, event_id desc) as rn from ver) t where rn = 1),
hashed as (select project, version, path, deleted, content, case when deleted then null else SHA end as hash from last_write),
eff as (select * from (select *, lag(hash) over w as prev_hash, lag(deleted) over w as prev_deleted from hashed window w as (partition by project, path order by version)) t
  where (deleted and prev_deleted = false) or (not deleted and (prev_deleted is null or prev_deleted or prev_hash <> hash))),
spans as (select *, lead(version) over (partition by project, path order by version) as stop_version from eff),
objects as (select project, version as start_version, stop_version, path, hash,
    cast(case when right(path, 1) = '/' then 2147484141 when path like '%/%' then 493 else 134218221 end as bigint) as mode,
    cast(length(content) as bigint) as size,
    path in ('d2/f0', 'd2/f1', 'd2/f2') as packed
  from spans where not deleted),
contents as (select distinct SHA as hash, content from last_write where not deleted),
projects as (select project as id, max(version) as latest_version from ver group by project),
cache_versions as (select cast(v as bigint) as version, hash from (
    select hash, row_number() over (order by n desc, hash) as r from (select hash, count(*) as n from objects where packed and stop_version is null and path like 'd2/%' group by hash) g) k
  join (select 1 as v, 10 as lim union all select 2, 20) l on r <= lim)
"""


def _text(spark: bool, unique: bool) -> str:
    string = "string" if spark else "varchar"
    props = f"concat(props, '#', cast(event_id as {string}))" if unique else "props"
    sha = "sha2(cast(content as binary), 256)" if spark else "sha256(content)"
    return _STORE.replace("STR", string).replace("PROPS", props).replace("SHA", sha).replace("EVENTS", "{events}" if spark else "main.events")


def with_store(rest: str, unique: bool = False) -> str:
    """SQL that sees the store's relations; cache_versions is (version, hash)."""
    return f"with {_text(False, unique).strip()},\n{rest.strip()}" if not rest.lstrip().lower().startswith("select") else f"with {_text(False, unique).strip()}\n{rest.strip()}"


class Tables(NamedTuple):
    projects: DataFrame
    objects: DataFrame
    contents: DataFrame
    cache_versions: DataFrame

    @property
    def state(self) -> State:
        return State(*self[:3])


class Derived:
    """The store; each table is derived once and read from the shared folder afterwards."""

    def __init__(self, spark: SparkSession, sf_dir: str, unique: bool):
        self._spark, self._text, self._events = spark, _text(True, unique), table(spark, sf_dir, "events")

    def _one(self, name: str) -> DataFrame:
        return self._spark.sql(f"with {self._text} select * from {name}", events=self._events)

    @cached_property
    def projects(self) -> DataFrame:
        return written(self._one("projects").withColumn("pack_patterns", F.lit(None).cast("array<string>")), "projects")

    @cached_property
    def objects(self) -> DataFrame:
        return written(self._one("objects"), "objects")

    @cached_property
    def contents(self) -> DataFrame:
        return written(self._one("contents").select("hash", F.col("content").cast("binary").alias("bytes")), "contents")

    @cached_property
    def cache_versions(self) -> DataFrame:
        return written(self._one("cache_versions").groupBy("version").agg(F.sort_array(F.collect_list("hash")).alias("hashes")), "cache_versions")

    @property
    def state(self) -> State:
        return State(self.projects, self.objects, self.contents)


_DERIVED: dict[tuple, Derived] = {}


def derived(spark: SparkSession, sf_dir: str, unique: bool = False) -> Derived:
    """The store derived from events; with `unique`, no two files have the same content."""
    key = (spark.sparkContext.applicationId, sf_dir, unique)
    if key not in _DERIVED:
        _DERIVED[key] = Derived(spark, sf_dir, unique)
    return _DERIVED[key]


def given(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables as they are given, less the column loaded_at."""
    return Tables(*(table(spark, sf_dir, t).drop("loaded_at") for t in ("projects", "objects", "contents", "cache_versions")))
