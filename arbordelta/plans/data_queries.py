"""Queries of the data-maintenance operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordelta.operators import changes, compaction, intervals, orphans, skew
from arbordelta.schema import table
from arbordelta.sources.scratch import scratch_folder


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[compaction.CompactionStore, DataFrame, DataFrame]:
    """A store in the shared folder, compacted from nothing until no merge is due."""
    store = compaction.CompactionStore(spark, scratch_folder(spark, "packs"))
    objects, contents = table(spark, sf_dir, "objects"), table(spark, sf_dir, "contents")
    store.compact(objects, contents)
    return store, objects, contents


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories whose tiny files the journal says were merged."""
    return _compacted(spark, sf_dir)[0].journal().where("level = 0").select("project", "dir_path").distinct()


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each live file, from the one place where it is."""
    store, *tables = _compacted(spark, sf_dir)
    return store.files(*tables).select("project", "path", "hash", "size", F.sha2("bytes", 256).alias("content_hash"))


def p1_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir)[0].packs().select("project", "path", "size", "pack_id")


def p1_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir)[0].journal().select("txn_id", "level", "project", "output", "n_inputs", "n_bytes")


def _feed(spark: SparkSession, sf_dir: str) -> changes.EqualityDeleteTable:
    """The feed in a table in the shared folder, in two batches: first the retries, then what they retry."""
    requests, feed = table(spark, sf_dir, "update_requests"), changes.EqualityDeleteTable(spark, scratch_folder(spark, "feed"))
    retry = F.coalesce(F.col("attempt") > 1, F.lit(False))
    feed.append("retries", requests.where(retry))
    feed.append("first attempts", requests.where(~retry))
    return feed


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).read(table(spark, sf_dir, "projects")).select("project", "path", "seq")


def p3_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _feed(spark, sf_dir)
    feed.compact()
    return feed.read(table(spark, sf_dir, "projects")).select("project", "path", "mode", F.sha2("content", 256).alias("content_hash"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_projects(table(spark, sf_dir, "objects")).select("project")


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.project_totals(table(spark, sf_dir, "objects"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged_and_gaps(table(spark, sf_dir, "objects"))


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.periods_and_gaps(table(spark, sf_dir, "objects"), ["project", "path"])
    open_end = F.col("to_version") == intervals.OPEN
    return found.select("project", "path", "kind", "from_version", F.when(open_end, F.lit(-1).cast("long")).otherwise(F.col("to_version")).alias("to_version"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_rows(*(table(spark, sf_dir, t) for t in ("objects", "contents", "projects")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_files, p1_placements, p1_journal, p3_found, p3_state, p4_found, p4_totals, p5_found, p5_periods, p6_found, p6_counts)}

_LAST_REQUESTS = """
with ranked as (
  select *, rank() over (partition by project, seq order by attempt desc nulls last) as rk
  from update_requests where project is not null and seq is not null),
effective as (
  select r.project, r.path, r.seq, coalesce(r.deleted, false) as deleted, r.mode, r.content
  from ranked r join projects p on p.id = r.project
  where rk = 1 and r.path is not null and r.batch_version <= p.latest_version),
last_write as (
  select * from (select *, row_number() over (partition by project, path order by seq desc) as rn from effective) t
  where rn = 1 and not deleted)
"""

_PERIODS = """
with iv as (
  select distinct project, path, start_version as s, coalesce(stop_version, 9223372036854775807) as e
  from objects where start_version is not null and (stop_version is null or stop_version > start_version)),
marked as (
  select *, max(e) over (partition by project, path order by s, e rows between unbounded preceding and 1 preceding) as reached from iv),
numbered as (
  select *, sum(case when reached is null or s > reached then 1 else 0 end) over (partition by project, path order by s, e rows unbounded preceding) as run
  from marked),
periods as (
  select project, path, run, min(s) as s, max(e) as e, bool_or(coalesce(s < reached, false)) as shared
  from numbered group by project, path, run),
gaps as (
  select project, path, lag(e) over (partition by project, path order by s) as s, s as e from periods)
"""

_ORPHANS = """
with c as (select lower(trim(hash)) as k, min(loaded_at) as came from contents group by 1),
p as (select id as k, min(loaded_at) as came from projects group by 1),
found as (
  select 'contents' as ref_table, case when c.k is null then 'missing' else 'late' end as state,
    strftime(o.loaded_at, '%Y-%m') as period, o.project, o.start_version, o.path
  from objects o left join c on c.k = lower(trim(o.hash))
  where o.hash is not null and lower(trim(o.hash)) <> repeat('0', 64) and (c.k is null or c.came > o.loaded_at)
  union all
  select 'projects', case when p.k is null then 'missing' else 'late' end, strftime(o.loaded_at, '%Y-%m'), o.project, o.start_version, o.path
  from objects o left join p on p.k = o.project
  where o.project is not null and (p.k is null or p.came > o.loaded_at))
"""

ORACLE = {
    "p1_found": """
select project, dir_path from (
  select distinct project, path, coalesce(regexp_extract(path, '^(.*/)', 1, 's'), '') as dir_path
  from objects where stop_version is null and not packed and path is not null and size between 0 and 4095
    and (coalesce(mode, 0) & 2147483648) = 0 and (coalesce(mode, 0) & 134217728) = 0) t
group by project, dir_path having count(*) >= 16""",
    "p1_files": """
select o.project, o.path, o.hash, o.size, sha256(c.bytes) as content_hash from (
  select project, path, hash, cast(greatest(coalesce(size, 0), 0) as bigint) as size, row_number() over (
    partition by project, path order by start_version desc nulls last, loaded_at desc nulls last, hash desc nulls last, objects.size desc nulls last) as rn
  from objects where stop_version is null and not packed and path is not null
    and (coalesce(mode, 0) & 2147483648) = 0 and (coalesce(mode, 0) & 134217728) = 0) o
left join contents c on lower(trim(c.hash)) = lower(trim(o.hash)) where rn = 1""",
    "p3_found": _LAST_REQUESTS + "select project, path, seq from last_write",
    "p3_state": _LAST_REQUESTS + "select project, path, mode, sha256(content) as content_hash from last_write",
    "p4_found": """
with t as (select project, count(*) as n, sum(greatest(coalesce(size, 0), 0)) as b from objects group by project)
select project from t where n * 50 >= (select sum(n) from t) or b * 50 >= (select sum(b) from t)""",
    "p4_totals": """
select project, count(*) as n_rows, count(*) filter (where stop_version is null) as live_rows,
  cast(sum(greatest(coalesce(size, 0), 0)) as bigint) as n_bytes from objects group by project""",
    "p5_found": _PERIODS + """
select project, path, 'merged' as kind, s as from_version, case when e = 9223372036854775807 then -1 else e end as to_version from periods where shared
union all select project, path, 'gap', s, e from gaps where s is not null""",
    "p5_periods": _PERIODS + """
select project, path, 'period' as kind, s as from_version, case when e = 9223372036854775807 then -1 else e end as to_version from periods
union all select project, path, 'gap', s, e from gaps where s is not null""",
    "p6_found": _ORPHANS + "select distinct * from found",
    "p6_counts": _ORPHANS + "select ref_table, state, period, count(*) as n from (select distinct * from found) d group by 1, 2, 3",
}
