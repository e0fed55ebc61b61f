"""Queries of the versioned store, with their SQL.

Most run on the store derived from events, in which every rule occurs; names
that end in _given run on the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordelta.functions.paths import content_hash, glob_match, kind, pack_parent, slash_prefixes, starts_with_any
from arbordelta.operators import cache, gc, mutate, packs, reads, tarstream, temporal
from arbordelta.operators.reads import ObjectQuery
from arbordelta.plans.fixtures import derived, given, with_store
from arbordelta.schema import DIR_BIT, LINK_BIT, UPDATES, table
from arbordelta.sources import tree
from arbordelta.sources.scratch import scratch_folder, shared_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LIVE = "start_version > {f} and start_version <= {t} and (stop_version is null or stop_version > {t})"
LIVE15 = LIVE.format(f=0, t=15)
LIVE_RANGE = LIVE.format(f=10, t=20)
REMOVED = "start_version <= 10 and stop_version > 10 and stop_version <= 20"
FULL = ["project", "start_version", "stop_version", "path", "hash", "mode", "size", "packed"]
FULL_SQL = ", ".join(FULL)


def query(sql: str | None = None, store: bool = True, unique: bool = False, name: str | None = None):
    """Registers a query; with `store`, its SQL sees the derived store."""
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = with_store(sql, unique) if store else sql
        return f
    return add


# --- reads

@query(f"select project, path, hash, mode, size, packed from objects where {LIVE15}")
def snapshot_at(spark, sf_dir):
    return temporal.snapshot(derived(spark, sf_dir).objects, 15).select("project", "path", "hash", "mode", "size", "packed")


@query(f"select project, path, hash, mode, size, packed from objects where {LIVE15}", store=False)
def snapshot_at_given(spark, sf_dir):
    return temporal.snapshot(given(spark, sf_dir).objects, 15).select("project", "path", "hash", "mode", "size", "packed")


_AT_LATEST = "start_version > 0 and start_version <= p.latest_version and (stop_version is null or stop_version > p.latest_version)"


def _latest(t):
    return temporal.snapshot_many(t.objects, temporal.latest_versions(t.projects))


@query(f"select project, path, hash, mode, size, packed from objects o join projects p on p.id = o.project where {_AT_LATEST}")
def snapshot_latest(spark, sf_dir):
    return _latest(derived(spark, sf_dir)).select("project", "path", "hash", "mode", "size", "packed")


@query(f"select project, path, hash, mode, size, packed from objects o join projects p on p.id = o.project where {_AT_LATEST}", store=False)
def snapshot_latest_given(spark, sf_dir):
    return _latest(given(spark, sf_dir)).select("project", "path", "hash", "mode", "size", "packed")


@query("""select project, 1 + project % 20 as version, path, hash from objects
where start_version > 0 and start_version <= 1 + project % 20 and (stop_version is null or stop_version > 1 + project % 20)""")
def snapshot_many(spark, sf_dir):
    t = derived(spark, sf_dir)
    at = t.projects.select(F.col("id").alias("project"), (1 + F.col("id") % 20).alias("version"))
    return temporal.snapshot_many(t.objects, at).select("project", "version", "path", "hash")


@query(f"select project, path from objects o join projects p on p.id = o.project where {_AT_LATEST}")
def get_latest(spark, sf_dir):
    return _latest(derived(spark, sf_dir)).select("project", "path")


@query("select id as project, latest_version as version from projects")
def latest_version(spark, sf_dir):
    return temporal.latest_versions(derived(spark, sf_dir).projects)


def _read(spark, sf_dir, q: ObjectQuery):
    return temporal.snapshot(derived(spark, sf_dir).objects, 15, q.path_filter()).select("project", "path", "hash")


@query(f"select project, path, hash from objects where {LIVE15} and path = 'd1/f2'")
def get_exact(spark, sf_dir):
    return _read(spark, sf_dir, ObjectQuery("d1/f2"))


@query(f"select project, path, hash from objects where {LIVE15} and path like 'd1%'")
def get_prefix(spark, sf_dir):
    return _read(spark, sf_dir, ObjectQuery("d1", is_prefix=True))


@query(f"select project, path, hash from objects where {LIVE15} and path like 'd%' and path not like 'd0%' and path not like 'd2/f%'")
def get_ignores(spark, sf_dir):
    return _read(spark, sf_dir, ObjectQuery("d", is_prefix=True, ignores=("d0", "d2/f")))


@query(f"select project, path, hash from objects where {LIVE15} and (path like 'd0/%' or path like 'd1/%')")
def get_subpaths_any(spark, sf_dir):
    return _read(spark, sf_dir, ObjectQuery(is_prefix=True, subpaths=("d0/", "d1/")))


@query(f"select project, path, hash from objects where {LIVE15} and path like 'd1%' and path like 'd1/f%'")
def get_subpaths_all(spark, sf_dir):
    return _read(spark, sf_dir, ObjectQuery(is_prefix=True, subpaths=("d1", "d1/f"), subpaths_mode="all"))


@query(f"""select project, 0 as query_idx, path, hash from objects where {LIVE15} and path = 'd0/f0'
union all select project, 1, path, hash from objects where {LIVE15} and path like 'd0%'""")
def get_multi(spark, sf_dir):
    return reads.get_multi(lambda q: _read(spark, sf_dir, q), [ObjectQuery("d0/f0"), ObjectQuery("d0", is_prefix=True)])


@query(f"select project, path, size, content from objects o left join contents c on c.hash = o.hash where {LIVE15}")
def content_join(spark, sf_dir):
    t = derived(spark, sf_dir)
    return reads.with_content(temporal.snapshot(t.objects, 15), t.contents).select("project", "path", "size", F.col("content").cast("string").alias("content"))


@query(f"select project, path, size, sha256(bytes) as content_hash from objects o left join contents c on c.hash = o.hash where {LIVE15}", store=False)
def content_join_given(spark, sf_dir):
    t = given(spark, sf_dir)
    return reads.with_content(temporal.snapshot(t.objects, 15), t.contents).select("project", "path", "size", F.sha2("content", 256).alias("content_hash"))


@query(f"select project, path, mode, size, content from objects o left join contents c on c.hash = o.hash where {LIVE15} and not packed and path like 'd%'")
def get_objects(spark, sf_dir):
    t = derived(spark, sf_dir)
    unpacked = t.objects.where(~F.col("packed"))
    return reads.get_objects(unpacked, t.contents, t.projects, ObjectQuery("d", is_prefix=True), to=15).select("project", "path", "mode", "size", F.col("content").cast("string").alias("content"))


@query("""select 'tree/' || coalesce(source, '') || '/' || doc_id as path, octet_length(encode(text)) as size,
  case when octet_length(encode(text)) <= 2000 then text end as content from documents where text is not null""", store=False)
def content_limit(spark, sf_dir):
    rows, contents = _doc_tree(spark, sf_dir)
    return reads.with_content(rows, contents, limit=2000).select("path", "size", F.col("content").cast("string").alias("content"))


def _doc_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    rows = docs.select(
        F.concat(F.lit("tree/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id")).alias("path"), F.octet_length("text").cast("long").alias("size"),
        content_hash(F.col("text").cast("binary")).alias("hash"))
    contents = docs.select(content_hash(F.col("text").cast("binary")).alias("hash"), F.col("text").cast("binary").alias("bytes")).dropDuplicates(["hash"])
    return rows, contents


@query("select 'tree/' || coalesce(source, '') || '/' || doc_id as path, sha256(text) as hash from documents where text is not null", store=False, name="content_hash")
def content_hashes(spark, sf_dir):
    return _doc_tree(spark, sf_dir)[0].select("path", "hash")


@query("""select path, case when packed then 'pack' when mode & 2147483648 <> 0 then 'directory' when mode & 134217728 <> 0 then 'symlink' else 'file' end as kind, mode & 511 as permissions
from objects""", store=False)
def object_kind(spark, sf_dir):
    return given(spark, sf_dir).objects.select("path", kind(F.col("mode"), F.col("packed")).alias("kind"), F.col("mode").bitwiseAND(511).alias("permissions"))


_INSPECT = """select id as project, latest_version, count(o.project) filter (where stop_version is null and start_version > 0) as live_objects_count, count(o.project) as total_objects_count
from projects p left join objects o on o.project = p.id group by id, latest_version"""


@query(_INSPECT)
def inspect(spark, sf_dir):
    t = derived(spark, sf_dir)
    return reads.inspect(t.objects, t.projects)


@query(_INSPECT, store=False)
def inspect_given(spark, sf_dir):
    t = given(spark, sf_dir)
    return reads.inspect(t.objects, t.projects)


@query()
def inspect_members_given(spark, sf_dir):
    """Live objects as a full read sends them, members of packs one by one; inspect and inspect_given, like their SQL, count rows."""
    t = given(spark, sf_dir)
    return reads.inspect(t.objects, t.projects, reads.get_objects(t.objects, t.contents, t.projects, ObjectQuery(is_prefix=True)))


@query("select project, count(*) as total_objects_count from objects group by project", store=False)
def inspect_total(spark, sf_dir):
    return given(spark, sf_dir).objects.groupBy("project").agg(F.count(F.lit(1)).alias("total_objects_count"))


@query("select project, count(*) as live_objects_count from objects where not packed and stop_version is null and start_version > 0 group by project")
def inspect_live(spark, sf_dir):
    t = derived(spark, sf_dir)
    live = reads.get_objects(t.objects.where(~F.col("packed")), t.contents, t.projects, ObjectQuery(is_prefix=True))
    return live.groupBy("project").agg(F.count(F.lit(1)).alias("live_objects_count"))


@query("select project, cast(coalesce(sum(size), 0) as bigint) as bytes from objects where stop_version is null group by project", store=False)
def project_usage(spark, sf_dir):
    return reads.project_usage(given(spark, sf_dir).objects)


# --- differences

@query("""select project, path, start_version, stop_version from objects where start_version <= 20 and (stop_version is null or stop_version > 10)""")
def scan_candidates(spark, sf_dir):
    return temporal.candidates(derived(spark, sf_dir).objects, 10, 20).select("project", "path", "start_version", "stop_version")


@query(f"select project, path from objects where {REMOVED}")
def removed_raw(spark, sf_dir):
    return derived(spark, sf_dir).objects.where(temporal.removed_in_range(10, 20)).select("project", "path")


_UPDATED = f"updated as (select * from objects where {LIVE_RANGE}), removed as (select * from objects where {REMOVED})"
_RULES = {
    "a": "u.path = o.path",
    "b": "right(o.path, 1) = '/' and starts_with(u.path, o.path)",
    "c": "right(o.path, 1) <> '/' and starts_with(u.path, concat(o.path, '/'))",
}


def _exists(rule: str) -> str:
    return f"exists (select 1 from updated u where u.project = o.project and {_RULES[rule]})"


def _suppressed(spark, sf_dir, rule):
    objects = derived(spark, sf_dir).objects
    removed = objects.where(temporal.removed_in_range(10, 20))
    updated = objects.where(temporal.live_in_range(10, 20))
    path, above = F.col("path"), slash_prefixes(F.col("path"))
    keys = {"a": F.array(path), "b": F.array_union(above, F.array()), "c": F.transform(above, lambda d: F.left(d, F.length(d) - 1))}[rule]
    at = updated.select(F.col("project").alias("_p"), F.explode(keys).alias("_k")).distinct()
    return removed.join(at, (F.col("project") == F.col("_p")) & (path == F.col("_k")), "left_semi").select("project", "path")


@query(f"{_UPDATED} select project, path from removed o where {_exists('a')}")
def diff_rule_a(spark, sf_dir):
    return _suppressed(spark, sf_dir, "a")


@query(f"{_UPDATED} select project, path from removed o where {_exists('b')}")
def diff_rule_b(spark, sf_dir):
    return _suppressed(spark, sf_dir, "b")


@query(f"{_UPDATED} select project, path from removed o where {_exists('c')}")
def diff_rule_c(spark, sf_dir):
    return _suppressed(spark, sf_dir, "c")


_DIFF = f"""{_UPDATED}
select project, path, mode, size, packed, false as deleted, hash from updated
union all select project, path, mode, 0, packed, true, repeat('0', 64) from removed o where not {_exists('a')} and not {_exists('b')} and not {_exists('c')}"""


@query(_DIFF)
def diff_range(spark, sf_dir):
    return temporal.diff(derived(spark, sf_dir).objects, 10, 20)


@query(f"with {_DIFF}", store=False)
def diff_range_given(spark, sf_dir):
    return temporal.diff(given(spark, sf_dir).objects, 10, 20)


@query(f"select project, path, mode, size, packed, false as deleted, hash from objects where {LIVE.format(f=0, t=20)}")
def diff_from_zero(spark, sf_dir):
    return temporal.diff(derived(spark, sf_dir).objects, 0, 20)


@query("select path, starts_with(path, 'd1/') and path <> 'd1/f4' as matched from objects")
def file_match(spark, sf_dir):
    return derived(spark, sf_dir).objects.select("path", glob_match(F.col("path"), "d1/**", "d1/f4").alias("matched"))


@query(f"""select project, count(*) as count, count(c.hash) as cached_count, bool_and(starts_with(path, 'd') and path <> 'd1/f4') as file_match
from objects o left join (select distinct hash from cache_versions where version = 1) c on c.hash = o.hash where {LIVE15} group by project""")
def rebuild_result(spark, sf_dir):
    t = derived(spark, sf_dir)
    rows = cache.with_cached(temporal.snapshot(t.objects, 15), t.cache_versions, [1])
    return rows.groupBy("project").agg(
        F.count(F.lit(1)).alias("count"), F.count(F.when(F.col("is_cached"), 1)).alias("cached_count"), F.every(glob_match(F.col("path"), "d**", "d1/f4")).alias("file_match"))


# --- packs

_PARENT = """
parts as (
  select o.path, p.pack_patterns as pats, string_split(o.path || '/', '/') as s from objects o join projects p on p.id = o.project),
dirs as (select path, pats, unnest(range(1, len(s))) as k, s from parts),
named as (select path, pats, k, array_to_string(s[1:k], '/') || '/' as dir from dirs),
hit as (select path, pats, k, dir from named where len(list_filter(pats, lambda p: regexp_matches(dir, p))) > 0),
best as (select path, pats, arg_min(dir, k) as parent from hit group by path, pats)
select distinct t.path, b.parent from parts t left join best b on b.path = t.path and b.pats = t.pats
"""


@query("with " + _PARENT.strip(), store=False, name="pack_parent")
def pack_parents(spark, sf_dir):
    t = given(spark, sf_dir)
    rows = t.objects.join(t.projects, F.col("project") == F.col("id"))
    return rows.select("path", pack_parent(F.col("path"), F.col("pack_patterns")).alias("parent")).distinct()


@query("select project, path, sha256(bytes) as content_hash from objects o join contents c on c.hash = o.hash where packed and stop_version is null", store=False)
def pack_blob(spark, sf_dir):
    return _live_packs(spark, sf_dir).select("project", "path", F.sha2("content", 256).alias("content_hash"))


def _live_packs(spark, sf_dir):
    t = given(spark, sf_dir)
    return reads.with_content(t.objects.where(F.col("packed") & F.col("stop_version").isNull()), t.contents).where(F.col("content").isNotNull())


@query()
def pack_expand(spark, sf_dir):
    return packs.expand_packs(_live_packs(spark, sf_dir))


@query()
def get_in_pack(spark, sf_dir):
    t = given(spark, sf_dir)
    return reads.get_objects(t.objects, t.contents, t.projects, ObjectQuery("pack1/", is_prefix=True))


@query()
def pack_merge(spark, sf_dir):
    before = _live_packs(spark, sf_dir).select("project", F.col("path").alias("pack_path"), "hash", "content").dropDuplicates(["project", "pack_path"])
    updates = packs.expand_packs(_live_packs(spark, sf_dir)).select(
        "project", "pack_path", F.xxhash64("path").alias("seq"), "path", "mode", "size", (F.xxhash64("path") % 3 == 0).alias("deleted"), F.encode(F.col("path"), "utf-8").alias("content"))
    return packs.merge_packs(before, updates)


# Packs of fixed members: what they hold, and the hashes of their bytes, are literals.

_MEMBERS = [
    (1, "m/", "m/a", 420, b"A"), (1, "m/", "m/b/c", 493, b"CC"), (1, "m/", "m/e/", 1 << 31 | 493, None), (1, "m/", "m/l", 1 << 27 | 511, b"a"),
    (2, "n/", "n/x", 420, b""), (2, "n/", "n/y", 384, b"yy")]


def _fixed_packs(spark):
    rows = spark.createDataFrame([(p, d, path, mode, len(c or b""), False, c) for p, d, path, mode, c in _MEMBERS], "project long, pack_path string, path string, mode long, size long, deleted boolean, content binary")
    return packs.build_packs(rows)


def _plain_members(df):
    return df.select(F.col("project").cast("int").alias("project"), "path", F.col("mode").cast("string").alias("mode"), F.coalesce(F.decode("content", "utf-8"), F.lit("")).alias("text"))


@query("""select * from (values
  (1, 'm/a', '420', 'A'), (1, 'm/b/c', '493', 'CC'), (1, 'm/e/', '2147484141', ''), (1, 'm/l', '134218239', 'a'), (2, 'n/x', '420', ''), (2, 'n/y', '384', 'yy')) t(project, path, mode, text)""", store=False)
def pack_expand_case(spark, sf_dir):
    return _plain_members(packs.expand_packs(_fixed_packs(spark).withColumnRenamed("pack_path", "path")))


@query("""select * from (values
  (1, 'm/a', '493', 'AA'), (1, 'm/e/', '2147484141', ''), (1, 'm/l', '134218239', 'a'), (1, 'm/0', '420', 'new'), (3, 'k/z', '420', 'z')) t(project, path, mode, text)""", store=False)
def pack_merge_case(spark, sf_dir):
    """A member written twice, one deleted, one new, a pack that loses all members, and a pack that is new."""
    updates = [(1, "m/", 1, "m/a", 420, False, b"no"), (1, "m/", 2, "m/a", 493, False, b"AA"), (1, "m/", 3, "m/b/c", 0, True, None), (1, "m/", 4, "m/0", 420, False, b"new"),
               (2, "n/", 1, "n/x", 0, True, None), (2, "n/", 2, "n/y", 0, True, None), (3, "k/", 1, "k/z", 420, False, b"z"), (3, "k/", 2, "k/no", 0, True, None)]
    frame = spark.createDataFrame(updates, "project long, pack_path string, seq long, path string, mode long, deleted boolean, content binary").withColumn("size", F.octet_length("content").cast("long"))
    merged = packs.merge_packs(_fixed_packs(spark).withColumn("hash", F.sha2("content", 256)), frame)
    return _plain_members(packs.expand_packs(merged.where(F.col("hash").isNotNull()).withColumnRenamed("pack_path", "path")))


def _fixed_store(spark):
    built = _fixed_packs(spark).withColumn("hash", F.sha2("content", 256))
    objects = built.select(
        "project", F.lit(1).cast("long").alias("start_version"), F.lit(None).cast("long").alias("stop_version"), F.col("pack_path").alias("path"), "hash", F.lit(0).cast("long").alias("mode"),
        F.octet_length("content").cast("long").alias("size"), F.lit(True).alias("packed"))
    plain = spark.createDataFrame([(1, 1, None, "m2", "f", 420, 1, False), (2, 1, None, "o", "f", 420, 1, False)], objects.schema)
    contents = built.select("hash", F.col("content").alias("bytes")).unionByName(spark.createDataFrame([("f", b"F")], "hash string, bytes binary"))
    projects = spark.createDataFrame([(1, 1, ["^m/"]), (2, 1, ["^n/"])], "id long, latest_version long, pack_patterns array<string>")
    return mutate.State(projects, objects.unionByName(plain), contents)


@query("""select * from (values (0, 1, 'm/a'), (0, 1, 'm/b/c'), (0, 1, 'm/e/'), (0, 1, 'm/l'), (0, 1, 'm2'), (1, 1, 'm/b/c'), (2, 1, 'm/l'), (3, 2, 'o')) t(query_idx, project, path)""", store=False)
def get_in_pack_case(spark, sf_dir):
    """Through packs: a prefix that ends before a pack, one within it, a path in it, and a path beside it."""
    state = _fixed_store(spark)
    queries = [ObjectQuery("m", is_prefix=True), ObjectQuery("m/b", is_prefix=True), ObjectQuery("m/l"), ObjectQuery("o")]
    found = reads.get_multi(lambda q: reads.get_objects(state.objects, state.contents, state.projects, q), queries)
    return found.select(F.col("query_idx").cast("int").alias("query_idx"), F.col("project").cast("int").alias("project"), "path")


@query("""select * from (values (1, 'm/a', '420', 'A2'), (1, 'm/e/', '2147484141', ''), (1, 'm/l', '134218239', 'a'), (1, 'm/new', '420', 'N'), (1, 'm2', '420', 'F'), (1, 'p', '420', 'P'), (2, 'o', '420', 'F')) t(project, path, mode, text)""", store=False)
def update_packed_case(spark, sf_dir):
    """One batch that changes members, empties a pack, and writes beside packs."""
    batch = [(1, 1, "m/a", 420, False, b"A2"), (1, 2, "m/b/c", 0, True, None), (1, 3, "m/new", 420, False, b"N"), (1, 4, "p", 420, False, b"P"), (2, 1, "n/x", 0, True, None), (2, 2, "n/y", 0, True, None)]
    frame = spark.createDataFrame(batch, "project long, seq long, path string, mode long, deleted boolean, content binary").withColumn("size", F.octet_length("content").cast("long"))
    state, _ = mutate.update_batch(_fixed_store(spark), frame)
    return _plain_members(reads.get_objects(state.objects, state.contents, state.projects, ObjectQuery(is_prefix=True)))


@query("""select * from (values (1, 0, 'm2', false), (1, 0, 'gone', true), (1, null, 'm/a', false), (1, null, 'm/b/c', false), (1, null, 'm/e/', false), (1, null, 'm/l', false)) t(project, chunk, path, deleted)""", store=False)
def get_tars_case(spark, sf_dir):
    """The entries of the TARs that lead from version 0 to 2: one chunk, with a tombstone, and a pack alone."""
    state = _fixed_store(spark)
    more = spark.createDataFrame([(1, 1, 2, "gone", "f", 420, 1, False), (1, 1, 2, "m2", "f", 420, 1, False), (1, 2, None, "m2", "f", 493, 1, False)], state.objects.schema)
    later = state.objects.where("project = 1").withColumn("start_version", F.when(F.col("packed"), 2).otherwise(F.col("start_version")).cast("long")).where("path <> 'm2'").unionByName(more)
    tars = tarstream.get_tars(later, state.contents, spark.createDataFrame([], "version long, hashes array<string>"), ObjectQuery(is_prefix=True), 1, 2)
    entries = packs.expand_packs(tars.select("project", F.coalesce("pack_path", F.lit("")).alias("path"), F.col("bytes").alias("content")))
    return entries.select(F.col("project").cast("int").alias("project"), F.when(F.col("pack_path") == "", 0).alias("chunk"), "path", "deleted")


@query()
def tar_bytes(spark, sf_dir):
    t = derived(spark, sf_dir)
    rows = cache.with_cached(temporal.snapshot(t.objects, 15), t.cache_versions, [1])
    rows = reads.with_content(rows.where(~F.col("packed") | F.col("is_cached")), t.contents)
    sized = rows.withColumn("deleted", F.lit(False)).withColumn("alone", F.lit(False)).withColumn(
        "bytes", tarstream.accounted(F.col("path"), F.col("mode"), F.octet_length("content"), F.lit(False)))
    chunks = tarstream.tar_chunks(sized.select("project", "path", "alone", "bytes"), limit=2000).select("project", "path", "chunk")
    return tarstream.tar_bytes(sized.drop("alone", "bytes").join(chunks, ["project", "path"]))


@query()
def get_tars(spark, sf_dir):
    t = given(spark, sf_dir)
    return tarstream.get_tars(t.objects, t.contents, t.cache_versions, ObjectQuery(is_prefix=True), 10, 20, [2]).select("project", "chunk", "pack_path", F.octet_length("bytes").alias("n_bytes"))


_CHUNKS = """
with recursive rows_ as (
  select project, path, cast(strlen(path) + case when mode & 2147483648 <> 0 or mode & 134217728 <> 0 then 0 else greatest(coalesce(size, 0), 0) end as bigint) as n,
    row_number() over (partition by project order by path) as k
  from (select project, path, max(mode) as mode, max(size) as size from objects where not packed and stop_version is null and start_version > 0 group by project, path) t),
fold(project, path, k, so_far, chunk) as (
  select project, path, k, n, cast(0 as bigint) from rows_ where k = 1
  union all
  select r.project, r.path, r.k, case when f.so_far > 524288 then r.n else f.so_far + r.n end, f.chunk + case when f.so_far > 524288 then 1 else 0 end
  from fold f join rows_ r on r.project = f.project and r.k = f.k + 1)
select project, chunk, path, so_far as bytes_so_far from fold"""


@query(_CHUNKS, store=False)
def tar_chunks(spark, sf_dir):
    live = given(spark, sf_dir).objects.where(~F.col("packed") & F.col("stop_version").isNull() & (F.col("start_version") > 0))
    one = live.groupBy("project", "path").agg(F.max("mode").alias("mode"), F.max("size").alias("size"))
    size = tarstream.accounted(F.col("path"), F.col("mode"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)), F.lit(False))
    rows = one.select("project", "path", F.lit(False).alias("alone"), size.alias("bytes"))
    return tarstream.tar_chunks(rows).select("project", "chunk", "path", "bytes_so_far")


@query("select chunk, path from (values (0, 'a'), (0, 'b'), (1, 'c'), (1, 'd')) t(chunk, path)", store=False)
def tar_chunks_case(spark, sf_dir):
    rows = spark.createDataFrame([(1, p, False, 500_000) for p in "abcd"], "project long, path string, alone boolean, bytes long")
    return tarstream.tar_chunks(rows, segments=3).select(F.col("chunk").cast("int").alias("chunk"), "path")


@query("""select chunk, left(path, 1) as kind, strlen(path) as path_bytes, so_far from (values
  (0, repeat('a', 9), 9), (0, repeat('b', 9), 18), (0, repeat('c', 3), 21), (1, repeat('d', 15), 15), (1, repeat('e', 1), 20), (1, repeat('f', 1), 21), (2, repeat('g', 2), 2)) t(chunk, path, so_far)""", store=False)
def tar_accounting_case(spark, sf_dir):
    """Directories, symlinks and tombstones count by their paths; with a limit of 20 a chunk ends beyond 20 bytes."""
    rows = [("a" * 9, 1 << 31, 7, False), ("b" * 9, 1 << 27, 7, False), ("c" * 3, 420, 7, True), ("d" * 15, 1 << 31, 0, True), ("e", 420, 4, False), ("f", 420, 0, False), ("gg", 420, None, False)]
    frame = spark.createDataFrame(rows, "path string, mode long, n long, deleted boolean")
    size = tarstream.accounted(F.col("path"), F.col("mode"), F.col("n"), F.col("deleted"))
    placed = tarstream.tar_chunks(frame.select(F.lit(1).alias("project"), "path", F.lit(False).alias("alone"), size.alias("bytes")), limit=20, segments=3)
    return placed.select(F.col("chunk").cast("int").alias("chunk"), F.left("path", F.lit(1)).alias("kind"), F.octet_length("path").cast("long").alias("path_bytes"), F.col("bytes_so_far").cast("int").alias("so_far"))


# --- caches

@query("select hash, count(*) as n from objects where stop_version is null and packed and path like 'd2/%' group by hash order by n desc, hash limit 10")
def cache_topk(spark, sf_dir):
    return cache.top_packs(derived(spark, sf_dir).objects, "d2/", 10)


@query("select hash, count(*) as n from objects where stop_version is null and packed group by hash order by n desc, hash limit 10", store=False)
def cache_topk_given(spark, sf_dir):
    return cache.top_packs(given(spark, sf_dir).objects, "", 10)


@query("""select (select coalesce(max(version), 0) + 1 from cache_versions) as version, list(hash order by hash) as hashes from (
  select hash from objects where stop_version is null and packed group by hash order by count(*) desc, hash limit 10) t""", store=False)
def create_cache(spark, sf_dir):
    t = given(spark, sf_dir)
    return cache.create_cache(t.objects, t.cache_versions, "", 10)


@query("select distinct hash from cache_versions where version in (1, 2)")
def cached_hashes(spark, sf_dir):
    return cache.cached_hashes(derived(spark, sf_dir).cache_versions, [1, 2])


@query(f"select project, path, hash, hash in (select hash from cache_versions where version = 1) as is_cached from objects where {LIVE15}")
def snapshot_cached(spark, sf_dir):
    t = derived(spark, sf_dir)
    return cache.with_cached(temporal.snapshot(t.objects, 15), t.cache_versions, [1]).select("project", "path", "hash", "is_cached")


@query("select version, hash, content from cache_versions join contents using (hash) where version = 1")
def get_cache(spark, sf_dir):
    t = derived(spark, sf_dir)
    return cache.get_cache(t.cache_versions, t.contents, 1).withColumn("content", F.col("content").cast("string"))


@query("select version, hash, content from cache_versions join contents using (hash) where version = (select max(version) from cache_versions)")
def get_cache_latest(spark, sf_dir):
    t = derived(spark, sf_dir)
    return cache.get_cache(t.cache_versions, t.contents).withColumn("content", F.col("content").cast("string"))


# --- writes

@query("""select id, latest_version from projects union all select 1000001, 0 union all select 1000002, 0""")
def new_project(spark, sf_dir):
    state = derived(spark, sf_dir).state
    for project, patterns in ((1000001, None), (1000002, ["^pack1/.*/"])):
        state = mutate.new_project(state, project, patterns)
    return state.projects.select("id", "latest_version")


@query("""select a, b, same from (values (1, 2, true), (1, 3, false), (3, 3, true), (1, 9, true), (3, 4, false)) t(a, b, same)""", store=False)
def same_patterns(spark, sf_dir):
    projects = spark.createDataFrame([(1, 0, None), (2, 0, []), (3, 0, ["x/", "y/"]), (4, 0, ["y/", "x/"])], "id long, latest_version long, pack_patterns array<string>")
    return spark.createDataFrame([(a, b, mutate.same_patterns(projects, a, b)) for a, b in ((1, 2), (1, 3), (3, 3), (1, 9), (3, 4))], "a int, b int, same boolean")


@query("select 1000001 as project, start_version, path, hash from objects where project = 1 and stop_version is null")
def template_copy(spark, sf_dir):
    state = mutate.new_project(derived(spark, sf_dir).state, 1000001, template=1)
    return state.objects.where("project = 1000001").select(F.col("project").cast("int").alias("project"), "start_version", "path", "hash")


@query(f"""select project, start_version, case when stop_version is null and path in ('d0/f0', 'd1') then latest_version + 1 else stop_version end as stop_version, path, hash, mode, size, packed
from objects o join projects p on p.id = o.project""")
def delete_objects(spark, sf_dir):
    t = derived(spark, sf_dir)
    versions = t.projects.select(F.col("id").alias("project"), (F.col("latest_version") + 1).alias("version"))
    keys = t.projects.select(F.col("id").alias("project"), F.explode(F.array(F.lit("d0/f0"), F.lit("d1"))).alias("path"))
    return mutate.close_rows(t.objects, keys, versions).select(FULL)


def _batch(spark, sf_dir):
    """All events as one batch."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project"), F.col("event_id").alias("seq"),
        F.expr("""case when event_id % 11 = 0 then concat('d', event_id % 3, '/')
          when event_id % 11 = 1 then concat('d', event_id % 3) else concat('d', event_id % 3, '/f', event_id % 5) end""").alias("path"),
        F.lit(493).cast("long").alias("mode"), F.length("props").cast("long").alias("size"),
        (F.col("event_type") == "error").alias("deleted"), F.col("props").cast("binary").alias("content"))


_BATCH = """
batch as (
  select user_id as project, event_id as seq,
    case when event_id % 11 = 0 then concat('d', event_id % 3, '/') when event_id % 11 = 1 then concat('d', event_id % 3) else concat('d', event_id % 3, '/f', event_id % 5) end as path,
    cast(493 as bigint) as mode, cast(length(props) as bigint) as size, event_type = 'error' as deleted, sha256(props) as hash
  from main.events),
gone as (select distinct project, path from batch where deleted),
after_ as (
  select o.project, start_version, case when stop_version is null and g.path is not null then latest_version + 1 else stop_version end as stop_version, o.path, hash, mode, size, packed
  from objects o join projects p on p.id = o.project left join gone g on g.project = o.project and g.path = o.path),
writes as (select * from (select *, row_number() over (partition by project, path order by seq desc) as rn from batch where not deleted) t where rn = 1),
inserted as (
  select w.project, p.latest_version + 1 as start_version, cast(null as bigint) as stop_version, w.path, w.hash, w.mode, w.size, false as packed
  from writes w join projects p on p.id = w.project
  where not exists (select 1 from after_ a where a.project = w.project and a.path = w.path and a.hash = w.hash and a.mode = w.mode and a.stop_version is null)),
final_ as (
  select project, start_version, case when stop_version is null and exists (
      select 1 from inserted i where i.project = a.project and (i.path = a.path or (right(a.path, 1) = '/' and starts_with(i.path, a.path))))
    then (select latest_version + 1 from projects p where p.id = a.project) else stop_version end as stop_version, path, hash, mode, size, packed
  from after_ a union all select * from inserted)
"""


@query(f"{_BATCH} select {FULL_SQL} from final_")
def update_objects(spark, sf_dir):
    t, batch = derived(spark, sf_dir), _batch(spark, sf_dir)
    return mutate.update_objects(t.objects, batch, mutate.next_versions(t.projects, batch)).select(FULL)


@query(f"""{_BATCH} select id as project, latest_version + case when exists (select 1 from gone g where g.project = id) or exists (select 1 from inserted i where i.project = id) then 1 else 0 end as version
from projects where id in (select project from batch)""")
def update_batch(spark, sf_dir):
    t = derived(spark, sf_dir)
    return mutate.update_batch(t.state, _batch(spark, sf_dir))[1]


@query(f"{_BATCH} select {FULL_SQL} from final_")
def update_stream(spark, sf_dir):
    """The same batch through a file stream into a store on disk."""
    from arbordelta.sources.storage import Store
    from arbordelta.streaming.ingest import start_ingest

    folder, t = scratch_folder(spark, "stream"), derived(spark, sf_dir)
    store = Store(spark, f"{folder}/store")
    store.commit(0, {"projects": t.projects, "objects": t.objects, "contents": t.contents})
    _batch(spark, sf_dir).coalesce(1).write.parquet(f"{folder}/feed")
    changes = spark.readStream.schema(UPDATES).parquet(f"{folder}/feed")
    start_ingest(changes, store, f"{folder}/checkpoint").awaitTermination()
    return store.table("objects").select(FULL)


@query()
def update_packed(spark, sf_dir):
    """A batch on the given store, of which part goes into packs."""
    t = given(spark, sf_dir)
    members = packs.expand_packs(_live_packs(spark, sf_dir))
    batch = members.select("project", F.xxhash64("path").alias("seq"), "path", "mode", "size", (F.xxhash64("path") % 5 == 0).alias("deleted"), F.encode(F.col("path"), "utf-8").alias("content"))
    state, _ = mutate.update_batch(t.state, batch)
    return state.objects.where("packed").select(FULL)


@query("select path from objects where path like 'd0%' or path like 'd2/f%'")
def update_subpaths(spark, sf_dir):
    return derived(spark, sf_dir).objects.where(starts_with_any(F.col("path"), ["d0", "d2/f"])).select("path")


_CLONE = f"""
theirs as (select path, mode, size, packed, hash from objects where project = 1 and {LIVE.format(f=0, t=10)}),
to_remove as (select path, mode, size, packed, hash from objects where project = 2 and stop_version is null except select * from theirs)
"""


@query(f"{_CLONE} select * from to_remove")
def clone_to_remove(spark, sf_dir):
    return mutate.clone_to_remove(derived(spark, sf_dir).objects, 1, 2, 10)


@query(f"""{_CLONE},
closed as (
  select project, start_version, case when stop_version is null and path in (select path from to_remove) then (select latest_version + 1 from projects where id = 2) else stop_version end as stop_version,
    path, hash, mode, size, packed from objects where project = 2)
select * from closed
union all select 2, (select latest_version + 1 from projects where id = 2), null, path, hash, mode, size, packed from theirs t
where not exists (select 1 from closed c where c.stop_version is null and c.path = t.path and c.hash = t.hash and c.mode = t.mode)""")
def clone_project(spark, sf_dir):
    return mutate.clone_project(derived(spark, sf_dir).state, 1, 2, 10).objects.where("project = 2").select(FULL)


@query("""select project, start_version, case when stop_version <= 12 then stop_version end as stop_version, path, hash, mode, size, packed from objects where start_version <= 12""")
def rollback(spark, sf_dir):
    return mutate.rollback_objects(derived(spark, sf_dir).objects, 12).select(FULL)


@query("""select project, start_version, case when stop_version <= 5 then stop_version end as stop_version, path, hash, mode, size, packed from objects where start_version <= 5 and project between 1 and 10""")
def reset_to_state(spark, sf_dir):
    return mutate.reset(derived(spark, sf_dir).state, [(p, 5) for p in range(1, 11)]).objects.select(FULL)


@query(f"select {FULL_SQL} from objects where project between 1 and 10")
def drop_other_projects(spark, sf_dir):
    return mutate.drop_other_projects(derived(spark, sf_dir).state, range(1, 11)).objects.select(FULL)


@query("select project from objects where project <> 3")
def delete_project(spark, sf_dir):
    return mutate.delete_project(derived(spark, sf_dir).state, 3).objects.select("project")


@query("select id, latest_version from projects", store=False)
def list_projects(spark, sf_dir):
    return given(spark, sf_dir).projects.select("id", "latest_version")


@query("select string_agg(id || '=' || latest_version, ',' order by id) as state from projects")
def snapshot_state(spark, sf_dir):
    return mutate.snapshot_state(derived(spark, sf_dir).projects)


# --- collection

_EXPIRED = "start_version > {f} and stop_version is not null and stop_version <= latest_version - 5"


@query(f"select project, hash from objects o join projects p on p.id = o.project where project = 1 and {_EXPIRED.format(f=0)}")
def gc_project_rows(spark, sf_dir):
    t = derived(spark, sf_dir)
    return gc.gc_rows(t.objects, t.projects.where("id = 1"), 5)[1].select("project", "hash")


@query(f"select project, hash from objects o join projects p on p.id = o.project where {_EXPIRED.format(f=2)}")
def gc_all_rows(spark, sf_dir):
    t = derived(spark, sf_dir)
    return gc.gc_rows(t.objects, t.projects, 5, 2)[1].select("project", "hash")


@query(f"select project, hash from objects o join projects p on p.id = o.project where {_EXPIRED.format(f=0)}", store=False)
def gc_all_rows_given(spark, sf_dir):
    t = given(spark, sf_dir)
    return gc.gc_rows(t.objects, t.projects, 5)[1].select("project", "hash")


_LOST = f"""
marked as (select o.project, o.hash, {_EXPIRED.format(f=0)} as old from objects o join projects p on p.id = o.project),
lost as (select distinct hash from marked where old and hash not in (select hash from marked where not coalesce(old, false)))
"""


@query(f"{_LOST} select hash from lost", unique=True)
def gc_orphans(spark, sf_dir):
    t = derived(spark, sf_dir, unique=True)
    kept, dropped = gc.gc_rows(t.objects, t.projects, 5)
    return gc.orphans(dropped, kept)


@query(f"{_LOST} select count(*) as count from lost where hash in (select hash from contents)", unique=True)
def gc_project(spark, sf_dir):
    t = derived(spark, sf_dir, unique=True)
    return gc.gc(t.state, t.projects, 5)[1].agg(F.count(F.lit(1)).alias("count"))


@query("select count(*) as count from contents where hash not in (select hash from objects where hash is not null)", store=False)
def gc_contents(spark, sf_dir):
    return gc.gc_contents(given(spark, sf_dir).state, 100)[1].agg(F.count(F.lit(1)).alias("count"))


@query()
def gc_random(spark, sf_dir):
    t = derived(spark, sf_dir, unique=True)
    return gc.gc(t.state, gc.sample_projects(t.projects, 25, 42), 5)[1]


@query()
def sample_projects(spark, sf_dir):
    return gc.sample_projects(given(spark, sf_dir).projects, 25, 42).select("id", "latest_version")


@query()
def sample_contents(spark, sf_dir):
    return gc.sample(given(spark, sf_dir).contents, 25, 42).select("hash")


# --- trees

_TWO = "a as (select project, path, hash, mode from objects where {a}), b as (select project, path, hash, mode from objects where {b})"


@query(_TWO.format(a=LIVE.format(f=0, t=10), b=LIVE.format(f=0, t=20)) + """
select coalesce(b.project, a.project) as project, coalesce(b.path, a.path) as path, case when a.path is null then 'add' when b.path is null then 'remove' else 'modify' end as action
from a full join b on a.project = b.project and a.path = b.path where a.path is null or b.path is null or a.hash <> b.hash or a.mode <> b.mode""")
def dir_diff(spark, sf_dir):
    objects = derived(spark, sf_dir).objects
    return tree.dir_diff(temporal.snapshot(objects, 10), temporal.snapshot(objects, 20), ["project", "path"])


_TREE = """
live as (
  select project, path, coalesce(mode, 0) & 511 as mode, coalesce(c.bytes, ''::blob) as bytes from (
    select project, path, max(mode) as mode, max(lower(trim(hash))) as hash from objects
    where stop_version is null and start_version > 0 and not packed and project is not null and path is not null and (coalesce(mode, 0) & 2147483648) = 0 and (coalesce(mode, 0) & 134217728) = 0
    group by project, path) o left join contents c on lower(trim(c.hash)) = o.hash),
plain as (select * from live l where path not like '%/' and path not like '/%' and path not like '%//%' and path not like '%..%'
  and not exists (select 1 from live m where m.project = l.project and starts_with(m.path, l.path || '/'))
)
"""


@query(f"with {_TREE.strip()} select project || '/' || path as path, sha256(bytes) as hash, octet_length(bytes) as size from plain", store=False)
def scan_dir(spark, sf_dir):
    """The live plain files of all projects, written as one tree by the executors and scanned again."""
    t = given(spark, sf_dir)
    mode = F.coalesce(F.col("mode"), F.lit(0))
    live = t.objects.where(
        F.col("stop_version").isNull() & (F.col("start_version") > 0) & ~F.col("packed") & F.col("project").isNotNull() & F.col("path").isNotNull() & (mode.bitwiseAND(DIR_BIT | LINK_BIT) == 0))
    live = live.groupBy("project", "path").agg(F.max("mode").alias("mode"), F.max(F.lower(F.trim("hash"))).alias("hash"))
    above = live.select(F.col("project").alias("_p"), F.explode(slash_prefixes(F.col("path"))).alias("_d")).select("_p", F.expr("left(_d, length(_d) - 1)").alias("_d")).distinct()
    files = live.where(~F.col("path").rlike("^/|/$|//|[.][.]")).join(above, (F.col("project") == F.col("_p")) & (F.col("path") == F.col("_d")), "left_anti")
    blobs = t.contents.select(F.lower(F.trim("hash")).alias("_h"), "bytes")
    rows = files.join(blobs, F.col("hash") == F.col("_h"), "left").select(
        F.concat(F.col("project").cast("string"), F.lit("/"), "path").alias("path"), F.lit(420).cast("long").alias("mode"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("deleted"), F.col("bytes").alias("content"))
    shared_path(spark)
    root = scratch_folder(spark, "tree").removeprefix("file:")
    root = "/" + root.lstrip("/")
    tree.materialize(rows, root)
    return tree.scan_dir(spark, root).where(~F.col("deleted")).select("path", content_hash(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"))
