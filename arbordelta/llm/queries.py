"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordelta.llm import contamination, packing, shared_spans, tokenise
from arbordelta.operators.compaction import live_objects
from arbordelta.schema import table

TAR_CAPACITY = 16_384
OBJECT_CAPACITY = 524_288


def _tar_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_items(table(spark, sf_dir, "tar_objects"), ["tar_id"], F.octet_length("content"), TAR_CAPACITY)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.divided(_tar_placements(spark, sf_dir), ["tar_id"])


def p2_tar_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tar_placements(spark, sf_dir)


def p2_object_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_items(live_objects(table(spark, sf_dir, "objects")), ["project", "path"], F.col("size"), OBJECT_CAPACITY)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.token_ids(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_stretches(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_characters(shared_spans.shared_stretches(table(spark, sf_dir, "documents")))


def p9_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.clusters(table(spark, sf_dir, "documents"))


def p9_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.cluster_removals(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_tar_placements, p2_object_placements, p7_ids, p8_found, p8_spans, p9_found, p9_shared, p9_clusters, p9_removals)}

_PASSAGES = """
passages as (
  select doc_id, i, substring(text, i, 300) as s
  from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300) t),
found as (select s, min(doc_id) as low from passages group by s having min(doc_id) < max(doc_id)),
hits as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from passages p join found f on f.s = p.s)
"""
_REACH = f"""
with recursive {_PASSAGES.strip()},
links as (select distinct p.doc_id as a, f.low as b from passages p join found f on f.s = p.s),
both_ as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ union select r.a, x.b from reach r join both_ x on x.a = r.b)"""
_SHARED = f"with {_PASSAGES.strip()}\n"

ORACLE = {
    "p2_found": "select distinct tar_id from tar_objects where octet_length(content) > 16384",
    "p8_found": """
with d as (select doc_id as id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as t from documents),
b as (select item_id as id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as t from benchmark),
dp as (select distinct id, substring(t, i, 60) as s from (select id, t, unnest(range(1, length(t) - 58)) as i from d where length(t) >= 60) x),
bp as (select distinct id, substring(t, i, 60) as s from (select id, t, unnest(range(1, length(t) - 58)) as i from b where length(t) >= 60) x)
select distinct dp.id as doc_id, bp.id as item_id from dp join bp on dp.s = bp.s""",
    "p9_found": _SHARED + "select distinct doc_id from hits",
    "p9_shared": _SHARED + """
select doc_id, cast(sum(least(300, i - coalesce(before, i - 300))) as bigint) as shared_chars,
  cast(count(*) filter (where before is null or i - before > 300) as bigint) as spans from hits group by doc_id""",
    "p9_clusters": _REACH + "\nselect a as doc_id, min(b) as cluster from reach group by a",
    "p9_removals": _REACH + """,
later as (select p.doc_id, i, lag(i) over (partition by p.doc_id order by i) as prev from passages p join found f on f.s = p.s where p.doc_id > f.low),
runs as (select doc_id, i, sum(case when prev is null or i - prev > 300 then 1 else 0 end) over (partition by doc_id order by i) as run from later),
spans as (select doc_id, run, min(i) - 1 as from_char, max(i) + 299 as to_char from runs group by doc_id, run)
select s.doc_id, c.cluster, s.from_char, s.to_char from spans s join (select a as doc_id, min(b) as cluster from reach group by a) c on c.doc_id = s.doc_id""",
}
