"""Cache versions: named sets of the packs that most projects share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_packs(objects: DataFrame, prefix: str, count: int) -> DataFrame:
    """(hash, n) of the `count` hashes that most live packs below the prefix have; ties by hash."""
    live = objects.where(F.col("stop_version").isNull() & F.col("packed") & F.col("path").startswith(prefix))
    return live.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hash").limit(count)


def create_cache(objects: DataFrame, cache_versions: DataFrame, prefix: str, count: int) -> DataFrame:
    """The one row to append to cache_versions; its list may be empty."""
    hashes = top_packs(objects, prefix, count).agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    version = cache_versions.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("long").alias("version"))
    return hashes.select(version.scalar().alias("version"), "hashes")


def cached_hashes(cache_versions: DataFrame, versions: list[int]) -> DataFrame:
    return cache_versions.where(F.col("version").isin(versions)).select(F.explode("hashes").alias("hash")).distinct()


def with_cached(rows: DataFrame, cache_versions: DataFrame, versions: list[int]) -> DataFrame:
    """rows with is_cached."""
    known = cached_hashes(cache_versions, versions).select(F.col("hash").alias("_h"))
    return rows.join(known, F.col("hash") == F.col("_h"), "left").withColumn("is_cached", F.col("_h").isNotNull()).drop("_h")


def get_cache(cache_versions: DataFrame, contents: DataFrame, version: int | None = None) -> DataFrame:
    """(version, hash, content) of a cache version, by default the latest; hashes without contents are left out."""
    wanted = F.col("version") == version if version is not None else F.col("version") == cache_versions.agg(F.max("version").alias("v")).scalar()
    named = cache_versions.where(wanted).select("version", F.explode("hashes").alias("hash")).distinct()
    return named.join(contents.select("hash", F.col("bytes").alias("content")), "hash").select("version", "hash", "content")
