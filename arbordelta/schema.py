"""Column names, types and constants of the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIR_BIT = 2147483648
LINK_BIT = 134217728
PERMISSION_BITS = 511
ZERO_HASH = "0" * 64

PROJECTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("latest_version", T.LongType()),
    T.StructField("pack_patterns", T.ArrayType(T.StringType())),
])
OBJECTS = T.StructType([
    T.StructField("project", T.LongType()),
    T.StructField("start_version", T.LongType()),
    T.StructField("stop_version", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("mode", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("packed", T.BooleanType()),
])
CONTENTS = T.StructType([T.StructField("hash", T.StringType()), T.StructField("bytes", T.BinaryType())])
CACHE_VERSIONS = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("hashes", T.ArrayType(T.StringType())),
])
UPDATES = T.StructType([
    T.StructField("project", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("mode", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("content", T.BinaryType()),
])
#: A member of a pack, or an object as it is read.
MEMBER = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mode", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("content", T.BinaryType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
