"""References to rows that are missing, or came later than the row that refers.

The distinct keys of the referring table, each with the earliest moment it was
referred to, are anti-joined with the parents' keys, and inner-joined to find
parents that came later than that moment.  Only those broken keys are joined
back to the referring rows.  The distinct step is a partial aggregation, so a
key in a third of the rows is one row per task; in the join back the broken key
is unique, and the referring side's hot partitions are split by adaptive
execution.  The referring table is read twice, for its keys and for the join
back, however many references it has.

Defined results.  Null keys refer to nothing and are no case.  Hashes are
compared in lower case without spaces around them, and 64 zeros refer to nothing.
A parent is late if it was loaded after the referring row; a null time on
either side is not late.  Repeated parents count with their earliest time.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordelta.schema import ZERO_HASH
from arbordelta.sources.scratch import written


def normal_hash(hash_: Column) -> Column:
    return F.lower(F.trim(hash_))


class Reference(NamedTuple):
    """A column of the referring table, in normal form, and where its parents are; table names have no colon."""

    table: str
    key: Column
    parents: DataFrame
    parent_key: Column

    def named(self, key: Column) -> Column:
        return F.concat(key.cast("string"), F.lit(f":{self.table}"))  # what differs comes first, for the sorts


def broken_keys(rows: DataFrame, references: list[Reference]) -> DataFrame:
    """(key, came) of keys whose parent is missing, with a null came, or later than the first row that refers to it.

    One pass over `rows` gives the keys of all references, named `key:table`.
    The anti-join, of keys without a parent in time, and the join, which says
    when a late one came, read the same two exchanges, and need no others.
    """
    keys = rows.select(F.explode(F.array(*[r.named(r.key) for r in references])).alias("key"), "loaded_at").where("key is not null").groupBy("key").agg(F.min("loaded_at").alias("first"))
    parents = [r.parents.select(r.named(r.parent_key).alias("_key"), "loaded_at") for r in references]
    known = reduce(DataFrame.unionByName, parents).where("_key is not null").groupBy("_key").agg(F.min("loaded_at").alias("came"))
    same, late = F.col("key") == F.col("_key"), F.coalesce(F.col("came") > F.col("first"), F.lit(False))
    broken = keys.join(known, same & ~late, "left_anti").select("key", F.lit(None).cast(known.schema["came"].dataType).alias("came"))
    came = keys.join(known, same & late).select("key", "came")
    return written(broken.unionByName(came).groupBy("key").agg(F.max("came").alias("came")), "broken")


def broken_references(rows: DataFrame, references: list[Reference]) -> DataFrame:
    """rows, with ref_table, state (`missing`, `late`) and period, once for each broken reference."""
    broken = broken_keys(rows, references)
    joined = rows
    for i, r in enumerate(references):
        own = broken.where(F.col("key").endswith(f":{r.table}")).select(F.col("key").alias(f"_k{i}"), F.struct(F.lit(r.table).alias("ref_table"), "came").alias(f"_b{i}"))
        # Rows that refer to nothing are spread by what they are: a null key would take them all to one task.
        key = F.coalesce(r.named(r.key), F.xxhash64(*rows.columns).cast("string"))
        joined = joined.join(own, key == F.col(f"_k{i}"), "left")
    hit = F.explode(F.array_compact(F.array(*[F.col(f"_b{i}") for i in range(len(references))]))).alias("_b")
    came = F.col("_b.came")
    return joined.select(*rows.columns, hit).where(came.isNull() | (F.col("loaded_at") < came)).select(
        *rows.columns, F.col("_b.ref_table").alias("ref_table"), F.when(came.isNull(), "missing").otherwise("late").alias("state"),
        F.date_format("loaded_at", "yyyy-MM").alias("period"))


def orphan_rows(objects: DataFrame, contents: DataFrame, projects: DataFrame) -> DataFrame:
    """(ref_table, state, period, project, start_version, path), distinct."""
    rows = objects.select("project", "start_version", "path", "hash", "loaded_at")
    hash_ = normal_hash(F.col("hash"))
    found = broken_references(rows, [
        Reference("projects", F.col("project"), projects, F.col("id")),
        Reference("contents", F.when(hash_ != ZERO_HASH, hash_), contents, hash_)])
    return found.select("ref_table", "state", "period", "project", "start_version", "path").distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(ref_table, state, period, n)."""
    return orphans.groupBy("ref_table", "state", "period").agg(F.count(F.lit(1)).alias("n"))
