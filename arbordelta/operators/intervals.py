"""Continuous periods and gaps of half-open intervals, in two levels.

Time is cut into shards of 2**bits versions.  Each interval is clipped to the
shards it begins and ends in, so it never becomes more than two rows; how far it
goes on through whole shards stays with the first of them.  Level 1 sorts and
merges the fragments of one (entity, shard).  Level 2 gets, of each shard, only
the periods that touch its edges, with their reach, and the hull of the others:
at most a few rows for each shard that an entity occupies, however many
intervals it has.  It stitches what touches and says which shards are covered
from end to end; in these the periods and gaps of level 1 are void.  Repeated
and equally clipped intervals are folded before the first shuffle.  The periods
of level 1 are written to the shared folder, as both levels read them.

Defined results.  Intervals with a null start, or a stop at or before the
start, are void; a null stop is an open end.  Touching intervals belong to one
period.  A period is `merged` if two intervals in it that differ share a
version.  Null keys are keys of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbordelta.sources.scratch import written

#: An open end.
OPEN = (1 << 63) - 1
#: 64 versions a shard: few enough that an entity's long history spreads over many tasks.
SHARD_BITS = 6


def _lower(shard: Column, bits: int) -> Column:
    return F.shiftleft(shard, bits)


def _upper(shard: Column, bits: int) -> Column:
    top = OPEN >> bits
    return F.when(shard >= top, F.lit(OPEN)).otherwise(F.shiftleft(F.least(shard, F.lit(top - 1)) + 1, bits))


def _clip(df: DataFrame, keys: list[str], start: str, stop: str, bits: int) -> DataFrame:
    """Fragments (keys, shard, lo, hi, reach, differ), equal ones folded.

    reach: where the whole shards end that a fragment's interval goes on through,
    OPEN for an open end; an interval with an end has a second fragment from there.
    """
    s, e = F.col("_s"), F.col("_e")
    ivs = df.select(*keys, F.col(start).alias("_s"), F.coalesce(F.col(stop), F.lit(OPEN)).alias("_e")).where(e > s)
    ivs = ivs.withColumn("_a", F.shiftright(s, bits)).withColumn("_b", F.shiftright(e - 1, bits))
    a, b = F.col("_a"), F.col("_b")
    ends = (a != b) & (e != OPEN)

    def piece(shard: Column, lo: Column, hi: Column, reach: Column) -> Column:
        return F.struct(shard.alias("shard"), lo.alias("lo"), hi.alias("hi"), reach.alias("reach"))

    first = piece(a, s, F.least(e, _upper(a, bits)), F.when(ends, _lower(b, bits)).otherwise(e))
    pieces = F.when(ends, F.array(first, piece(b, _lower(b, bits), e, e))).otherwise(F.array(first))
    return (
        ivs.select(*keys, "_s", "_e", F.explode(pieces).alias("p"))
        .groupBy(*keys, F.col("p.shard").alias("shard"), F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))
        .agg(F.max("p.reach").alias("reach"), F.min("_s").alias("s0"), F.max("_s").alias("s1"), F.min("_e").alias("e0"), F.max("_e").alias("e1"))
        .select(*keys, "shard", "lo", "hi", "reach", ((F.col("s0") < F.col("s1")) | (F.col("e0") < F.col("e1"))).alias("differ"))
    )


def _sweep(df: DataFrame, group: list[str]) -> DataFrame:
    """Adds run (number of the period in its group) and differ (it overlaps what came before)."""
    order = Window.partitionBy(*group).orderBy("lo", "hi", "shard")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("hi").over(before)
    return (
        df.withColumn("_reached", reached)
        .withColumn("differ", F.col("differ") | F.coalesce(F.col("lo") < F.col("_reached"), F.lit(False)))
        .withColumn("run", F.sum(F.when(F.col("_reached").isNull() | (F.col("lo") > F.col("_reached")), 1).otherwise(0)).over(order))
        .drop("_reached")
    )


def _levels(df: DataFrame, keys: list[str], start: str, stop: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """(level 1's inner periods, level 2's items swept by run)."""
    local = [*keys, "shard"]
    periods = _sweep(_clip(df, keys, start, stop, bits), local).groupBy(*local, "run").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("reach").alias("reach"), F.max("differ").alias("differ"))
    shard = F.col("shard")
    # Both levels go on from here: written once, not swept twice.
    periods = written(periods.withColumn("inner", (F.col("lo") > _lower(shard, bits)) & (F.col("hi") < _upper(shard, bits))), "periods")
    hulls = periods.groupBy(*local, "inner", F.when(~F.col("inner"), F.col("run")).alias("_own")).agg(
        F.min("lo").alias("lo"), F.max("reach").alias("hi"), F.max(F.col("differ") & ~F.col("inner")).alias("differ"))
    swept = _sweep(hulls.select(*keys, "shard", "inner", "lo", "hi", "differ"), keys)
    return periods.where("inner"), swept


def _with_gaps(periods: DataFrame, keep: list[str], is_period: Column) -> DataFrame:
    """(keep, kind, from_version, to_version, differ): the periods for which is_period holds, and the gap before each."""
    parts = F.array_compact(F.array(
        F.when(is_period, F.struct(F.lit("period").alias("kind"), F.col("lo").alias("from_version"), F.col("hi").alias("to_version"), F.col("differ").alias("differ"))),
        F.when(F.col("before").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("before").alias("from_version"), F.col("lo").alias("to_version"), F.lit(False).alias("differ"))),
    ))
    return periods.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.*")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start_version", stop: str = "stop_version", bits: int = SHARD_BITS) -> DataFrame:
    """(keys, kind, from_version, to_version, differ): kind `period` or `gap`; to_version is OPEN at an open end."""
    inner, swept = _levels(df, keys, start, stop, bits)
    swept = swept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))
    # An inner hull in a run with others lies in a shard that one interval covers: they share versions.
    swallowed = F.col("inner") & F.col("differ") & (F.col("_n") > 1)
    covered = swept.where(swallowed).select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("shard").alias("_c_shard"))
    runs = swept.groupBy(*keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("differ").alias("differ"), F.min("inner").alias("only_inner"))
    runs = runs.withColumn("before", F.lag("hi").over(Window.partitionBy(*keys).orderBy("lo")))
    stitched = _with_gaps(runs, keys, ~F.col("only_inner"))
    local = Window.partitionBy(*keys, "shard").orderBy("lo")
    within = _with_gaps(inner.withColumn("before", F.lag("hi").over(local)), [*keys, "shard"], F.lit(True))
    same = F.col("shard") == F.col("_c_shard")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    within = within.join(covered, same, "left_anti").drop("shard")
    return stitched.unionByName(within)


def merged_and_gaps(objects: DataFrame, bits: int = SHARD_BITS) -> DataFrame:
    """(project, path, kind, from_version, to_version) with kinds `merged` and `gap`; an open end is -1."""
    found = periods_and_gaps(objects, ["project", "path"], bits=bits).where((F.col("kind") == "gap") | F.col("differ"))
    return found.select(
        "project", "path", F.when(F.col("kind") == "gap", "gap").otherwise("merged").alias("kind"), "from_version",
        F.when(F.col("to_version") == OPEN, F.lit(-1).cast("long")).otherwise(F.col("to_version")).alias("to_version"))
