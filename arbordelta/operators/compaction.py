"""Size-tiered incremental compaction of small files.

Items are files and the packs of earlier rounds.  The class of an item is the
number of the policy's bounds that its size reaches.  A round merges like with
like: on level 0 the tiny files directly in one directory, once there are
`min_files` of them; on level k + 1 the items of class k of one project, once
there are `min_files` (class 0) or `fan_in` (the others) of them.  What is due
becomes packs of about `target` bytes, so a large bucket takes one step; which
pack an input goes to follows from a hash of the input and the number of packs
of its bucket, so no bucket is sorted or gathered.  Items that aren't due, and
packs that have reached the last bound, are left alone.

:class:`CompactionStore` keeps the packs.  A round is one transaction of the
journal, published by one exclusive rename, and records of each merge only what
it has written: the merge, its inputs, its output.  The tiers are read from the
journal: a round sees the live files that no pack holds, and the packs as they
are.  Members that are no longer live are recorded as dropped and don't count;
they leave with the next merge of their pack.  A round with nothing due and
nothing dropped publishes nothing, so repeating one changes nothing.

Defined results.  A live file is a (project, path) with a row whose
stop_version is null, packed is false and mode has neither the directory nor
the symlink bit (a null mode has none, a null packed is not false).  Of several
such rows the one with the highest (start_version, loaded_at, hash, size)
stands; a file is tiny, too, if any of them is.  Null and negative sizes take no
room and don't count towards `min_files`.  Null paths belong to no directory and
are left alone.  A live file whose contents are missing is kept with null bytes.
Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordelta.schema import DIR_BIT, LINK_BIT
from arbordelta.sources.commits import Commits
from arbordelta.sources.scratch import scratch_scope, written


@dataclass(frozen=True)
class TierPolicy:
    """target is at least the last bound; max_inputs: what one pack takes in at most, about."""

    bounds: tuple[int, ...] = (4096, 65536, 1048576, 16777216)
    min_files: int = 16
    fan_in: int = 4
    target: int = 16777216
    max_inputs: int = 65536


DEFAULT_POLICY = TierPolicy()


def directory(path: Column) -> Column:
    """The path up to and including its last slash, empty if it has none."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


def live_plain_rows(objects: DataFrame) -> DataFrame:
    mode = F.coalesce(F.col("mode"), F.lit(0))
    return objects.where(
        F.col("stop_version").isNull()
        & ~F.col("packed")
        & F.col("path").isNotNull()
        & (mode.bitwiseAND(DIR_BIT | LINK_BIT) == 0)
    )


def _newest(rows: DataFrame, tiny: int = 0) -> DataFrame:
    loaded = F.col("loaded_at") if "loaded_at" in rows.columns else F.lit(None).cast("timestamp")
    best = F.max(F.struct(F.col("start_version"), loaded.alias("loaded_at"), F.col("hash"), F.col("size")))
    counted = F.coalesce(F.max((F.col("size") >= 0) & (F.col("size") < tiny)), F.lit(False))
    return rows.groupBy("project", "path").agg(best.alias("b"), counted.alias("counted")).select(
        "project", "path", F.col("b.hash").alias("hash"), F.greatest(F.coalesce("b.size", F.lit(0)), F.lit(0)).cast("long").alias("size"), "counted")


def live_files(objects: DataFrame, policy: TierPolicy = DEFAULT_POLICY) -> DataFrame:
    """One row per live file: (project, path, hash, size, counted); counted: it counts as tiny towards `min_files`."""
    return _newest(live_plain_rows(objects), policy.bounds[0])


def live_objects(objects: DataFrame) -> DataFrame:
    """One row per (project, path) with an open row, packs, directories and symlinks included: (project, path, hash, size).

    Of several open rows the one stands that stands for a live file.  Null projects and paths are keys.
    """
    return _newest(objects.where(F.col("stop_version").isNull())).drop("counted")


def size_class(size: Column, policy: TierPolicy) -> Column:
    return sum((F.when(size >= b, 1).otherwise(0) for b in policy.bounds), F.lit(0))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\1", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]))


def _slots(n_bytes: Column, n_inputs: Column, policy: TierPolicy) -> Column:
    """How many packs a bucket gets: always fewer than inputs, so rounds come to an end."""
    wanted = F.greatest(F.lit(1).cast("long"), F.floor(n_bytes / F.lit(policy.target)).cast("long"), F.ceil(n_inputs / F.lit(policy.max_inputs)).cast("long"))
    return F.greatest(F.lit(1).cast("long"), F.least(wanted, n_inputs - 1))


MEMBER = "pack_id string, project long, path string, hash string, size long, bytes binary, tier int"


class Round(NamedTuple):
    """merges: (txn_id, level, project, dir_path, output, n_inputs, n_bytes, inputs_digest), one row per merge.

    moves: (output, new_tier, item, project, path, hash, size, tier), one row per input: a file has a path, a pack a tier.
    """

    merges: DataFrame
    moves: DataFrame


def locate(files: DataFrame, members: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(items, dropped): what the packs' members (pack_id, project, path, hash, tier) and the live files add up to.

    items: (item, project, path, hash, size, counted, tier), one row per loose file and per pack with live members.
    dropped: (pack_id, project, path) of members that are no longer live.
    """
    file_id = F.concat(F.lit("F-"), _digest(F.col("project"), F.col("path"), F.col("hash"))).alias("item")
    columns = ["item", "project", "path", "hash", "size", "counted", "tier"]
    if members is None:
        items = files.select(file_id, "*", F.lit(None).cast("int").alias("tier")).select(columns)
        return items, files.sparkSession.createDataFrame([], "pack_id string, project long, path string")
    held = members.select(F.col("project").alias("_p"), F.col("path").alias("_f"), F.col("hash").alias("_h"), "pack_id", "tier")
    same = F.col("project").eqNullSafe(F.col("_p")) & (F.col("path") == F.col("_f")) & F.col("hash").eqNullSafe(F.col("_h"))
    located = written(files.withColumn("live", F.lit(True)).join(held, same, "full_outer").select(
        F.when(F.col("live"), F.col("project")).otherwise(F.col("_p")).alias("project"), F.coalesce("path", "_f").alias("path"), F.coalesce("hash", "_h").alias("hash"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("counted", F.lit(False)).alias("counted"), F.coalesce("live", F.lit(False)).alias("live"), "pack_id", "tier"), "located")
    here = located.where("live")
    loose = here.where(F.col("pack_id").isNull()).select(file_id, "project", "path", "hash", "size", "counted", "tier")
    packs = here.where(F.col("pack_id").isNotNull()).groupBy("project", F.col("pack_id").alias("item")).agg(F.sum("size").alias("size"), F.max("tier").alias("tier"))
    return loose.unionByName(_as_items(packs)), located.where(~F.col("live")).select("pack_id", "project", "path")


def _as_items(packs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return packs.select("item", "project", none.alias("path"), none.alias("hash"), "size", F.lit(False).alias("counted"), "tier")


def plan_round(items: DataFrame, number: int, policy: TierPolicy = DEFAULT_POLICY, directories: bool = True) -> Round:
    """What round `number` merges of the items; without `directories`, no level 0.

    What each item becomes is written to the shared folder, as it is read several times.
    """
    tiny = F.col("path").isNotNull() & (F.col("counted") | (F.col("size") < policy.bounds[0]))
    none = F.lit(None).cast("string")
    if directories:
        items = items.withColumn("dir_path", F.when(tiny, directory(F.col("path"))))
        due = items.where(F.col("dir_path").isNotNull()).groupBy(F.col("project").alias("_dp"), F.col("dir_path").alias("_dir")).agg(
            F.count(F.when(F.col("counted"), 1)).alias("_n"), F.count(F.lit(1)).alias("_inputs"), F.sum("size").alias("_bytes")).where(F.col("_n") >= policy.min_files)
        due = due.select("_dp", "_dir", _slots(F.col("_bytes"), F.col("_inputs"), policy).alias("_slots"))
        slot = F.pmod(F.xxhash64("path"), F.col("_slots"))
        taken = F.col("_slots").isNotNull()
        items = items.join(due, F.col("project").eqNullSafe(F.col("_dp")) & (F.col("dir_path") == F.col("_dir")), "left").withColumn(
            "output", F.when(taken, F.concat(F.lit("P0-"), _digest(F.lit(number), F.col("project"), F.col("dir_path"), slot)))).withColumn(
            "dir_path", F.when(taken, F.col("dir_path"))).drop("_dp", "_dir", "_slots")
    else:
        items = items.withColumn("dir_path", none).withColumn("output", none)
    items = written(items.withColumn("class", size_class(F.col("size"), policy)), "items")

    rest = items.where(F.col("output").isNull() & (F.col("class") < len(policy.bounds)))
    like = rest.groupBy(F.col("project").alias("_lp"), F.col("class").alias("_class")).agg(F.count(F.lit(1)).alias("_inputs"), F.sum("size").alias("_bytes"))
    like = like.where(F.col("_inputs") >= F.when(F.col("_class") == 0, policy.min_files).otherwise(policy.fan_in)).select("_lp", "_class", _slots(F.col("_bytes"), F.col("_inputs"), policy).alias("_slots"))
    level = F.col("class") + 1
    by_class = rest.join(like, F.col("project").eqNullSafe(F.col("_lp")) & (F.col("class") == F.col("_class"))).withColumn(
        "output", F.concat(F.lit("P"), level.cast("string"), F.lit("-"), _digest(F.lit(number), F.col("project"), level, F.pmod(F.xxhash64("item"), F.col("_slots"))))).withColumn("level", level)
    columns = ["level", "project", "dir_path", "output", "item", "path", "hash", "size", "tier"]
    moved = by_class.select(columns)
    if directories:
        moved = items.where(F.col("output").isNotNull()).withColumn("level", F.lit(0)).select(columns).unionByName(moved)
    # A slot that only one input fell into is no merge.
    merges = moved.groupBy("level", "project", "dir_path", "output").agg(
        F.count(F.lit(1)).alias("n_inputs"), F.sum("size").alias("n_bytes"), F.bit_xor(F.xxhash64("item")).alias("inputs_digest")).where("n_inputs > 1")
    txn = _digest(F.lit(number), F.col("level"), F.col("output"), F.col("n_inputs"), F.col("n_bytes"), F.col("inputs_digest"))
    merges = written(merges.select(txn.alias("txn_id"), "*"), "merges")
    moves = moved.join(merges.select("output", size_class(F.col("n_bytes"), policy).cast("int").alias("new_tier")), "output")
    return Round(merges, moves.select("output", "new_tier", "item", "project", "path", "hash", "size", "tier"))


def items_after(items: DataFrame, done: Round, policy: TierPolicy = DEFAULT_POLICY) -> DataFrame:
    """The items once a round is done."""
    new = done.merges.select(F.col("output").alias("item"), "project", F.col("n_bytes").alias("size"), size_class(F.col("n_bytes"), policy).cast("int").alias("tier"))
    return items.join(done.moves.select("item"), "item", "left_anti").unionByName(_as_items(new)).where(F.col("size") < policy.bounds[-1])


class CompactionStore:
    """Packs and their journal below one shared folder.

    Every round writes to a folder of its own, which readers see once its entry
    is published; a published folder is never written again.  Pack ids and
    transaction ids hold the round's number, so none comes twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, self.root, "_journal")

    def rounds(self) -> list[int]:
        return self.commits.numbers()

    def _entry(self) -> dict[str, list[str]]:
        newest = self.commits.newest()
        return self.commits.read(newest) if newest else {"packs": [], "merges": [], "inputs": [], "dropped": []}

    def _read(self, kind: str, entry: dict | None = None) -> DataFrame | None:
        paths = (entry or self._entry())[kind]
        if not paths:
            return None
        if kind != "packs":
            return self.spark.read.parquet(*paths)
        return self.spark.read.schema(MEMBER).option("basePath", f"{self.root}/packs").parquet(*paths).drop("round")

    def journal(self) -> DataFrame | None:
        """(txn_id, level, project, dir_path, output, n_inputs, n_bytes, inputs_digest) of all merges."""
        return self._read("merges")

    def inputs(self) -> DataFrame | None:
        """(output, input) of all merges; files are named F-<digest of project, path and hash>."""
        return self._read("inputs")

    def packs(self, entry: dict | None = None, dropped: DataFrame | None = None) -> DataFrame | None:
        """What the packs hold of live files: (pack_id, project, path, hash, size, bytes, tier)."""
        entry = entry or self._entry()
        if (held := self._read("packs", entry)) is None:
            return None
        retired = self._read("inputs", entry).where(F.col("input").startswith("P")).select(F.col("input").alias("pack_id"))
        gone = [d for d in (self._read("dropped", entry), dropped) if d is not None]
        held = held.join(retired, "pack_id", "left_anti")
        for d in gone:
            d = d.select(F.col("pack_id").alias("_i"), F.col("project").alias("_p"), F.col("path").alias("_f"))
            held = held.join(d, (F.col("pack_id") == F.col("_i")) & F.col("project").eqNullSafe(F.col("_p")) & (F.col("path") == F.col("_f")), "left_anti")
        return held

    def files(self, objects: DataFrame, contents: DataFrame, policy: TierPolicy = DEFAULT_POLICY) -> DataFrame:
        """Every live file once: (project, path, hash, size, pack_id, bytes); pack_id is null where no pack holds it."""
        live = written(live_files(objects, policy).drop("counted"), "live")
        parts = [live.withColumn("pack_id", F.lit(None).cast("string"))]
        if (held := self.packs()) is not None:
            held = held.select(F.col("project").alias("_p"), F.col("path").alias("_f"), F.col("hash").alias("_h"), "pack_id", "bytes")
            same = F.col("project").eqNullSafe(F.col("_p")) & (F.col("path") == F.col("_f")) & F.col("hash").eqNullSafe(F.col("_h"))
            parts = [live.join(held.drop("pack_id", "bytes"), same, "left_anti").withColumn("pack_id", F.lit(None).cast("string")), live.join(held, same)]
        loose = parts[0].join(_blobs(contents), F.lower(F.trim("hash")) == F.col("_c"), "left")
        columns = ["project", "path", "hash", "size", "pack_id", "bytes"]
        return reduce(DataFrame.unionByName, [p.select(columns) for p in (loose, *parts[1:])])

    def run(self, objects: DataFrame, contents: DataFrame, policy: TierPolicy = DEFAULT_POLICY) -> int | None:
        """One round; its number, or None if nothing was due or dropped."""
        rounds = self._rounds(objects, contents, policy)
        try:
            return next(rounds, None)
        finally:
            rounds.close()

    def compact(self, objects: DataFrame, contents: DataFrame, policy: TierPolicy = DEFAULT_POLICY) -> list[int]:
        """Rounds until nothing is due; their numbers."""
        return list(self._rounds(objects, contents, policy))

    def _rounds(self, objects: DataFrame, contents: DataFrame, policy: TierPolicy) -> Iterator[int]:
        """The first round finds out where the live files are; the others go on from what it has left."""
        with scratch_scope():
            members = self.packs()
            items, dropped = locate(written(live_files(objects, policy), "live"), members if members is None else members.drop("bytes"))
            directories = True  # what is due in a directory is due at once
            while True:
                with scratch_scope(keep=1):
                    number, entry = self.commits.newest() + 1, self._entry()
                    plan = plan_round(items, number, policy, directories)
                    if not self._publish(number, entry, plan, dropped if directories else None, contents):
                        return
                    items, directories = written(items_after(items, plan, policy), "items"), False
                yield number

    def _publish(self, number: int, entry: dict, plan: Round, dropped: DataFrame | None, contents: DataFrame) -> bool:
        merges, drops = not plan.merges.isEmpty(), dropped is not None and not dropped.isEmpty()
        if not merges and not drops:
            return False
        own = self.commits.own_folder(number)
        packs = f"{self.root}/packs/round={os.path.basename(own)}"
        if merges:
            loose = plan.moves.where(F.col("path").isNotNull()).withColumn("_k", F.lower(F.trim("hash"))).join(_blobs(contents), F.col("_k") == F.col("_c"), "left")
            rows = loose.select(F.col("output").alias("pack_id"), "project", "path", "hash", "size", "bytes", F.col("new_tier").alias("tier"))
            repacked = plan.moves.where(F.col("path").isNull())
            if tiers := [r[0] for r in repacked.select("tier").distinct().collect()]:  # at most one for each bound
                new = repacked.select(F.col("item").alias("pack_id"), "output", "new_tier")
                old = self.packs(entry, dropped).where(F.col("tier").isin(tiers)).drop("tier").join(new, "pack_id")
                rows = rows.unionByName(old.select(F.col("output").alias("pack_id"), "project", "path", "hash", "size", "bytes", F.col("new_tier").alias("tier")))
            # A pack is bounded, and packs of a finished tier aren't read again by later rounds.
            rows.repartition("pack_id").sortWithinPartitions("tier", "pack_id", "path").write.partitionBy("tier").parquet(packs)
            plan.merges.write.parquet(f"{own}/merges")
            plan.moves.select("output", F.col("item").alias("input")).write.parquet(f"{own}/inputs")
        if drops:
            dropped.write.parquet(f"{own}/dropped")
        wrote = {"packs": packs, "merges": f"{own}/merges", "inputs": f"{own}/inputs"} if merges else {}
        wrote |= {"dropped": f"{own}/dropped"} if drops else {}
        self.commits.publish(number, {kind: [*paths, *([wrote[kind]] if kind in wrote else [])] for kind, paths in entry.items()})
        return True

    def vacuum(self) -> list[str]:
        """Removes the pack folders in which every pack was merged into another; readers of older entries lose them."""
        number, entry = self.commits.newest() + 1, self._entry()
        if (held := self.packs(entry)) is None:
            return []
        alive = written(held.select("pack_id").distinct(), "alive")
        empty = [p for p in entry["packs"] if self._read("packs", {"packs": [p]}).join(alive, "pack_id", "left_semi").isEmpty()]
        if empty:
            self.commits.publish(number, entry | {"packs": [p for p in entry["packs"] if p not in empty]})
            for p in empty:
                self.commits.remove(p)
        return empty


def _blobs(contents: DataFrame) -> DataFrame:
    """(_c, bytes), one row per hash in its normal form."""
    return contents.where(F.col("hash").isNotNull()).groupBy(F.lower(F.trim("hash")).alias("_c")).agg(F.max("bytes").alias("bytes"))
