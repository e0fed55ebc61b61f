"""A store on a shared folder: Parquet parts, generations, atomic commits.

A generation names the parts of its tables.  Contents grow by appended parts,
which `fold_contents` merges tier by tier, so their number stays small; `vacuum`
removes what only old generations or lost attempts hold.  Objects are split by project into buckets, and a write rewrites the
buckets of the projects it names, so its cost follows them and not the store.
A writer publishes generation n + 1 by renaming a small entry into place: of two
writers that read the same generation only one can do that, the other gets
:class:`Conflict` and may derive its state again.  Readers name a generation and
are never disturbed.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordelta.operators.mutate import State, Update
from arbordelta.schema import CACHE_VERSIONS, CONTENTS, OBJECTS, PROJECTS
from arbordelta.sources.commits import Commits
from arbordelta.sources.commits import Conflict as Conflict

SCHEMAS = {"projects": PROJECTS, "objects": OBJECTS, "contents": CONTENTS, "cache_versions": CACHE_VERSIONS}
BUCKETS = 64
#: Parts of contents of one tier that are merged into one of the next.
FAN_IN = 16
#: What parts are sorted by, so that row groups are pruned by their ranges.
LAYOUT = {"objects": ["project", "start_version", "path"], "contents": ["hash"]}


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.commits = Commits(spark, root)

    def generation(self) -> int:
        """The newest; 0 before the first commit."""
        return self.commits.newest()

    def entry(self, generation: int | None = None) -> dict:
        """{"parts": {table: {bucket: [path, ...]}}, "batches": {stream: number}, "buckets": n} of a generation.

        Tables other than objects have the one bucket "-".
        """
        generation = self.generation() if generation is None else generation
        return self.commits.read(generation) if generation else {"parts": {}, "batches": {}, "buckets": self.buckets}

    def bucket(self, project: Column, generation: int | None = None) -> Column:
        return F.pmod(project, F.lit(self.entry(generation)["buckets"]))

    def table(self, name: str, generation: int | None = None, buckets: Collection[int] | None = None) -> DataFrame:
        """A table of a generation, of objects only the buckets given."""
        parts = self.entry(generation)["parts"].get(name, {})
        wanted = None if buckets is None or name != "objects" else {str(b) for b in buckets}
        paths = [p for b, ps in parts.items() if wanted is None or b in wanted for p in ps]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def state(self, generation: int | None = None, buckets: Collection[int] | None = None) -> State:
        generation = self.generation() if generation is None else generation
        return State(*(self.table(t, generation, buckets) for t in ("projects", "objects", "contents")))

    def commit(
        self, read: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
        buckets: Collection[int] | None = None, batch: tuple[str, int] | None = None,
    ) -> int:
        """Publishes a generation on top of `read`; tables not named stay.

        With `buckets`, objects are replaced in these only.  batch: (stream,
        number) that this commit holds, kept for replays.
        """
        entry = self.entry(read)
        own = self.commits.own_folder(read + 1)
        for name, df in (replace or {}).items():
            new = self._write(f"{own}/{name}", name, df, entry["buckets"])
            kept = entry["parts"].get(name, {}) if name == "objects" and buckets is not None else {}
            entry["parts"][name] = {b: p for b, p in kept.items() if int(b) not in set(buckets)} | new
        for name, df in (append or {}).items():
            new = self._write(f"{own}/+{name}", name, df, entry["buckets"])
            old = entry["parts"].setdefault(name, {})
            for b, paths in new.items():
                old[b] = [*old.get(b, []), *paths]
        if batch:
            entry["batches"][batch[0]] = batch[1]
        self.commits.publish(read + 1, entry)
        return read + 1

    def _write(self, path: str, name: str, df: DataFrame, buckets: int) -> dict[str, list[str]]:
        df = df.select([f.name for f in SCHEMAS[name].fields])
        keys = LAYOUT.get(name, [])
        if name == "objects":
            # Sorted by range within the bucket: a bucket with a hot project becomes several files.
            keys = ["bucket", *keys]
            df = df.withColumn("bucket", F.pmod("project", F.lit(buckets)))
        if keys:
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        writer = df.write.partitionBy("bucket") if name == "objects" else df.write
        writer.parquet(path)
        if name != "objects":
            return {"-": [path]}
        return {n.removeprefix("bucket="): [f"{path}/{n}"] for n in self.commits.names(path) if n.startswith("bucket=")}

    def commit_state(self, read: int, before: State, after: State, buckets: Collection[int] | None = None) -> int:
        """Publishes the tables in which two states differ; with `buckets`, both hold objects of these only."""
        changed = {n: getattr(after, n) for n in ("projects", "objects", "contents") if getattr(after, n) is not getattr(before, n)}
        return self.commit(read, changed, buckets=buckets)

    def commit_update(self, read: int, update: Update, buckets: Collection[int], batch: tuple[str, int] | None = None) -> int:
        return self.commit(read, {"projects": update.projects, "objects": update.objects}, {"contents": update.fresh}, buckets, batch)

    def fold_contents(self, fan_in: int = FAN_IN) -> int | None:
        """Merges the contents' parts of the first tier that has `fan_in` of them; the new generation, or None."""
        read = self.generation()
        entry = self.entry(read)
        tiers: dict[int, list[str]] = {}
        for path in entry["parts"].get("contents", {}).get("-", []):
            tiers.setdefault(int(path.rpartition("~")[2]) if "~" in path else 0, []).append(path)
        due = next((t for t in sorted(tiers) if len(tiers[t]) >= fan_in), None)
        if due is None:
            return None
        path = f"{self.commits.own_folder(read + 1)}/contents~{due + 1}"
        self._write(path, "contents", self.spark.read.schema(CONTENTS).parquet(*tiers[due]), entry["buckets"])
        entry["parts"]["contents"]["-"] = [*(p for t in tiers if t != due for p in tiers[t]), path]
        self.commits.publish(read + 1, entry)
        return read + 1

    def vacuum(self, keep: int = 1) -> int:
        """Removes all generations but the last `keep`, and the data folders that none of these reads; how many folders.

        Attempts at the next generation are left alone.
        """
        numbers = self.commits.numbers()
        kept = numbers[-keep:]
        used = {path.removeprefix(f"{self.root}/data/").partition("/")[0] for n in kept for parts in self.entry(n)["parts"].values() for paths in parts.values() for path in paths}
        for n in numbers[:-keep]:
            self.commits.remove(f"{self.root}/_commits/{n}")
        old = [f for f in self.commits.names(f"{self.root}/data") if f not in used and int(f.partition("-")[0]) <= max(kept, default=0)]
        for folder in old:
            self.commits.remove(f"{self.root}/data/{folder}")
        return len(old)
