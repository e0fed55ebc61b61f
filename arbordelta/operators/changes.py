"""A change feed applied by equality deletes with sequence numbers.

Inserts and deletes are appended apart, and nothing is rewritten on arrival.  An
insert row carries a path's new state; a delete row only keys and numbers, and
takes effect on every insert file, whenever that came.  Each request leaves one
of them or both:

* It takes away every insert of its (project, path) with a lower seq.
* It voids every row of its (project, seq), inserts and deletes, with a lower
  attempt.

The reader anti-joins inserts with the latest standing delete of their path,
then the few that are left with the latest attempt of their request.  Of a key
only the one row with the highest number can matter, so both anti-joins have a
unique other side whose partial maximum is taken before the shuffle, and contents
are shuffled once, and once more for the rows that survive.

:class:`EqualityDeleteTable` appends batches as they arrive, in any order and
split anywhere, each published by one exclusive rename; a batch that was
published is not appended again.  `compact` folds the files of all batches into
one of each kind, without the rows that later attempts have voided for good.

Defined results.  Of rows with the same (project, seq) those with the highest
attempt stand, a null attempt being lowest; of equal numbers and path, the row with the
greatest (mode, size, content).  A null deleted is false, a null content is kept
as null.  Rows with a null project or seq are void.  Rows with a null path or
batch_version, with a batch_version above the project's latest_version, or of a
project that `projects` lacks take no effect but void lower attempts.  A write
and a delete of one path by the same request leave the write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordelta.sources.commits import Commits, Conflict

KEY = ["project", "path"]
REQUEST = ["project", "seq"]
PAYLOAD = ["mode", "size", "content"]
_LOWEST = -(1 << 63)


def split_feed(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserts, deletes): (project, path, seq, attempt, batch_version) of each request, inserts with what is written."""
    rows = requests.where(F.col("project").isNotNull() & F.col("seq").isNotNull())
    numbers = [F.col("seq"), F.coalesce("attempt", F.lit(_LOWEST)).alias("attempt"), F.col("batch_version")]
    payload = [c for c in PAYLOAD if c in requests.columns]
    return rows.where(~F.coalesce("deleted", F.lit(False))).select(*KEY, *numbers, *payload), rows.select(*KEY, *numbers)


def standing(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """rows without those of which a later attempt exists."""
    last = deletes.groupBy(*[F.col(k).alias(f"_{k}") for k in REQUEST]).agg(F.max("attempt").alias("_attempt"))
    same = [F.col(k) == F.col(f"_{k}") for k in REQUEST]
    return rows.join(last, [*same, F.col("_attempt") > F.col("attempt")], "left_anti")


def read_current(inserts: DataFrame, deletes: DataFrame, projects: DataFrame) -> DataFrame:
    """The inserts that no later delete takes away: (project, path, seq, mode, size, content)."""
    last = projects.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_id")).agg(F.max("latest_version").alias("_latest"))

    def effective(rows: DataFrame) -> DataFrame:
        known = rows.where(F.col("path").isNotNull()).join(last, F.col("project") == F.col("_id"))
        return known.where(F.col("batch_version") <= F.col("_latest")).drop("_id", "_latest", "batch_version")

    latest = standing(effective(deletes), deletes).groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.max("seq").alias("_seq"))
    same = [F.col(k) == F.col(f"_{k}") for k in KEY]
    alive = effective(inserts).join(latest, [*same, F.col("_seq") > F.col("seq")], "left_anti")
    payload = [c for c in PAYLOAD if c in inserts.columns]
    one = standing(alive, deletes).groupBy(*KEY, "seq").agg(F.max(F.struct(*payload) if payload else F.lit(0)).alias("_w"))
    return one.select(*KEY, "seq", *[F.col(f"_w.{c}").alias(c) for c in payload])


class EqualityDeleteTable:
    """Insert and delete files below a shared folder.

    An entry names the folders that are read and the batches they hold.
    """

    def __init__(self, spark: SparkSession, root: str, tries: int = 10):
        self.spark, self.root, self.tries = spark, root.rstrip("/"), tries
        self.commits = Commits(spark, root)

    def _entry(self, number: int) -> dict:
        return self.commits.read(number) if number else {"batches": [], "folders": []}

    def append(self, batch: str, requests: DataFrame) -> bool:
        """False if the batch was published before."""
        if batch in self._entry(self.commits.newest())["batches"]:
            return False
        own = self.commits.own_folder(self.commits.newest() + 1)
        for kind, rows in zip(("inserts", "deletes"), split_feed(requests)):
            rows.write.parquet(f"{own}/{kind}")
        return self._publish(own, batch)

    def _publish(self, own: str, batch: str) -> bool:
        for _ in range(self.tries):
            number = self.commits.newest()
            entry = self._entry(number)
            if batch in entry["batches"]:
                return False
            try:
                self.commits.publish(number + 1, {"batches": [*entry["batches"], batch], "folders": [*entry["folders"], own]})
                return True
            except Conflict:
                continue
        raise Conflict(f"{own} could not be published")

    def _files(self, kind: str, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{f}/{kind}" for f in folders])

    def read(self, projects: DataFrame) -> DataFrame:
        """The live paths: (project, path, seq, mode, size, content)."""
        folders = self._entry(self.commits.newest())["folders"]
        if not folders:
            raise ValueError("no batch was appended")
        return read_current(self._files("inserts", folders), self._files("deletes", folders), projects)

    def compact(self) -> None:
        """Folds all files; whoever reads an older entry still finds its own."""
        number = self.commits.newest()
        entry = self._entry(number)
        own = self.commits.own_folder(number + 1)
        deletes = self._files("deletes", entry["folders"])
        for kind in ("inserts", "deletes"):
            standing(self._files(kind, entry["folders"]), deletes).distinct().write.parquet(f"{own}/{kind}")
        self.commits.publish(number + 1, {"batches": entry["batches"], "folders": [own]})
