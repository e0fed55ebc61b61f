"""Retention and orphans.

Only objects keep contents alive: a hash that just a cache version names is
collected.  Sampling is seeded; at 100 % it takes all.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordelta.operators.mutate import State


def expired(objects: DataFrame, latest: Column, keep: int, start: int = 0) -> Column:
    """Rows that ended `keep` or more versions before the latest, and began after `start`."""
    return (F.col("start_version") > start) & F.col("stop_version").isNotNull() & (F.col("stop_version") <= latest - keep)


def gc_rows(objects: DataFrame, projects: DataFrame, keep: int, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows of all the projects given; rows of others are kept."""
    if keep <= 0:
        raise ValueError("keep must be positive")
    at = projects.select(F.col("id").alias("_p"), F.col("latest_version").alias("_v"))
    marked = objects.join(at, F.col("project") == F.col("_p"), "left").withColumn("_x", F.coalesce(expired(objects, F.col("_v"), keep, start), F.lit(False)))
    return marked.where(~F.col("_x")).drop("_p", "_v", "_x"), marked.where("_x").drop("_p", "_v", "_x")


def orphans(hashes: DataFrame, objects: DataFrame) -> DataFrame:
    """The distinct hashes that no object refers to.

    Both sides are folded first: a hash that most objects have is one row per task.
    """
    return hashes.select("hash").distinct().join(objects.select("hash").distinct(), "hash", "left_anti")


def gc(state: State, projects: DataFrame, keep: int, start: int = 0) -> tuple[State, DataFrame]:
    """The state without expired rows and the contents that only they held, and (hash) of these contents."""
    kept, dropped = gc_rows(state.objects, projects, keep, start)
    lost = orphans(dropped, kept).join(state.contents.select("hash"), "hash", "left_semi")
    return replace(state, objects=kept, contents=state.contents.join(lost, "hash", "left_anti")), lost


def gc_contents(state: State, percent: float = 100.0, seed: int = 42) -> tuple[State, DataFrame]:
    """The state without the sampled contents that nothing refers to, and their hashes."""
    lost = orphans(sample(state.contents, percent, seed), state.objects)
    return replace(state, contents=state.contents.join(lost, "hash", "left_anti")), lost


def sample(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    return df if percent >= 100 else df.sample(fraction=percent / 100, seed=seed)


def sample_projects(projects: DataFrame, percent: float, seed: int = 42, tries: int = 5) -> DataFrame:
    """A sample that is empty only if `tries` seeds in a row give none."""
    for attempt in range(tries):
        found = sample(projects, percent, seed + attempt)
        if percent >= 100 or found.limit(1).count():
            return found
    return projects.limit(0)
