"""Per-key totals of a table in which few keys hold most rows.

All totals are algebraic, so each task folds its rows into one state per key in
the bounded hash table of the partial aggregation (which falls back to sorting
and spilling), and only those states are shuffled: a key that holds a third of
the rows arrives as one row per map task, like any other key.

Defined results.  A null key is a key of its own.  Null and negative sizes add
no bytes; repeated rows count each time.  An empty table has no keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_totals(objects: DataFrame) -> DataFrame:
    """(project, n_rows, live_rows, n_bytes)."""
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")
    return objects.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("stop_version").isNull(), 1)).alias("live_rows"),
        F.sum(size).alias("n_bytes"),
    )


def heavy_projects(objects: DataFrame, share: int = 50) -> DataFrame:
    """Projects with at least 1/share of all rows or of all bytes."""
    totals = project_totals(objects)
    floor = totals.agg(
        F.expr(f"(sum(n_rows) + {share - 1}) div {share}").alias("n_rows"),
        F.expr(f"(sum(n_bytes) + {share - 1}) div {share}").alias("n_bytes"))
    rows, size = floor.select("n_rows").scalar(), floor.select("n_bytes").scalar()
    return totals.where((F.col("n_rows") >= rows) | (F.col("n_bytes") >= size))
