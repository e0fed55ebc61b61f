"""Rows in few input partitions, spread over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out again if it has at most half as many partitions as there are cores.

    For scans before costly Python: one small file would be one task.  Large
    inputs have more partitions than that and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < 2 * partitions <= cores else df
