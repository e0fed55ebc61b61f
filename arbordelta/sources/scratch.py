"""Tables that cut a long lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: path -> (session, thread that made it); a scope is of one thread.
_KEPT: dict[str, tuple[SparkSession, int]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is set only where it is unset and there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='arbordelta-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """The shared folder as a path of the file system, for what is written file by file."""
    folder = shared_folder(spark)
    if not folder.startswith(("file:", "/")):
        raise ValueError(f"{folder} is not in a file system that all executors mount")
    return "/" + folder.removeprefix("file:").lstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans it
        pass


@atexit.register
def _remove_all() -> None:
    while _KEPT:
        path, (spark, _) = _KEPT.popitem()
        _remove(spark, path)


@contextmanager
def scratch_scope(keep: int = 0) -> Iterator[None]:
    """Removes, at its end, the scratch tables that were made within, but the last `keep`: for work whose result has been written elsewhere."""
    before = set(_KEPT)
    try:
        yield
    finally:
        own = threading.get_ident()
        made = [path for path, (_, thread) in list(_KEPT.items()) if thread == own and path not in before]
        for path in made[:len(made) - keep]:
            spark, _ = _KEPT.pop(path)
            _remove(spark, path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, removed at the end of the scope, or of the driver."""
    path = f"{shared_folder(spark)}/arbordelta/{name}-{uuid.uuid4().hex}"
    _KEPT[path] = spark, threading.get_ident()
    return path


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file to a folder of its own in the shared folder; its path."""
    path = f"{scratch_folder(spark, 'file')}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at:at + (1 << 20)]))
    out.close()
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read from a Parquet table.

    The table is in the shared folder, so a lost executor loses nothing of it.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
