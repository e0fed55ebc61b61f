"""Trees on disk: reading a directory, comparing listings, writing a tree.

Only for file systems that the executors share.  Listings are metadata; file
contents are read and written by the executors.
"""

from __future__ import annotations

import os
import shutil
import stat
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordelta.schema import DIR_BIT, LINK_BIT, PERMISSION_BITS

#: Fixed value: where a tree keeps its own state.
STATE_DIR = ".dl"
OBJECT_SCHEMA = "path string, mode long, size long, deleted boolean, content binary"


def read_object(root: str, path: str) -> tuple:
    """(path, mode, size, deleted, content); a file that vanished is a delete."""
    full = os.path.join(root, path)
    try:
        info = os.lstat(full.rstrip("/"))
        if stat.S_ISLNK(info.st_mode):
            target = os.readlink(full.rstrip("/")).encode("utf-8", "surrogateescape")
            return path, LINK_BIT | info.st_mode & PERMISSION_BITS, info.st_size, False, target
        if stat.S_ISDIR(info.st_mode):
            return path, DIR_BIT | info.st_mode & PERMISSION_BITS, info.st_size, False, b""
        with open(full, "rb") as f:
            return path, info.st_mode & PERMISSION_BITS, info.st_size, False, f.read()
    except FileNotFoundError:
        return path, 0, 0, True, b""


def _entries(root: str, rel: str) -> tuple[list[str], list[str]]:
    """(directories, others) in one directory; an empty directory stands for itself among the others."""
    entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
    entries = [e for e in entries if not (rel == "" and e.name == STATE_DIR)]
    folders = [f"{rel}{e.name}/" for e in entries if e.is_dir(follow_symlinks=False)]
    others = [f"{rel}{e.name}" for e in entries if not e.is_dir(follow_symlinks=False)]
    return folders, others or ([rel] if rel and not folders else [])


def list_dir(root: str, below: str = "") -> Iterator[str]:
    """Files, symlinks and empty directories (with a trailing slash), relative to root."""
    stack = [below]
    while stack:
        folders, others = _entries(root, stack.pop())
        stack += folders
        yield from others


def scan_dir(spark: SparkSession, root: str) -> DataFrame:
    """(path, mode, size, deleted, content) of a tree.

    The driver opens directories, level by level, only until there are a few for
    each core; the executors list what is below these.
    """
    wanted = 4 * spark.sparkContext.defaultParallelism
    folders, found = [""], []
    while folders and len(folders) < wanted:
        folder = folders.pop(0)
        below, others = _entries(root, folder)
        folders += below
        found += others
    tops = [(f, True) for f in folders] + [(p, False) for p in found]
    if not tops:
        return spark.createDataFrame([], OBJECT_SCHEMA)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, folder in zip(frame["path"], frame["folder"]):
                listed = list(list_dir(root, path)) if folder else [path]
                for at in range(0, len(listed), 10_000):
                    yield pd.DataFrame({"path": listed[at:at + 10_000]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for path in frame["path"]:
                held.append(read_object(root, path))
                size += held[-1][2]
                if len(held) == 1000 or size > 16 << 20:
                    yield pd.DataFrame(held, columns=["path", "mode", "size", "deleted", "content"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "mode", "size", "deleted", "content"])

    paths = spark.createDataFrame(tops, "path string, folder boolean").repartition(wanted, "path").mapInPandas(walk, "path string")
    return paths.repartition("path").mapInPandas(read, OBJECT_SCHEMA)


def dir_diff(before: DataFrame, after: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    """(keys, action): add, modify or remove, of two listings (keys, hash, mode)."""
    a = before.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.struct("hash", "mode").alias("_a"))
    b = after.select(*keys, F.struct("hash", "mode").alias("_b"))
    on = [F.col(k) == F.col(f"_a_{k}") for k in keys]
    both = b.join(a, on, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    action = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "remove").otherwise("modify")
    return both.select(*[F.coalesce(k, f"_a_{k}").alias(k) for k in keys], action.alias("action"))


def matches(path: str, include: str | None, exclude: str | None) -> bool:
    import re

    from arbordelta.functions.paths import glob_pattern

    return (not include or re.match(glob_pattern(include), path) is not None) and not (exclude and re.match(glob_pattern(exclude), path))


def _clear(full: str) -> None:
    if os.path.islink(full) or os.path.isfile(full):
        os.remove(full)
    elif os.path.isdir(full):
        shutil.rmtree(full)


def _parents(root: str, path: str) -> None:
    parts = path.rstrip("/").split("/")[:-1]
    for i in range(1, len(parts) + 1):
        folder = os.path.join(root, *parts[:i])
        if not os.path.isdir(folder) or os.path.islink(folder):
            try:
                os.unlink(folder)
            except (FileNotFoundError, IsADirectoryError):  # another task has made way meanwhile
                pass
            os.makedirs(folder, exist_ok=True)


def _inside(path: str) -> str:
    if ".." in path.split("/") or path.startswith("/"):
        raise ValueError(f"{path!r} leaves the tree")
    return path


def write_object(root: str, path: str, mode: int, deleted: bool, content: bytes | None) -> None:
    """One object, in place of whatever is in its way."""
    full = os.path.join(root, _inside(path).rstrip("/"))
    if deleted:
        if path.endswith("/"):
            if os.path.isdir(full) and not os.listdir(full):
                os.rmdir(full)
        elif os.path.islink(full) or os.path.isfile(full):
            os.remove(full)
        return
    _parents(root, path)
    if mode & LINK_BIT:
        _clear(full)
        os.symlink(bytes(content or b"").decode("utf-8", "surrogateescape"), full)
    elif mode & DIR_BIT:
        if not os.path.isdir(full):
            _clear(full)
            os.makedirs(full)
        os.chmod(full, mode & PERMISSION_BITS)
    else:
        if os.path.islink(full) or os.path.isdir(full):
            _clear(full)
        with open(full, "wb") as f:
            f.write(bytes(content or b""))
        os.chmod(full, mode & PERMISSION_BITS)


def materialize(objects: DataFrame, root: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Writes (path, mode, size, deleted, content) below root: one row (count, file_match).

    Tombstones go first.  file_match says whether all written paths match.
    """
    os.makedirs(root, exist_ok=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                write_object(root, r.path, int(r.mode), bool(r.deleted), r.content)
            yield pd.DataFrame({"n": [len(frame)], "good": [all(matches(p, include, exclude) for p in frame["path"])]})

    done = []
    for part in (objects.where("deleted"), objects.where(~F.col("deleted"))):
        # One directory is written by one task, so that no two tasks make way for each other in it.
        spread = part.where(F.col("path").isNotNull()).select("path", F.coalesce("mode", F.lit(0).cast("long")).alias("mode"), "deleted", "content").repartition(F.substring_index("path", "/", 1))
        done.append(spread.mapInPandas(write, "n long, good boolean").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.every("good"), F.lit(True))).first())
    total = sum(n for n, _ in done)
    return objects.sparkSession.createDataFrame([(total, bool(total) and all(g for _, g in done))], "count long, file_match boolean")


def _swap(new: str, final: str) -> None:
    """Puts a finished directory in the place of whatever is there."""
    _clear(final)
    os.makedirs(os.path.dirname(final), exist_ok=True)
    os.rename(new, final)


def write_tar(root: str, pack_path: str | None, blob: bytes | None, cache_root: str | None = None) -> tuple[list[str], int]:
    """(paths, how many of them came from the cache) after writing one TAR below root.

    A pack is built aside and put in the place of the one on disk, so members
    that it no longer has are gone; without bytes it is removed.  A cached entry
    is copied from `cache_root`.
    """
    from arbordelta.operators.packs import decode_pack

    aside = os.path.join(root, STATE_DIR, f"pack-{uuid.uuid4().hex}")
    if pack_path is not None:
        final = os.path.join(root, _inside(pack_path).rstrip("/"))
        if blob is None:
            if os.path.isdir(final) and not os.path.islink(final):
                shutil.rmtree(final)
            return [], 0
    paths, cached = [], 0
    try:
        for m in decode_pack(blob):
            path = m.path if pack_path is None or m.path.startswith(pack_path) else pack_path + m.path
            paths.append(path)
            if m.cached:
                cached += 1
                copy = os.path.join(root, STATE_DIR, f"pack-{uuid.uuid4().hex}")
                shutil.copytree(os.path.join(cache_root or "", "objects", m.content.hex(), _inside(path)), copy, symlinks=True)
                _parents(root, path)
                _swap(copy, os.path.join(root, path.rstrip("/")))
            else:
                write_object(root if pack_path is None else aside, path, m.mode, m.deleted, m.content)
        if pack_path is not None:
            _parents(root, pack_path)
            new = os.path.join(aside, pack_path.rstrip("/"))
            if os.path.isdir(new):
                _swap(new, final)
            else:
                _clear(final)
    finally:
        shutil.rmtree(aside, ignore_errors=True)
    return paths, cached


def write_tars(tars: DataFrame, root: str, include: str | None = None, exclude: str | None = None, cache_root: str | None = None) -> DataFrame:
    """Writes (pack_path, bytes) below root: one row (tars, count, cached_count, file_match)."""
    os.makedirs(os.path.join(root, STATE_DIR), exist_ok=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [write_tar(root, p, b, cache_root) for p, b in zip(frame["pack_path"], frame["bytes"])]
            yield pd.DataFrame({
                "tars": [len(done)], "n": [sum(len(p) for p, _ in done)], "cached": [sum(c for _, c in done)],
                "good": [all(matches(p, include, exclude) for paths, _ in done for p in paths)]})

    none = F.lit(0).cast("long")
    row = tars.select("pack_path", "bytes").mapInPandas(write, "tars long, n long, cached long, good boolean").agg(
        F.coalesce(F.sum("tars"), none), F.coalesce(F.sum("n"), none), F.coalesce(F.sum("cached"), none), F.coalesce(F.every("good"), F.lit(True))).first()
    return tars.sparkSession.createDataFrame([(*row[:3], bool(row[1]) and row[3])], "tars long, count long, cached_count long, file_match boolean")


def read_version(root: str) -> int:
    try:
        with open(os.path.join(root, STATE_DIR, "version")) as f:
            return int(f.read().strip() or 0)
    except FileNotFoundError:
        return 0


def write_version(root: str, version: int) -> None:
    os.makedirs(os.path.join(root, STATE_DIR), exist_ok=True)
    draft = os.path.join(root, STATE_DIR, f"version.{os.getpid()}")
    with open(draft, "w") as f:
        f.write(str(version))
    os.replace(draft, os.path.join(root, STATE_DIR, "version"))


def read_cache_versions(root: str) -> list[int]:
    """The versions in the file `versions`, lines that are no number left out."""
    try:
        with open(os.path.join(root, "versions")) as f:
            return [int(x) for x in f.read().split("\n") if x.strip().isdigit()]
    except FileNotFoundError:
        return []


def download_cache(cache: DataFrame, root: str) -> int:
    """Unpacks (version, hash, content) to root/objects/<hash>, each once; returns the version, or -1 for an empty cache."""
    from arbordelta.operators.packs import decode_pack

    os.makedirs(os.path.join(root, "objects"), exist_ok=True)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                final = os.path.join(root, "objects", r.hash)
                if not os.path.exists(final):
                    draft = os.path.join(root, "objects", f".{r.hash}.{os.getpid()}")
                    shutil.rmtree(draft, ignore_errors=True)
                    os.makedirs(draft)
                    for m in decode_pack(r.content):
                        write_object(draft, m.path, m.mode, m.deleted, m.content)
                    try:
                        os.rename(draft, final)
                    except OSError:  # another attempt of this task was first
                        shutil.rmtree(draft, ignore_errors=True)
            yield pd.DataFrame({"version": frame["version"]})

    row = cache.mapInPandas(unpack, "version long").agg(F.max("version")).first()
    if row[0] is None:
        return -1
    if row[0] not in read_cache_versions(root):
        with open(os.path.join(root, "versions"), "a") as f:
            f.write(f"{row[0]}\n")
    return row[0]
