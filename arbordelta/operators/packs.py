"""Packs: directories kept as one TAR.

Bytes have to be opened here, so this is the one place of the store that runs
Python, in Arrow batches.  A pack is written in one canonical form (no times, no
owners, no padding beyond the end mark), so equal members in equal order have
equal hashes.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from arbordelta.schema import DIR_BIT, LINK_BIT, PERMISSION_BITS

#: The type flags of deleted and of cached entries.
DELETED, CACHED = b"D", b"C"


class Member(NamedTuple):
    path: str
    mode: int
    size: int
    deleted: bool
    content: bytes | None
    cached: bool = False


def encode_pack(members: Iterable[Member]) -> bytes:
    out = []
    for m in members:
        info = tarfile.TarInfo(m.path)
        info.mode = (m.mode or 0) & PERMISSION_BITS
        body = bytes(m.content or b"")
        if m.cached:
            info.type = CACHED
        elif m.deleted:
            info.type, body = DELETED, b""
        elif (m.mode or 0) & DIR_BIT:
            info.type, body = tarfile.DIRTYPE, b""
        elif (m.mode or 0) & LINK_BIT:
            info.type, info.linkname, body = tarfile.SYMTYPE, body.decode("utf-8", "surrogateescape"), b""
        info.size = len(body)
        out += [info.tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape"), body, bytes(-len(body) % 512)]
    return b"".join([*out, bytes(1024)])


def decode_pack(blob: bytes | None) -> list[Member]:
    """The members, as far as the blob goes; none if it isn't a TAR."""
    out: list[Member] = []
    try:
        with tarfile.open(fileobj=io.BytesIO(blob or b""), mode="r:") as tar:
            for info in tar:
                name = info.name
                mode = info.mode & PERMISSION_BITS
                content = b""
                if info.isdir():
                    mode |= DIR_BIT
                    name = name if name.endswith("/") else f"{name}/"
                elif info.issym():
                    mode |= LINK_BIT
                    content = info.linkname.encode("utf-8", "surrogateescape")
                elif info.size and (f := tar.extractfile(info)) is not None:
                    content = f.read()
                    if len(content) < info.size:
                        break  # the blob ends within this member
                out.append(Member(name, mode, len(content) if info.issym() else info.size, info.type == DELETED, content, info.type == CACHED))
    except (tarfile.TarError, OSError, ValueError):
        pass
    return out


def merge_pack(before: bytes | None, updates: Iterable[Member]) -> bytes | None:
    """The pack after the updates; None if nothing is left.

    Members stay in their old order, new ones follow in path order; of several
    updates of one path the last stands.
    """
    latest = {u.path: u for u in updates}
    old = decode_pack(before)
    kept = [latest.get(m.path, m) for m in old]
    seen = {m.path for m in old}
    kept += [latest[p] for p in sorted(latest) if p not in seen]
    kept = [m for m in kept if not m.deleted]
    return encode_pack(kept) if kept else None


def expand_packs(packs: DataFrame) -> DataFrame:
    """packs (project, path, content, ...) to (project, pack_path, path, mode, size, deleted, content), one row per member.

    Members are named by their full path.
    """

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (project, pack, m.path if m.path.startswith(pack) else pack + m.path, m.mode, m.size, m.deleted, m.content)
                for project, pack, blob in zip(frame["project"], frame["path"], frame["content"]) for m in decode_pack(blob)]
            yield pd.DataFrame(rows, columns=["project", "pack_path", "path", "mode", "size", "deleted", "content"])

    return packs.select("project", "path", "content").mapInPandas(
        members, "project long, pack_path string, path string, mode long, size long, deleted boolean, content binary")


def _members(frame: pd.DataFrame) -> list[Member]:
    """Rows (path, mode, size, deleted, content) with nulls made plain."""
    return [
        Member(path, 0 if pd.isna(mode) else int(mode), 0 if pd.isna(size) else int(size), deleted is not None and not pd.isna(deleted) and bool(deleted), content)
        for path, mode, size, deleted, content in frame[["path", "mode", "size", "deleted", "content"]].itertuples(index=False, name=None)]


def build_packs(members: DataFrame) -> DataFrame:
    """(project, pack_path, path, mode, size, deleted, content) to (project, pack_path, content), members in path order."""

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path")
        blob = encode_pack(_members(frame))
        return pd.DataFrame([(*key, blob)], columns=["project", "pack_path", "content"])

    return members.groupBy("project", "pack_path").applyInPandas(build, "project long, pack_path string, content binary")


def merge_packs(before: DataFrame, updates: DataFrame) -> DataFrame:
    """Each pack after its updates: (project, pack_path, before_hash, hash, content), content null once it is empty.

    before: (project, pack_path, hash, content); updates: (project, pack_path, seq, path, mode, size, deleted, content).
    The unit is one pack, which one row must hold anyway.
    """

    def merge(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        from hashlib import sha256

        columns = ["project", "pack_path", "before_hash", "hash", "content"]
        if not len(new):
            return pd.DataFrame(columns=columns)
        new = new.sort_values("seq", kind="stable")
        blob = merge_pack(old["content"].iloc[0] if len(old) else None, _members(new))
        return pd.DataFrame([(*key, old["hash"].iloc[0] if len(old) else None, sha256(blob).hexdigest() if blob else None, blob)], columns=columns)

    names = ["project", "pack_path"]
    return before.select(*names, "hash", "content").groupBy(*names).cogroup(
        updates.select(*names, "seq", "path", "mode", "size", "deleted", "content").groupBy(*names)
    ).applyInPandas(merge, "project long, pack_path string, before_hash string, hash string, content binary")


