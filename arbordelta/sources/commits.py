"""Numbered entries below a shared folder, each published by one exclusive rename.

Data is written to folders of its own first, which no reader looks at until an
entry names them; a writer that dies leaves only such a folder behind.  Of two
writers that read the same entry one can publish the next; the other gets
:class:`Conflict`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    pass


class Commits:
    def __init__(self, spark: SparkSession, root: str, folder: str = "_commits"):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), f"{root.rstrip('/')}/{folder}"

    def fs(self):
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        return Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), Path

    def names(self, folder: str) -> list[str]:
        fs, Path = self.fs()
        where = Path(folder)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.names(self.folder) if n.isdigit())

    def newest(self) -> int:
        """0 before the first."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        fs, Path = self.fs()
        stream = fs.open(Path(f"{self.folder}/{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def own_folder(self, number: int) -> str:
        """A new place for the data of an attempt at entry `number`."""
        return f"{self.root}/data/{number:08d}-{uuid.uuid4().hex}"

    def publish(self, number: int, entry: dict) -> None:
        fs, Path = self.fs()
        fs.mkdirs(Path(self.folder))
        draft, final = Path(f"{self.root}/.draft-{number}-{uuid.uuid4().hex}"), Path(f"{self.folder}/{number}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"{final} exists already")

    def remove(self, path: str) -> None:
        fs, Path = self.fs()
        fs.delete(Path(path), True)
