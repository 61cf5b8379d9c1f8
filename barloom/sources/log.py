"""A log of numbered entries in a shared folder.

An entry is written beside the log and renamed to the next free number, which fails if another writer took it.  So
entries are whole and never change, readers need no lock, and of two writers one learns that it has to look again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._known: dict[str, dict] = {}

    def names(self) -> list[str]:
        log = self._path(f"{self.path}/log")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(log)) if self._fs.exists(log) else []

    def entry(self, name: str) -> dict:
        if name not in self._known:
            stream = self._fs.open(self._path(f"{self.path}/log/{name}"))
            try:
                self._known[name] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return self._known[name]

    def entries(self) -> list[dict]:
        return [self.entry(n) for n in self.names()]

    def last(self) -> tuple[int, dict | None]:
        """The number of entries, and the last one."""
        names = self.names()
        return (int(names[-1]) + 1, self.entry(names[-1])) if names else (0, None)

    def append(self, number: int, entry: dict) -> bool:
        """Whether it became the entry of this number."""
        self._fs.mkdirs(self._path(f"{self.path}/log"))
        beside = self._path(f"{self.path}/beside-{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # without overwrite
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self._conf).rename(beside, self._path(f"{self.path}/log/{number:012d}"), plain)
        except Exception:
            self._fs.delete(beside, False)
            if f"{number:012d}" not in self.names():
                raise
            return False
        return True

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)
