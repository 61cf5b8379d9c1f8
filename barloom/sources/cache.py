"""Data sets kept under a fingerprint of what they are made of.

A table's fingerprint is its number of rows and two sums of row hashes, so it doesn't depend on the order of rows or files, and
the fingerprints of parts add up to that of the whole.  ``BarStore`` keeps them in its log, part by part, so asking for
one reads no bars.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.log import Log

WORD = 1 << 64


def row_sums(frame: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Aggregates n, a and b of a fingerprint: rows, and sums of two hashes of the columns (by name)."""
    cols = [F.col(f"`{c}`") for c in sorted(columns or frame.columns)]
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(20,0)"))
    return [F.count("*").alias("n"), F.coalesce(hashed(1), F.lit(0)).cast("decimal(38,0)").alias("a"), F.coalesce(hashed(2), F.lit(0)).cast("decimal(38,0)").alias("b")]


def content(frame: DataFrame) -> str:
    """Fingerprint of a table's rows, columns and types."""
    n, a, b = frame.agg(*row_sums(frame)).first()
    return _digest([sorted(f"{f.name}:{f.dataType.simpleString()}" for f in frame.schema), int(n), int(a) % WORD, int(b) % WORD])


def added(sums: list[tuple[int, int, int]]) -> list[int]:
    """The sums of a whole from those of its parts."""
    return [sum(s[0] for s in sums), sum(s[1] for s in sums) % WORD, sum(s[2] for s in sums) % WORD]


def _digest(what: object) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:32]


class DatasetCache:
    """Tables by fingerprint, in folders that a log names; a build that doesn't finish leaves no entry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, self.path)

    def key(self, parameters: dict, *sources: str) -> str:
        return _digest([parameters, list(sources)])

    def find(self, key: str) -> DataFrame | None:
        held = [e["folder"] for e in self.log.entries() if e.get("key") == key]
        return self.spark.read.parquet(f"{self.path}/{held[-1]}") if held else None

    def get(self, parameters: dict, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The table kept for these parameters and fingerprints of sources, or what build makes, which is kept."""
        key = self.key(parameters, *sources)
        found = self.find(key)
        if found is not None:
            return found
        folder = f"data/{key}-{uuid.uuid4().hex}"
        build().write.parquet(f"{self.path}/{folder}")
        while not self.log.append(self.log.last()[0], {"key": key, "folder": folder, "parameters": parameters, "sources": sources}):
            pass
        return self.spark.read.parquet(f"{self.path}/{folder}")


class LabelStore:
    """Labels (symbol, ts, label) by horizon; a save replaces those of its horizon by a new version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, self.path)

    def save(self, horizon: int, labels: DataFrame) -> None:
        folder = f"data/{horizon}-{uuid.uuid4().hex}"
        labels.select("symbol", "ts", F.col("label").cast("double").alias("label")).write.parquet(f"{self.path}/{folder}")
        while not self.log.append(self.log.last()[0], {"horizon": horizon, "folder": folder}):
            pass

    def horizons(self) -> list[int]:
        return sorted({e["horizon"] for e in self.log.entries()})

    def load(self, horizon: int, symbol: str | None = None) -> DataFrame | None:
        held = [e["folder"] for e in self.log.entries() if e["horizon"] == horizon]
        if not held:
            return None
        found = self.spark.read.parquet(f"{self.path}/{held[-1]}")
        return found if symbol is None else found.where(F.col("symbol") == symbol)
