"""Connectors: places bars come from, a registry of them, and one set of bars from many by priority.

``FileBars`` is a Spark data source over CSV files in one of two layouts, a folder per symbol or a folder per period of
time.  Filters on symbol and ts reach it: folders that can't match are never listed as partitions, and rows that don't
match never leave the reader.  Other kinds of places subclass ``Connector``.
"""

from __future__ import annotations

import functools
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from barloom.sources.codes import normalized
from barloom.sources.store import BAR_COLUMNS

SCHEMA = "symbol string, ts long, open double, high double, low double, close double, volume double, amount double"
LAYOUTS = ("symbol", "period")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class _File(InputPartition):
    path: str
    symbol: str | None


def _named(folder: str) -> tuple[str, str]:
    """Key and value of a folder; Spark writes some characters of values as %XX."""
    key, _, value = folder.partition("=")
    return key, unquote(value)


class FileBarsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.layout = options["path"].rstrip("/"), options.get("layout", "symbol")
        if self.layout not in LAYOUTS:
            raise ValueError(f"no such layout: {self.layout}")
        self.factor = float(options.get("volume_unit", "1"))
        self.symbols: set[str] | None = None
        self.since, self.until = -(2**63), 2**63 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("symbol",) and isinstance(f, EqualTo | In):
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.symbols = named if self.symbols is None else self.symbols & named
            elif column == ("ts",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.since = max(self.since, value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.until = min(self.until, value - isinstance(f, LessThan))
            else:
                yield f

    def _open(self) -> tuple[pa.fs.FileSystem, str]:
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.path)

    def _folder_counts(self, name: str) -> bool:
        """Whether a folder (symbol=S, or period=FIRST_LAST by ts) can hold rows that are wanted."""
        key, value = _named(name)
        if key != self.layout:
            return False
        if key == "symbol":
            return self.symbols is None or value in self.symbols
        first, last = map(int, value.split("_"))
        return first <= self.until and last >= self.since

    def partitions(self) -> list[_File]:
        import pyarrow.fs

        fs, root = self._open()
        out = []
        for folder in fs.get_file_info(pyarrow.fs.FileSelector(root)):
            if folder.type == pyarrow.fs.FileType.Directory and self._folder_counts(folder.base_name):
                files = fs.get_file_info(pyarrow.fs.FileSelector(folder.path, recursive=True))
                out += [_File(f.path, _named(folder.base_name)[1] if self.layout == "symbol" else None) for f in files if f.base_name.endswith(".csv") and f.size]
        return sorted(out, key=lambda f: f.path)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyarrow import csv

        if partition is None:  # nothing to read
            return
        fs, _ = self._open()
        types = {c: pa.float64() for c in BAR_COLUMNS[2:]} | {"symbol": pa.string(), "ts": pa.int64()}
        with fs.open_input_stream(partition.path) as f, csv.open_csv(f, convert_options=csv.ConvertOptions(column_types=types)) as batches:
            for batch in batches:
                t = pa.Table.from_batches([batch])
                if partition.symbol is not None:
                    t = t.drop_columns("symbol") if "symbol" in t.column_names else t
                    t = t.append_column("symbol", pa.array([partition.symbol] * t.num_rows, pa.string()))
                t = t.set_column(t.column_names.index("volume"), "volume", pc.multiply(t["volume"], self.factor))
                if "amount" not in t.column_names:
                    t = t.append_column("amount", pc.multiply(t["close"], t["volume"]))
                keep = pc.and_(pc.greater_equal(t["ts"], pa.scalar(self.since, pa.int64())), pc.less_equal(t["ts"], pa.scalar(self.until, pa.int64())))
                if self.symbols is not None:
                    keep = pc.and_(keep, pc.is_in(t["symbol"], pa.array(sorted(self.symbols), pa.string())))
                yield from t.filter(keep).select(BAR_COLUMNS).combine_chunks().to_batches()


class FileBars(DataSource):
    """spark.read.format("barloom_files").option("layout", ...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "barloom_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileBarsReader:
        return FileBarsReader(self.options)


def write_files(bars: DataFrame, path: str, layout: str = "symbol", period: int = 366 * 86400) -> None:
    """bars as files that ``FileBars`` reads; periods are of `period` seconds."""
    if layout == "symbol":
        bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.partitionBy("symbol").option("header", True).csv(path)
        return
    first = F.floor(F.col("ts") / period).cast("long") * period
    named = bars.withColumn("period", F.concat_ws("_", first, first + period - 1))
    named.repartition("period").sortWithinPartitions("symbol", "ts").write.partitionBy("period").option("header", True).csv(path)


class Connector(ABC):
    """A place of bars.  Volumes come in shares, whatever unit the place uses."""

    kind: str
    label: str
    timeframes: tuple[str, ...]
    adjust: str

    @abstractmethod
    def available(self, spark: SparkSession) -> tuple[bool, str]:
        """Whether it can be read now, and a hint if not."""

    @abstractmethod
    def read(self, spark: SparkSession) -> DataFrame:
        """All its bars; filters on symbol and ts should reach it."""

    def bars(self, spark: SparkSession, symbols: list[str] | None = None, since: int | None = None, until: int | None = None, last: int | None = None, closed_by: int | None = None, step: int = 86400) -> DataFrame:
        """Bars of the symbols (a short list of the caller's; None: all) from since to until, the last so many a symbol.

        With closed_by, a bar whose `step` seconds end after that time is still forming and left out.
        """
        got = self.read(spark)
        if symbols is not None:
            got = got.where(F.col("symbol").isin(symbols))
        if closed_by is not None:
            until = min(closed_by - step, until if until is not None else closed_by)
        for bound, test in ((since, F.col("ts") >= F.lit(since)), (until, F.col("ts") <= F.lit(until))):
            got = got.where(test) if bound is not None else got
        if last is not None:
            got = got.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_k") <= last).drop("_k")
        return got

    def symbols(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).select("symbol").distinct()


@dataclass(frozen=True)
class FileConnector(Connector):
    kind: str
    path: str
    layout: str = "symbol"
    label: str = ""
    volume_unit: float = 1.0
    timeframes: tuple[str, ...] = ("D1",)
    adjust: str = "raw"

    def available(self, spark: SparkSession) -> tuple[bool, str]:
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return (True, "") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else (False, f"no folder {self.path}")

    def read(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(FileBars)
        spark.conf.set(PUSHDOWN, "true")
        return spark.read.format(FileBars.name()).option("layout", self.layout).option("volume_unit", repr(self.volume_unit)).load(self.path)


@dataclass(frozen=True)
class FrameConnector(Connector):
    """Bars that Spark has already: a table, a store, or a view of one."""

    kind: str
    frame: DataFrame
    label: str = ""
    timeframes: tuple[str, ...] = ("D1",)
    adjust: str = "raw"

    def available(self, spark: SparkSession) -> tuple[bool, str]:
        return True, ""

    def read(self, spark: SparkSession) -> DataFrame:
        return self.frame.select(*BAR_COLUMNS)


class Registry:
    """Connectors by kind, in order of priority."""

    def __init__(self, *connectors: Connector):
        self._by: dict[str, Connector] = {}
        for c in connectors:
            self.add(c)

    def add(self, connector: Connector) -> None:
        if connector.kind in self._by:
            raise ValueError(f"a source of kind {connector.kind} is registered")
        self._by[connector.kind] = connector

    def get(self, kind: str) -> Connector:
        if kind not in self._by:
            raise ValueError(f"no source of kind {kind}: {', '.join(self._by)}")
        return self._by[kind]

    def listing(self, spark: SparkSession) -> list[dict]:
        """What a user chooses from: kind, label, whether it is there, a hint, timeframes, adjustment."""
        out = []
        for c in self._by.values():
            try:
                there, hint = c.available(spark)
            except Exception as e:  # a source that can't tell isn't there
                there, hint = False, str(e)
            out.append({"id": c.kind, "label": c.label or c.kind, "available": there, "hint": hint, "timeframes": list(c.timeframes), "adjust": c.adjust})
        return out

    def bars(self, spark: SparkSession, kinds: list[str] | None = None, fill_gaps: bool = False, **wanted) -> DataFrame:
        """Bars and their source: each symbol's from the first available source that has any.

        With fill_gaps, times that source lacks come from the next ones.  Either way each source is read once and what
        a bar's rivals hold is settled in one aggregation with partial combination.
        """
        order = [c for k, c in self._by.items() if kinds is None or k in kinds]
        order = [c for c in order if c.available(spark)[0]]
        if not order:
            raise ValueError("no source is available")
        union = functools.reduce(DataFrame.unionByName, [c.bars(spark, **wanted).withColumns({"rank": F.lit(i), "source": F.lit(c.kind)}) for i, c in enumerate(order)])
        values = [c for c in union.columns if c not in ("symbol", "ts")]
        best = union.groupBy("symbol", "ts").agg(F.min_by(F.struct(*values), "rank").alias("best")).select("symbol", "ts", "best.*")
        if not fill_gaps:
            first = union.groupBy("symbol").agg(F.min("rank").alias("rank"))
            best = best.join(first, ["symbol", "rank"])
        return best.select(*BAR_COLUMNS, "source")


def universe(spark: SparkSession, registry: Registry, least: int = 1000, markets: tuple[str, ...] = ("sh", "sz"), kinds: list[str] | None = None) -> DataFrame:
    """(symbol, market, sources): all instruments of the markets that any source has, codes normalised; fewer than `least` raise, as half a list is worse than none."""
    found = [c.symbols(spark).withColumn("source", F.lit(k)) for k, c in registry._by.items() if (kinds is None or k in kinds) and c.available(spark)[0]]
    if not found:
        raise ValueError("no source is available")
    named = normalized(functools.reduce(DataFrame.unionByName, found).withColumnRenamed("symbol", "written"), "written").where(F.col("market").isin(*markets))
    out = named.groupBy("symbol", "market").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    n = out.count()
    if n < least:
        raise RuntimeError(f"only {n} instruments, of {least} at least")
    return out


def with_priority(registry: Registry, *kinds: str) -> Registry:
    """The same connectors, those named first."""
    return Registry(*(registry.get(k) for k in kinds), *(c for k, c in registry._by.items() if k not in kinds))
