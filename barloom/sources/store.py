"""Bar, factor and label stores on Parquet.

A store is a folder of immutable versions and a log, whose last entry names the current ones; a write makes a new
version and then adds an entry, so readers never see half of it, and of two writers the second merges anew.  Bars are
partitioned by a hash of the symbol, and an upsert rewrites only the parts whose symbols it touches.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.plans.formula_a import formula_hash
from barloom.sources import cache
from barloom.sources.log import Log

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume", "amount"]
PARTS = 64


def merge_bars(old: DataFrame, new: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """New bars replace old ones of equal (symbol, ts); a symbol whose common closes were re-based loses its old bars.

    Re-based: at least `least` common bars, and over `share` of them apart by more than a factor of two, or a median
    ratio outside 0.5 .. 2.
    """
    both = old.select("symbol", "ts", F.col("close").alias("a")).join(new.select("symbol", "ts", F.col("close").alias("b")), ["symbol", "ts"]).where("a > 0 and b > 0")
    apart = F.avg((F.abs(F.ln(F.col("b") / F.col("a"))) > F.lit(0.6931471805599453)).cast("double"))
    mid = F.percentile(F.col("b") / F.col("a"), 0.5)
    bad = both.groupBy("symbol").agg(F.count("*").alias("n"), apart.alias("apart"), mid.alias("mid")).where((F.col("n") >= least) & ((F.col("apart") > share) | (F.col("mid") < 0.5) | (F.col("mid") > 2)))
    kept = old.join(bad.select("symbol"), "symbol", "left_anti").select(*BAR_COLUMNS).withColumn("_new", F.lit(0))
    union = kept.unionByName(new.select(*BAR_COLUMNS).withColumn("_new", F.lit(1)))
    last = Window.partitionBy("symbol", "ts").orderBy(F.desc("_new"), F.desc("volume"), F.desc("close"))
    return union.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_new")


class BarStore:
    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.log = Log(spark, self.path)

    def _pointer(self) -> tuple[int, dict[int, str]]:
        """The number of the next version, and the folder of each part now."""
        number, entry = self.log.last()
        return number, {int(p): f for p, f in (entry or {}).items() if p.isdigit()}

    def fingerprint(self) -> str:
        """Of all bars, from the sums that the log has of each part: no bar is read."""
        _, entry = self.log.last()
        sums = [tuple(map(int, v.split(","))) for k, v in (entry or {}).items() if k.startswith("sums-")]
        return ",".join(map(str, cache.added(sums)))

    def load(self, symbols: list[str] | None = None) -> DataFrame:
        _, now = self._pointer()
        schema = "symbol string, ts long, open double, high double, low double, close double, volume double, amount double"
        if not now:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(set(now.values()))])
        return found.where(F.col("symbol").isin(symbols)) if symbols is not None else found

    def upsert(self, new: DataFrame) -> None:
        """Rewrites the parts that new's symbols hash to; the others keep their files."""
        new = new.withColumn("_part", F.pmod(F.xxhash64("symbol"), F.lit(self.parts)).cast("int"))
        touched = sorted(r[0] for r in new.select("_part").distinct().collect())
        if not touched:
            return
        while True:
            (number, now), version = self._pointer(), uuid.uuid4().hex
            held = [f"{self.path}/{now[p]}" for p in touched if p in now]
            out = new.drop("_part").select(*BAR_COLUMNS)
            if held:
                out = merge_bars(self.spark.read.parquet(*held).select(*BAR_COLUMNS), out)
            out = out.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(self.parts)).cast("int"))
            out.repartition("part").sortWithinPartitions("symbol", "ts").write.partitionBy("part").parquet(f"{self.path}/{version}")
            made = self.spark.read.parquet(f"{self.path}/{version}")  # whole, and on disk: hashing it costs no merge
            sums = {f"sums-{r.part}": f"{r.n},{int(r.a) % cache.WORD},{int(r.b) % cache.WORD}" for r in made.groupBy("part").agg(*cache.row_sums(made, BAR_COLUMNS)).collect()}
            kept = {k: v for k, v in (self.log.entry(f"{number - 1:012d}") if number else {}).items() if k.startswith("sums-")}
            if self.log.append(number, {str(k): v for k, v in (now | {p: f"{version}/part={p}" for p in touched}).items()} | kept | sums):
                return
            self.log.delete(version)


class FactorStore:
    """Factors keyed by symbol and the hash of formula and vocabulary, in folders that a log names: readers see a factor's old
    version until the new one is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, self.path)

    def save(self, factor: DataFrame, formula: list[int], version: str, kind: str = "tokens", report: dict[str, float] | None = None) -> str:
        """factor: symbol, ts, factor.  A factor of the same id gets a new version."""
        fid = formula_hash(formula, version)
        folder = f"factors/{uuid.uuid4().hex}"
        factor.select("symbol", "ts", "factor").write.parquet(f"{self.path}/{folder}")
        entry = {"factor_id": fid, "folder": folder, "kind": kind, "formula": list(formula), "version": version, "report": {k: float(v) for k, v in (report or {}).items()}}
        while not self.log.append(self.log.last()[0], entry):
            pass
        return fid

    def _now(self) -> dict[str, dict]:
        return {e["factor_id"]: e for e in self.log.entries()}

    def index(self) -> DataFrame:
        rows = [(e["factor_id"], e["kind"], e["formula"], e["version"], e["report"]) for e in self._now().values()]
        return self.spark.createDataFrame(rows, "factor_id string, kind string, formula array<int>, version string, report map<string, double>")

    def load(self, factor_id: str | None = None) -> DataFrame:
        held = [e for f, e in self._now().items() if factor_id in (None, f)]
        empty = self.spark.createDataFrame([], "symbol string, ts long, factor double, factor_id string")
        parts = [self.spark.read.parquet(f"{self.path}/{e['folder']}").withColumn("factor_id", F.lit(e["factor_id"])) for e in held]
        return functools.reduce(DataFrame.unionByName, parts) if parts else empty

    def listing(self, by: str = "ic") -> DataFrame:
        return self.index().withColumn(by, F.col("report")[by]).orderBy(F.desc_nulls_last(by), "factor_id")
