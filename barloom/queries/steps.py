"""Audits, cached sets and the small steps, on bars of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import audit, backtest, gates, search
from barloom.plans.formula_b import ParamFormula
from barloom.queries.numeric import _scratch
from barloom.registry import query
from barloom.sources import bars, cache, store

FORMULAS = [ParamFormula("ret", None, 20, None, None, None, 1, "Mean", None, 0), ParamFormula("close", "volume", 10, None, None, None, 2, "Corr", "Corr", -1)]


@query("audit_causality", f"SELECT c AS \"column\", symbol, CAST(greatest(count(*) - 100, 0) AS BIGINT) AS n_compared, 0e0 AS max_rewrite, CAST(NULL AS BIGINT) AS first_rewrite, true AS passed FROM ({bars.BRAND_SQL}), (SELECT unnest(['f0', 'f1']) AS c) GROUP BY c, symbol HAVING count(*) > 100")
def causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two formulas' values before the last 100 bars don't change when those do."""
    make = lambda b: search.panel_of(b, FORMULAS).drop("y")
    return audit.causality(make, bars.bars_brand(spark, sf_dir))


@query("audit_look_ahead", f"""WITH b AS (SELECT symbol, ts, close, count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY ts) AS behind FROM ({bars.BRAND_SQL})),
  n AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS a FROM b)
  SELECT 'f' AS "column", symbol, count(*) FILTER (behind >= 100) AS n_compared, round(max(CASE WHEN behind = 100 THEN 0.5 * (a + 1) ELSE 0 END), 9) AS max_rewrite, max(CASE WHEN behind = 100 THEN ts END) AS first_rewrite, false AS passed FROM n WHERE behind >= 100 GROUP BY symbol""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next bar's return taken as a factor is caught at the bar before the changed ones."""
    make = lambda b: b.selectExpr("symbol", "ts", "lead(close) over (partition by symbol order by ts) / close - 1e0 AS f")
    return audit.causality(make, bars.bars_brand(spark, sf_dir)).withColumn("max_rewrite", F.round("max_rewrite", 9))


@query("audit_pulse", f"""WITH v AS ({backtest.FACTOR_VIEW.replace("@bars", f"({bars.SUPP_SQL})")}), n AS (SELECT symbol, ts, f, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, lag(f) OVER w AS f0 FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts))
  SELECT CAST(p AS DOUBLE) AS place, symbol, round(tanh(coalesce(f0, 0)), 6) AS before, true AS passed FROM n, (SELECT unnest([0.5, 0.9]) AS p) WHERE i = floor(n * p) AND n >= 30""")
def pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backtest held one bar: who earns a step of the close is what the bar before wanted."""
    view = spark.sql(backtest.FACTOR_VIEW.replace("@bars", "{bars}"), bars=bars.bars_supp(spark, sf_dir))
    found = audit.pulse(lambda panel: backtest.backtest_nav(panel, horizon=1, cost=0.0, limits=False), view.select("symbol", "ts", "f", "close"), tolerance=2e-5)  # pnl comes with six digits
    return found.select("place", "symbol", "before", "passed")


@query("ds_cached", bars.BRAND_SQL)
def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars put into a store, and a set of them kept under its fingerprint; the second call only reads what is kept."""
    at = f"{_scratch(spark)}/cached-{uuid.uuid4().hex}"
    held = store.BarStore(spark, f"{at}/bars", 8)
    held.upsert(bars.bars_brand(spark, sf_dir))
    kept = cache.DatasetCache(spark, f"{at}/sets")
    kept.get({"horizon": 5}, [held.fingerprint()], held.load)
    return kept.get({"horizon": 5}, [held.fingerprint()], lambda: 1 / 0)


@query("gate_best_correlation", f"""WITH b AS (SELECT symbol, ts, volume, coalesce(lead(close, 5) OVER w / close - 1, 0) AS y, close / nullif(lag(close, 5) OVER w, 0) - 1 AS mom, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM ({bars.BRAND_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY ts))
  SELECT symbol, round(greatest(coalesce(abs(corr(mom, y)), 0), coalesce(abs(corr(volume, y)), 0)), 9) AS best FROM b WHERE k <= 60 GROUP BY symbol""")
def late_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "over (partition by symbol order by ts)"
    panel = bars.bars_brand(spark, sf_dir).selectExpr("symbol", "ts", "volume", f"coalesce(lead(close, 5) {p} / close - 1e0, 0e0) AS y", f"close / nullif(lag(close, 5) {p}, 0e0) - 1e0 AS mom")
    return gates.best_correlation(panel, ["mom", "volume"]).withColumn("best", F.round("best", 9))


@query("gate_quick")
def quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.quick_gate(bars.bars_brand(spark, sf_dir))


@query("join_tail", f"""WITH b AS ({bars.BRAND_SQL}), s AS (SELECT symbol, list(row(ts, close) ORDER BY ts) AS l, list(ts ORDER BY ts) FILTER (volume > 20) AS m FROM b GROUP BY symbol)
  SELECT symbol, l[len(l) - i][1] AS ts, l[len(l) - i][2] AS close, m[len(m) - i] AS b_ts FROM s, range(10000) r(i) WHERE i < len(l) AND i < coalesce(len(m), 0)""")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes beside the times of large bars, counted from the end."""
    b = bars.bars_brand(spark, sf_dir)
    return gates.tail_join(b.select("symbol", "ts", "close"), b.where("volume > 20").select("symbol", "ts"))


@query("join_axis", f"WITH b AS (SELECT symbol, ts, close FROM ({bars.SUPP_SQL})), t AS (SELECT DISTINCT ts FROM b), s AS (SELECT DISTINCT symbol FROM b) SELECT s.symbol, t.ts, coalesce(close, 0) AS close FROM s CROSS JOIN t LEFT JOIN b ON b.symbol = s.symbol AND b.ts = t.ts")
def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' closes at all weeks that any has, 0 where one has none."""
    b = bars.bars_supp(spark, sf_dir).select("symbol", "ts", "close")
    return gates.on_axis(b, b, {"close": 0.0})


@query("join_common", f"SELECT symbol FROM ({bars.SUPP_SQL}) GROUP BY symbol HAVING max(volume) > 90 AND count(*) > 30")
def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a large week among those with more than 30 weeks."""
    b = bars.bars_supp(spark, sf_dir)
    return gates.common(b.where("volume > 90"), b.groupBy("symbol").count().where("count > 30"))


@query("gate_threshold", f"SELECT symbol, ts, close / open - 1 AS score FROM ({bars.SUPP_SQL}) WHERE abs(close / open - 1) >= 0.05")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.over_threshold(bars.bars_supp(spark, sf_dir).selectExpr("symbol", "ts", "close / open - 1e0 AS score"), 0.05)
