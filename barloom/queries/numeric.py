"""Queries of operators that SQL can't express: statistics, optimisers, models, search, stores and streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import recursive
from barloom.operators import backtest, certify, models, optimize, policy, search, significance
from barloom.registry import query
from barloom.session import table
from barloom.sources import bars, connectors, store
from barloom.sources.codes import normalized
from barloom.streaming import bars as stream
from barloom.streaming import ordered

STYLES = ["mom", "vol", "turn"]


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, symbol, industry, ret (known at ts), label (next), score and styles of suppliers."""
    p = "partition by symbol order by ts"
    b = bars.bars_supp(spark, sf_dir).withColumn("ret", F.expr(f"close / nullif(lag(close) over ({p}), 0e0) - 1e0"))
    return b.select("ts", "symbol", "industry", "ret", *[F.expr(e).alias(n) for n, e in {
        "label": f"lead(ret) over ({p})",
        "mom": f"close / nullif(lag(close, 5) over ({p}), 0e0) - 1e0",
        "vol": f"stddev_pop(ret) over ({p} rows between 19 preceding and current row)",
        "turn": f"volume / nullif(avg(volume) over ({p} rows between 19 preceding and current row), 0e0) - 1e0",
    }.items()]).withColumn("score", F.col("mom"))


_BY_BAR = "OVER (PARTITION BY symbol ORDER BY ts)"
#: The same panel for the checks.
PANEL_SQL = f"""SELECT *, mom AS score FROM (SELECT ts, symbol, industry, ret, lead(ret) {_BY_BAR} AS label, close / nullif(lag(close, 5) {_BY_BAR}, 0) - 1 AS mom, stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS vol,
  volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), 0) - 1 AS turn FROM (SELECT *, close / nullif(lag(close) {_BY_BAR}, 0) - 1 AS ret FROM ({bars.SUPP_SQL})))"""


@query("num_factor_report")
def factor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "partition by symbol order by ts"
    return significance.factor_reports(bars.bars_brand(spark, sf_dir).select("symbol", "ts", F.expr(f"close / nullif(lag(close, 5) over ({p}), 0e0) - 1e0").alias("f"), F.expr(f"lead(close, 5) over ({p}) / close - 1e0").alias("y")))


_RETURNS = "coalesce(close / nullif(lag(close) over (partition by symbol order by ts), 0e0) - 1e0, 0e0)"
_PBO_SQL = f"""WITH RECURSIVE r AS (SELECT symbol, ts, {_RETURNS} AS pnl FROM ({bars.BRAND_SQL})),
chosen(k, picked) AS (SELECT i, [i] FROM range(8) t(i) UNION ALL SELECT i, list_append(picked, i) FROM chosen, range(8) t(i) WHERE i > k AND len(picked) < 4),
splits AS (SELECT picked FROM chosen WHERE len(picked) = 4),
clock AS (SELECT list_sort(list(DISTINCT ts)) AS all_ts FROM r),
b AS (SELECT symbol, (list_position(all_ts, ts) - 1) // (len(all_ts) // 8) AS b, sum(pnl) / any_value(len(all_ts) // 8) AS x FROM r, clock GROUP BY symbol, b),
h AS (SELECT picked, symbol, sum(CASE WHEN list_contains(picked, b) THEN x ELSE 0 END) / 4 AS train, sum(CASE WHEN list_contains(picked, b) THEN 0 ELSE x END) / 4 AS test FROM b, splits WHERE b < 8 GROUP BY picked, symbol),
w AS (SELECT picked, arg_max(test, train) AS best, stddev_pop(train) >= 1e-9 AS told FROM h GROUP BY picked),
v AS (SELECT picked, avg(CASE WHEN test > best THEN 1.0 ELSE 0.0 END) > 0.5 AND any_value(told) AS worse FROM h JOIN w USING (picked) GROUP BY picked)
SELECT round(avg(CASE WHEN worse THEN 1.0 ELSE 0.0 END), 9) AS pbo, (SELECT count(DISTINCT symbol) FROM b) AS n_series, count(*) AS n_splits FROM v"""


@query("num_overfit_probability", _PBO_SQL)
def overfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the weekly returns of the brands as competing series."""
    panel = bars.bars_brand(spark, sf_dir).select(F.col("symbol").alias("series"), "ts", F.expr(_RETURNS).alias("pnl"))
    return certify.overfit_probability(panel, 8).withColumn("pbo", F.round("pbo", 9))


def candidates_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three factors of suppliers' bars as formulas (with five-bar labels), and as candidates of the first symbol; scores by rule."""
    wide = spark.sql(backtest.FACTOR_VIEW.replace("@bars", "{bars}"), bars=bars.bars_supp(spark, sf_dir))
    panel = wide.selectExpr("symbol", "ts", "y5 AS y", "stack(3, 'f', f, 'g', g, 'f-g', f - g) AS (formula, f)")
    return panel, panel.groupBy("formula").agg(F.min("symbol").alias("source")).withColumn("five_total", F.when(F.col("formula") == "g", 0.3).otherwise(0.6).cast("double"))


_CERT_SQL = f"""WITH w AS ({backtest.FACTOR_VIEW.replace("@bars", f"({bars.SUPP_SQL})")}),
p AS (SELECT 'f' AS formula, symbol, ts, f, y5 AS y FROM w UNION ALL SELECT 'g', symbol, ts, g, y5 FROM w UNION ALL SELECT 'f-g', symbol, ts, f - g, y5 FROM w),
l AS (SELECT formula, symbol, list_sort(list(row(ts, f, y))) AS l FROM p WHERE f IS NOT NULL AND y IS NOT NULL GROUP BY formula, symbol),
k AS (SELECT formula, symbol, greatest(250, len(l) // 4) AS keep, l FROM l WHERE greatest(250, len(l) // 4) < len(l)),
o AS (SELECT formula, symbol, keep, unnest(l[len(l) - keep + 1:]) AS r FROM k),
s AS (SELECT formula, count(*) AS n_stocks, min(keep) AS oos FROM k GROUP BY formula),
x AS (SELECT formula, r[1] AS ts, r[2] AS f, r[3] AS y FROM o),
rk AS (SELECT formula, ts, f, y, rank() OVER (PARTITION BY formula, ts ORDER BY f) + (count(*) OVER (PARTITION BY formula, ts, f) + 1) / 2.0 AS a, rank() OVER (PARTITION BY formula, ts ORDER BY y) + (count(*) OVER (PARTITION BY formula, ts, y) + 1) / 2.0 AS b FROM x),
ic AS (SELECT formula, ts, corr(a, b) AS ic FROM rk GROUP BY formula, ts HAVING count(*) >= 8 AND stddev_pop(f) >= 1e-12 AND stddev_pop(y) >= 1e-12),
li AS (SELECT formula, list(ic ORDER BY ts) AS v FROM ic GROUP BY formula),
d AS (SELECT formula, len(v) AS n_days, list_avg(v) AS mean_ic, list_avg(v[:len(v) // 2]) AS first_half, list_avg(v[len(v) // 2 + 1:]) AS second_half, len(v) // 20 AS nb, v FROM li),
dr AS (SELECT formula, i, avg(list_sum(v[(('0x' || substr(md5('0-' || i || '-' || j), 1, 8))::BIGINT % nb) * 20 + 1:(('0x' || substr(md5('0-' || i || '-' || j), 1, 8))::BIGINT % nb) * 20 + 20]) / 20) AS boot FROM d, range(500) t(i), range(100) u(j) WHERE j < nb GROUP BY formula, i),
pv AS (SELECT formula, avg(CASE WHEN abs(boot - m) >= abs(mean_ic) THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT *, avg(boot) OVER (PARTITION BY formula) AS m FROM dr) JOIN d USING (formula) GROUP BY formula)
SELECT formula, (SELECT min(symbol) FROM w) AS source, 'cross' AS mode, n_stocks, n_days, round(mean_ic, 9) AS mean_ic, p, round(first_half, 9) AS first_half, round(second_half, 9) AS second_half, CASE WHEN formula = 'g' THEN 0.3e0 ELSE 0.6e0 END AS five_total,
  n_days >= least(250, greatest(200, oos - 10)) AS enough, first_half * second_half > 0 AS agrees, abs(mean_ic) >= 0.02 AS strong, p <= 0.05 AS significant, formula <> 'g' AS rounded,
  n_days >= least(250, greatest(200, oos - 10)) AND first_half * second_half > 0 AND abs(mean_ic) >= 0.02 AND p <= 0.05 AND formula <> 'g' AS certified FROM d JOIN pv USING (formula) JOIN s USING (formula)"""


@query("cert_certify", _CERT_SQL)
def certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across 8 symbols at least, as the smallest tables have 10."""
    found = certify.certify(*candidates_of(spark, sf_dir), least_stocks=8)
    return found.withColumns({c: F.round(c, 9) for c in ("mean_ic", "first_half", "second_half")})


@query("num_neutralize")
def neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize.neutralize(supplier_panel(spark, sf_dir), "score", ["vol", "turn"], "industry")


_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_GRAM = ["mm", "mv", "mt", "mv", "vv", "vt", "mt", "vt", "tt"]
_CRAMER = [_DET.format(*(x if i % 3 != k else ("my", "vy", "ty")[i // 3] for i, x in enumerate(_GRAM))) for k in range(3)]
_RISK_SQL = f"""WITH g AS (SELECT ts, covar_pop(mom, mom) AS mm, covar_pop(mom, vol) AS mv, covar_pop(mom, turn) AS mt, covar_pop(vol, vol) AS vv, covar_pop(vol, turn) AS vt, covar_pop(turn, turn) AS tt, covar_pop(mom, ret) AS my, covar_pop(vol, ret) AS vy, covar_pop(turn, ret) AS ty
  FROM ({PANEL_SQL}) WHERE ret IS NOT NULL AND mom IS NOT NULL AND vol IS NOT NULL AND turn IS NOT NULL GROUP BY ts HAVING count(*) >= 10)
SELECT ts, {", ".join(f"round({c} / {_DET.format(*_GRAM)}, 6) AS {n}" for c, n in zip(_CRAMER, STYLES, strict=True))} FROM g"""


@query("num_risk_model", _RISK_SQL)
def risk_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the suppliers' styles at each time."""
    found = optimize.factor_returns(supplier_panel(spark, sf_dir), STYLES)
    return found.select("ts", *[F.round(s, 6).alias(s) for s in STYLES])


@query("num_risk_decomposition")
def risk_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the five suppliers with the best score at each time."""
    n = F.expr("row_number() over (partition by ts order by score desc, symbol)")
    return optimize.decompose_risk(supplier_panel(spark, sf_dir).where("score is not null").withColumn("w", F.when(n <= 5, 0.2).otherwise(0.0)), STYLES)


for _method in ("markowitz", "risk_parity"):
    query(f"num_optimize_{_method}")(lambda spark, sf_dir, m=_method: optimize.optimize_panel(supplier_panel(spark, sf_dir), m))


_LIMIT_SQL = f"""WITH RECURSIVE w AS (SELECT ts, symbol, CASE WHEN row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) <= 5 THEN 0.2e0 ELSE 0e0 END AS w, coalesce(ret, 0e0) AS ret FROM ({PANEL_SQL}) WHERE score IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM w),
h AS (SELECT symbol, ts, i, ret, 0e0 AS last, CASE WHEN ret >= 0.099e0 AND w > 0e0 OR ret <= -0.099e0 AND w < 0e0 THEN 0e0 ELSE w END AS held FROM n WHERE i = 1 UNION ALL
      SELECT n.symbol, n.ts, n.i, n.ret, held, CASE WHEN n.ret >= 0.099e0 AND w > held OR n.ret <= -0.099e0 AND w < held THEN held ELSE w END FROM h JOIN n ON n.symbol = h.symbol AND n.i = h.i + 1)
SELECT ts, round(sum(last * CASE WHEN abs(ret) > 0.21e0 THEN 0e0 ELSE ret END) - 0.0003e0 * sum(abs(held - last)), 9) AS pnl FROM h GROUP BY ts"""


@query("num_limit_backtest", _LIMIT_SQL)
def limit_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily pnl of ranked weights that limits block, symbol by symbol, summed per time."""
    n = F.expr("row_number() over (partition by ts order by score desc, symbol)")
    w = supplier_panel(spark, sf_dir).where("score is not null").select("ts", "symbol", F.when(n <= 5, 0.2).otherwise(0.0).alias("w"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    held = recursive.limit_blocked(w).withColumn("last", F.expr("coalesce(lag(held) over (partition by symbol order by ts), 0e0)"))
    safe = F.when(F.abs("ret") > 0.21, 0.0).otherwise(F.col("ret"))
    return held.groupBy("ts").agg(F.round(F.sum(F.col("last") * safe) - 0.0003 * F.sum(F.abs(F.col("held") - F.col("last"))), 9).alias("pnl"))


_NUMBERED = f"SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({bars.BRAND_SQL})"


@query("num_ema_long", f"WITH RECURSIVE b AS ({_NUMBERED}), e AS (SELECT symbol, ts, close, rn, close AS ema FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.ts, b.close, b.rn, 2e0 / 21e0 * b.close + 19e0 / 21e0 * e.ema FROM e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1) SELECT symbol, ts, close, ema FROM e")
def ema_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.ema(bars.bars_brand(spark, sf_dir).select("symbol", "ts", "close"), "close", 20)


for _model in models.MODELS:
    query(f"ml_{_model}")(lambda spark, sf_dir, m=_model: models.walk_forward(supplier_panel(spark, sf_dir).where("label is not null"), STYLES, m, train=100, step=50))


@query("pf_combine_ml")
def combine_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' styles combined by a forest, refitted every 20 weeks on 120."""
    return models.combine_ml(supplier_panel(spark, sf_dir), STYLES)[0]


@query("pf_combine_ml_importance")
def combine_ml_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.combine_ml(supplier_panel(spark, sf_dir), STYLES)[1]


@query("search_nsga")
def nsga(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the library's own defaults: 12 formulas, 2 generations, five objectives."""
    found = search.mine(bars.bars_brand(spark, sf_dir))
    return spark.createDataFrame([(f.signature(), *map(float, s)) for f, s in found], "formula string, ic double, up_share double, top_return double, top_sharpe double, top_win double")


@query("search_policy")
def by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short search for token formulas over brands' bars: two steps of six formulas of up to five tokens."""
    found = policy.mine_policy(bars.bars_brand(spark, sf_dir), 2, settings=policy.Settings(batch=6, length=5))
    return spark.createDataFrame([(" ".join(t), float(x)) for x, t in found], "formula string, reward double")


@query("stream_ordered_ema", f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM (SELECT *, max(ts) OVER () AS last FROM events) WHERE date_trunc('day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY <= last - INTERVAL 2 DAYS),
  m AS (SELECT symbol, event_id, k, value AS ema FROM e WHERE k = 1 UNION ALL SELECT e.symbol, e.event_id, e.k, e.value / 3 + m.ema * 2 / 3 FROM m JOIN e ON e.symbol = m.symbol AND e.k = m.k + 1) SELECT symbol, event_id, round(ema, 6) AS ema FROM m""")
def ordered_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream's exponential mean in event time, run to its end: events the watermark has passed."""
    at = f"{_scratch(spark)}/ema-{uuid.uuid4().hex}"
    out = ordered.ordered_ema(stream.events(spark, sf_dir), 5, step=86400)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("symbol", "event_id", F.round("ema", 6).alias("ema"))


_OBJ_SQL = f"""WITH b AS (SELECT symbol, ts, close, volume, lead(close, 5) OVER w / close - 1 AS y, close / nullif(lag(close, 5) OVER w, 0) - 1 AS mom, volume AS vol FROM ({bars.BRAND_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT symbol, list(coalesce(mom, 0) ORDER BY ts) AS f, list(y ORDER BY ts) AS y FROM b WHERE y IS NOT NULL GROUP BY symbol),
k AS (SELECT symbol, t, unnest(f[t - 19:t]) AS f, unnest(y[t - 19:t]) AS y FROM l, range(20, 5000) r(t) WHERE t < len(f)),
c AS (SELECT symbol, CASE WHEN stddev_pop(f) >= 1e-9 AND stddev_pop(y) >= 1e-9 THEN covar_pop(f, y) / (stddev_pop(f) * stddev_pop(y)) END AS r FROM k GROUP BY symbol, t),
i AS (SELECT symbol, abs(avg(r)) AS ic, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS up FROM c GROUP BY symbol),
u AS (SELECT symbol, unnest(f) AS f, unnest(y) AS y FROM l), q AS (SELECT symbol, quantile_cont(f, 0.9) AS cut FROM u GROUP BY symbol),
t AS (SELECT symbol, count(*) AS n, avg(y) AS a, stddev_pop(y) AS s, avg(CAST(y > 0 AS INT)) AS w FROM u JOIN q USING (symbol) WHERE f >= cut GROUP BY symbol)
SELECT symbol, round(ic, 9) AS mom_ic, round(up, 9) AS mom_up, round(CASE WHEN n < 5 THEN 0 ELSE a END, 9) AS mom_ret, round(CASE WHEN n < 5 OR s <= 1e-9 THEN 0 ELSE greatest(-10, least(10, a / (s + 1e-9) * sqrt(244))) END, 6) AS mom_sharpe, round(CASE WHEN n < 5 THEN 0 ELSE w END, 9) AS mom_win FROM i JOIN t USING (symbol)"""


@query("search_objectives", _OBJ_SQL)
def five_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five objectives of a plain momentum factor, by symbol."""
    p = "over (partition by symbol order by ts)"
    b = bars.bars_brand(spark, sf_dir).selectExpr("symbol", "ts", f"lead(close, 5) {p} / close - 1e0 AS y", f"close / nullif(lag(close, 5) {p}, 0e0) - 1e0 AS mom")
    got = search.series_objectives(b, ["mom"])
    return got.select("symbol", *[F.round(c, 6 if c == "mom_sharpe" else 9).alias(c) for c in got.columns[1:]])


@query("store_round_trip", bars.BRAND_SQL)
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars put into a fresh store in two overlapping halves, and read back."""
    place = store.BarStore(spark, f"{_scratch(spark)}/bars-{uuid.uuid4().hex}", 8)
    b = bars.bars_brand(spark, sf_dir)
    place.upsert(b.where("ts < 883612800"))
    place.upsert(b.where("ts >= 820454400"))
    return place.load()


_RIVALS = {"first": "substr(symbol, 8, 1) IN ('1', '2', '3') AND ts % 4233600 <> 0", "second": "substr(symbol, 7, 1) IN ('1', '2')", "third": "true"}


def rivals(spark: SparkSession, sf_dir: str) -> connectors.Registry:
    """Brands' bars as three sources: files by symbol with gaps, files by year with volumes in lots, and the bars themselves."""
    at = f"{_scratch(spark)}/rivals-{uuid.uuid4().hex}"
    b = bars.bars_brand(spark, sf_dir)
    connectors.write_files(b.where(_RIVALS["first"]), f"{at}/first")
    connectors.write_files(b.where(_RIVALS["second"]).withColumn("volume", F.col("volume") / 100), f"{at}/second", "period")
    return connectors.Registry(connectors.FileConnector("first", f"{at}/first"), connectors.FileConnector("second", f"{at}/second", "period", volume_unit=100.0), connectors.FrameConnector("third", b))


def _rivals_sql(fill: bool) -> str:
    tests = " ".join(f"WHEN {t} THEN '{k}'" for k, t in _RIVALS.items())
    own = f"SELECT *, CASE {tests} END AS source FROM b" if fill else f"SELECT *, CASE {tests.replace(' AND ts % 4233600 <> 0', '')} END AS source FROM b"
    gaps = "" if fill else f"WHERE NOT (source = 'first' AND NOT ({_RIVALS['first']}))"
    return f"WITH b AS ({bars.BRAND_SQL}) SELECT symbol, ts, open, high, low, close, CASE WHEN source = 'second' THEN volume / 100e0 * 100e0 ELSE volume END AS volume, amount, source FROM ({own}) {gaps}"


@query("src_fallback", _rivals_sql(False))
def by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's bars from the first of three sources that has it."""
    return rivals(spark, sf_dir).bars(spark)


@query("src_gaps_filled", _rivals_sql(True))
def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and times that its source lacks from the next."""
    return rivals(spark, sf_dir).bars(spark, fill_gaps=True)


def _scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; where none is set, in local mode, one that goes with the driver."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="barloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    return f"{shared.rstrip('/')}/barloom-core"


_DAILY = """SELECT event_type AS symbol, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, arg_max(value, row(ts, event_id)) * count(*) AS amount FROM events GROUP BY ALL"""


@query("stream_daily_bars", _DAILY.replace("GROUP BY ALL", "GROUP BY event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"))
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the event stream, run to its end; days still open count as they are then."""
    at = f"{_scratch(spark)}/daily-{uuid.uuid4().hex}"
    run = stream.daily(stream.events(spark, sf_dir)).writeStream.outputMode("update").foreachBatch(stream.revisions_into(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.latest(spark, f"{at}/out")


_K = "lpad(CAST(s_suppkey AS VARCHAR), 5, '0')"
_KIND = "CASE s_suppkey % 4 WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END"
_CODE = _KIND.format(f"'3' || {_K}", f"'RB' || right({_K}, 4)", f"'6' || {_K}")
_MARKET = _KIND.format("'sz'", "'fut'", "'sh'")


@query("scan_codes", f"SELECT {_MARKET} AS market, {_CODE} AS code, {_KIND.format(f"'sz3' || {_K}", f"'RB' || right({_K}, 4)", f"'sh6' || {_K}")} AS symbol, false AS is_index FROM supplier")
def scan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' keys written as instrument codes in four forms, and normalised."""
    k = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    form = F.col("s_suppkey") % 4
    written = F.when(form == 0, F.concat(F.lit(" SH6"), k)).when(form == 1, F.concat(F.lit("6"), k, F.lit(".SH"))).when(form == 2, F.concat(F.lit("3"), k)).otherwise(F.concat(F.lit("rb"), F.right(k, F.lit(4))))
    return normalized(table(spark, sf_dir, "supplier").select(written.alias("code")), "code")
