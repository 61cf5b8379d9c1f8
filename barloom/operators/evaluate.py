"""Evaluation of factors: correlation series, decay, buckets, stability.

The factor of these queries is the five-bar return, the label the five-bar forward return; the SqlOps take any
relation with the columns of bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.functions.sqlop import P, SqlOp, avg_rank, r, safe_corr, sql_op
from barloom.operators import language_a
from barloom.plans.staged import DUCK, SPARK, Kit, Plan
from barloom.registry import query
from barloom.sources import bars

PANEL = f"""v0 AS (SELECT symbol, ts, close, volume, row_number() OVER ({P}) AS rn, close / nullif(lag(close, 5) OVER ({P}), 0e0) - 1e0 AS f,
  lead(close, 5) OVER ({P}) / close - 1e0 AS y, close / nullif(lag(close) OVER ({P}), 0e0) - 1e0 AS r1, lead(close) OVER ({P}) / close - 1e0 AS y1 FROM @bars),
v AS (SELECT * FROM v0 WHERE f IS NOT NULL AND y IS NOT NULL)"""


def rank_ic_text(rel: str, least: int = 10) -> str:
    return f"""SELECT ts, cast(count(*) as bigint) AS n, {r(safe_corr('rf', 'ry'))} AS rank_ic
    FROM (SELECT ts, {avg_rank('ts', 'f')} AS rf, {avg_rank('ts', 'y')} AS ry FROM {rel} WHERE f IS NOT NULL AND y IS NOT NULL) x GROUP BY ts HAVING count(*) >= {least}"""


def _flagship(kit: Kit) -> tuple[Plan, dict[str, str]]:
    p = Plan(kit)
    ret5 = p.let(f"coalesce(close / {kit.lag('close', 5)} - 1e0, 0e0)")
    z = language_a.apply(p, "TS_ZSCORE_20", ret5)
    return p, {"f": language_a.apply(p, "CS_RANK", z), "y": p.let(f"lead(close, 5) over ({kit.P}) / close - 1e0")}


_plan, _out = _flagship(DUCK)


@query("flagship_rankic", f"WITH panel AS ({_plan.sql(bars.numbered_sql(bars.BRAND_SQL), _out)}) {rank_ic_text('panel')}")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly rank correlation of ranked, standardised five-week returns with the next five weeks'."""
    return flagship_of(bars.bars_brand(spark, sf_dir))


def flagship_of(frame: DataFrame) -> DataFrame:
    p, out = _flagship(SPARK)
    return frame.sparkSession.sql(rank_ic_text("{panel}"), panel=p.spark(bars.numbered(frame), out))


rank_ic = sql_op("eval_rank_ic")(lambda k: f"WITH {PANEL} {rank_ic_text('v')}")


@sql_op("eval_ic_summary")
def ic_summary(k: Kit) -> str:
    return f"""WITH {PANEL}, i AS ({rank_ic_text('v')})
    SELECT cast(count(rank_ic) as bigint) AS n_days, {r('avg(rank_ic)')} AS mean_ic, {r('stddev_pop(rank_ic)')} AS sd_ic,
      {r('avg(rank_ic) / nullif(stddev_pop(rank_ic), 0e0) * sqrt(244e0)')} AS icir, {r('avg(CASE WHEN rank_ic > 0e0 THEN 1e0 ELSE 0e0 END)')} AS win_share FROM i"""


_W = f"OVER ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@sql_op("eval_seq_ic")
def seq_ic(k: Kit) -> str:
    """Correlation in time over the 20 bars before each bar; flat windows give none."""
    c, sx, sy = f"covar_pop(f, y) {_W}", f"stddev_pop(f) {_W}", f"stddev_pop(y) {_W}"
    return f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER ({P}) AS i FROM v),
    w AS (SELECT symbol, ts, i, {c} AS c, {sx} AS sx, {sy} AS sy FROM n)
    SELECT symbol, ts, {r('c / (sx * sy)')} AS ic FROM w WHERE i > 20 AND sx >= 1e-9 AND sy >= 1e-9"""


@sql_op("eval_half_life")
def half_life(k: Kit) -> str:
    """Bars in which the absolute block mean of the rolling correlation halves (log-linear fit over blocks of 22)."""
    c, sx, sy = f"covar_pop(f, y) {_W}", f"stddev_pop(f) {_W}", f"stddev_pop(y) {_W}"
    return f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER ({P}) AS i FROM v), w AS (SELECT symbol, ts, i, {c} AS c, {sx} AS sx, {sy} AS sy FROM n),
    ic AS (SELECT symbol, c / (sx * sy) AS ic, row_number() OVER ({P}) AS q, count(*) OVER (PARTITION BY symbol) AS n FROM w WHERE i > 20 AND sx >= 1e-9 AND sy >= 1e-9),
    b AS (SELECT symbol, floor((q - 1) / 22e0) AS t, ln(greatest(abs(avg(ic)), 1e-9)) AS l FROM ic WHERE n >= 44 AND q <= floor(n / 22e0) * 22 GROUP BY symbol, floor((q - 1) / 22e0)),
    s AS (SELECT symbol, (avg(t * l) - avg(t) * avg(l)) / nullif(avg(t * t) - avg(t) * avg(t), 0e0) AS slope FROM b GROUP BY symbol)
    SELECT symbol, {r('CASE WHEN slope < 0e0 THEN greatest(1e0, least(1e6, -ln(2e0) / slope)) END', 4)} AS half_life FROM s"""


@sql_op("eval_ic_decay")
def ic_decay(k: Kit) -> str:
    """Pearson correlation with the one-bar return 1 to 10 bars on."""
    leads = ", ".join(f"lead(r1, {h}) OVER ({P}) AS r{h}x" for h in range(1, 11))
    cols = " UNION ALL ".join(f"SELECT symbol, {h} AS horizon, {r(safe_corr('f', f'r{h}x'))} AS ic FROM l WHERE f IS NOT NULL AND r{h}x IS NOT NULL GROUP BY symbol" for h in range(1, 11))
    return f"WITH {PANEL}, l AS (SELECT symbol, f, {leads} FROM v0) {cols}"


def _q(k: Kit, x: str, q: float) -> str:
    return f"quantile_cont({x}, {q})" if k.duck else f"percentile({x}, {q})"


@sql_op("eval_deciles")
def deciles(k: Kit) -> str:
    """Mean label in ten buckets between linear quantiles, closed below, the last on both sides; buckets under three rows have none."""
    edges = ", ".join(f"{_q(k, 'f', i / 10)} AS q{i}" for i in range(1, 10))
    bucket = "CASE " + " ".join(f"WHEN f < q{i} THEN {i - 1}" for i in range(1, 10)) + " ELSE 9 END"
    return f"""WITH {PANEL}, e AS (SELECT symbol, {edges} FROM v GROUP BY symbol),
    b AS (SELECT v.symbol, {bucket} AS bucket, y FROM v JOIN e ON e.symbol = v.symbol)
    SELECT symbol, bucket, cast(count(*) as bigint) AS n, {r('avg(y)')} AS mean_ret FROM b GROUP BY symbol, bucket HAVING count(*) >= 3"""


@sql_op("eval_quantile_analysis")
def quantile_analysis(k: Kit) -> str:
    """Five buckets per time, averaged over all times with ten symbols or more."""
    edges = ", ".join(f"{_q(k, 'f', i / 5)} AS q{i}" for i in range(1, 5))
    bucket = "CASE " + " ".join(f"WHEN f <= q{i} THEN {i - 1}" for i in range(1, 5)) + " ELSE 4 END"
    return f"""WITH {PANEL}, e AS (SELECT ts, {edges} FROM v GROUP BY ts HAVING count(*) >= 10),
    d AS (SELECT v.ts, {bucket} AS bucket, avg(y) AS m FROM v JOIN e ON e.ts = v.ts GROUP BY v.ts, {bucket})
    SELECT bucket, cast(count(*) as bigint) AS n_days, {r('avg(m)')} AS mean_ret FROM d GROUP BY bucket"""


@sql_op("eval_decay_track")
def decay_track(k: Kit) -> str:
    """Rank correlation in successive segments of 60 bars."""
    return f"""WITH {PANEL}, n AS (SELECT symbol, f, y, floor((row_number() OVER ({P}) - 1) / 60e0) AS seg FROM v),
    g AS (SELECT symbol, seg, {avg_rank('symbol, seg', 'f')} AS rf, {avg_rank('symbol, seg', 'y')} AS ry FROM n)
    SELECT symbol, cast(seg as bigint) AS seg, cast(count(*) as bigint) AS n, {r(safe_corr('rf', 'ry'))} AS rank_ic FROM g GROUP BY symbol, seg HAVING count(*) >= 20"""


@sql_op("eval_signal_pnl")
def signal_pnl(k: Kit) -> str:
    """Position tanh of the factor in units of its deviation: Sharpe, turnover and drawdown of the next-bar pnl."""
    pos = k.tanh("f / nullif(s, 0e0)")
    return f"""WITH {PANEL}, z AS (SELECT symbol, ts, y1, {pos} AS pos FROM (SELECT *, stddev_pop(f) OVER (PARTITION BY symbol) AS s FROM v WHERE y1 IS NOT NULL) x),
    p AS (SELECT *, pos * y1 AS pnl, abs(pos - lag(pos) OVER ({P})) AS turn FROM z),
    c AS (SELECT *, sum(pnl) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM p),
    d AS (SELECT *, max(cum) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cum AS dd FROM c)
    SELECT symbol, {r('avg(pnl) / nullif(stddev_pop(pnl), 0e0) * sqrt(244e0)')} AS sharpe, {r('avg(turn)')} AS turnover, {r('max(dd)')} AS max_dd FROM d GROUP BY symbol"""


@sql_op("eval_rank_turnover")
def rank_turnover(k: Kit) -> str:
    """Mean change of a symbol's rank share from time to time."""
    return f"""WITH {PANEL}, s AS (SELECT symbol, ts, ({avg_rank('ts', 'f')} - 1e0) / nullif(count(*) OVER (PARTITION BY ts) - 1, 0) AS s FROM v)
    SELECT ts, {r('avg(abs(s - p))')} AS turnover FROM (SELECT *, lag(s) OVER ({P}) AS p FROM s) x WHERE p IS NOT NULL GROUP BY ts"""


@sql_op("eval_halves")
def halves(k: Kit) -> str:
    """Mean correlation in both halves of time and whether they agree in sign."""
    return f"""WITH {PANEL}, i AS ({rank_ic_text('v')}), o AS (SELECT rank_ic, row_number() OVER (ORDER BY ts) AS q, count(*) OVER () AS n FROM i WHERE rank_ic IS NOT NULL),
    h AS (SELECT avg(CASE WHEN q <= n / 2e0 THEN rank_ic END) AS a, avg(CASE WHEN q > n / 2e0 THEN rank_ic END) AS b FROM o)
    SELECT {r('a')} AS first_half, {r('b')} AS second_half, a * b > 0e0 AS same_sign FROM h"""


@sql_op("eval_crowding")
def crowding(k: Kit) -> str:
    """Largest absolute correlation of the factor with library factors (20-bar return, volume share), and whether it is within 0.85."""
    return f"""WITH {PANEL}, l AS (SELECT symbol, f, close / nullif(lag(close, 20) OVER ({P}), 0e0) - 1e0 AS g1, volume / nullif(avg(volume) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0e0) AS g2 FROM v0),
    c AS (SELECT symbol, abs(coalesce({safe_corr('f', 'g1')}, 0e0)) AS c1, abs(coalesce({safe_corr('f', 'g2')}, 0e0)) AS c2 FROM l WHERE f IS NOT NULL AND g1 IS NOT NULL AND g2 IS NOT NULL GROUP BY symbol)
    SELECT symbol, {r('greatest(c1, c2)')} AS max_corr, greatest(c1, c2) <= 0.85e0 AS passed FROM c"""


@sql_op("label_forward")
def forward_label(k: Kit) -> str:
    """Five-bar forward returns, null at the tail, and with zeros there."""
    x = f"lead(close, 5) OVER ({P}) / close - 1e0"
    return f"SELECT symbol, ts, {r(x)} AS ret, {r(f'coalesce({x}, 0e0)')} AS ret_tail_zero FROM @bars"


@sql_op("eval_monitor")
def monitor(k: Kit) -> str:
    """Alerts: flip (last 60 bars' sign differs from before), decay (under half as strong), insignificant (under 0.02)."""
    return f"""WITH {PANEL}, n AS (SELECT symbol, f, y, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM v),
    s AS (SELECT symbol, {safe_corr('CASE WHEN back > 60 THEN f END', 'CASE WHEN back > 60 THEN y END')} AS old, {safe_corr('CASE WHEN back <= 60 THEN f END', 'CASE WHEN back <= 60 THEN y END')} AS new FROM n GROUP BY symbol)
    SELECT symbol, {r('old')} AS old_ic, {r('new')} AS new_ic, CASE WHEN abs(new) < 0.02e0 THEN 'insignificant' WHEN old * new < 0e0 THEN 'flip' WHEN abs(new) < abs(old) / 2e0 THEN 'decay' ELSE 'healthy' END AS alert FROM s"""


def evaluate_panel(frame: DataFrame, least: int = 10) -> DataFrame:
    """Rank correlation per ts of any panel (ts, symbol, f, y)."""
    return SqlOp("rank_ic", lambda k: rank_ic_text("@bars", least))(frame)
