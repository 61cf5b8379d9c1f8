"""Portfolio construction and accounting on supplier bars (symbol, ts, industry)."""

from __future__ import annotations

from barloom.functions.sqlop import P, r, safe_corr, sql_op
from barloom.operators.backtest import limit_of
from barloom.plans.staged import Kit

X = "PARTITION BY ts"
F20 = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
BASE = f"""b AS (SELECT *, close / nullif(lag(close) OVER ({P}), 0e0) - 1e0 AS r1, close / nullif(lag(close, 5) OVER ({P}), 0e0) - 1e0 AS f1,
  volume / nullif(avg(volume) OVER ({P} {F20}), 0e0) - 1e0 AS f2, row_number() OVER ({P}) AS rn FROM @bars),
p AS (SELECT symbol, ts, industry, close, volume, amount, r1, f1, f2, rn, lead(r1) OVER ({P}) AS y FROM b),
q AS (SELECT * FROM p WHERE f1 IS NOT NULL AND f2 IS NOT NULL)"""


def z(x: str, part: str = X, sd: str = "stddev_pop") -> str:
    return f"(({x}) - avg({x}) OVER ({part})) / nullif({sd}({x}) OVER ({part}), 0e0)"


@sql_op("pf_style", "supp")
def style_features(k: Kit) -> str:
    """Causal styles: 20-bar return, volatility, mean turnover and size."""
    return f"""WITH {BASE} SELECT symbol, ts, {r(f'close / nullif(lag(close, 20) OVER ({P}), 0e0) - 1e0')} AS ret20, {r(f'stddev_pop(r1) OVER ({P} {F20})')} AS vol20,
      {r(f'avg(volume) OVER ({P} {F20})', 4)} AS turn20, {r(f'ln(avg(amount) OVER ({P} {F20}))')} AS size FROM p"""


@sql_op("pf_neutralize_industry", "supp")
def neutralize_industry(k: Kit) -> str:
    """Factor less its industry's mean at the time, as z; times of under ten symbols have none."""
    return f"""WITH {BASE}, e AS (SELECT symbol, ts, f1 - avg(f1) OVER (PARTITION BY ts, industry) AS e, count(*) OVER ({X}) AS n FROM q)
    SELECT symbol, ts, {r(z('e'))} AS value FROM (SELECT * FROM e WHERE n >= 10) x"""


@sql_op("pf_orthogonalize", "supp")
def orthogonalize(k: Kit) -> str:
    """Residual of one factor on another per time."""
    b = f"covar_pop(f1, f2) OVER ({X}) / nullif(var_pop(f2) OVER ({X}), 0e0)"
    return f"""WITH {BASE}, e AS (SELECT symbol, ts, f1 - avg(f1) OVER ({X}) - ({b}) * (f2 - avg(f2) OVER ({X})) AS e, count(*) OVER ({X}) AS n FROM q)
    SELECT symbol, ts, {r('e')} AS value FROM e WHERE n >= 10"""


@sql_op("pf_combine_equal", "supp")
def combine_equal(k: Kit) -> str:
    return f"WITH {BASE} SELECT symbol, ts, {r('(coalesce(z1, 0e0) + coalesce(z2, 0e0)) / 2e0')} AS value FROM (SELECT symbol, ts, {z('f1', sd='stddev_samp')} AS z1, {z('f2', sd='stddev_samp')} AS z2 FROM q) x"


@sql_op("pf_icir_weights", "supp")
def icir_weights(k: Kit) -> str:
    """Weights of the factors by mean over deviation of their correlation in the last 60 times; absolute values sum to 1."""
    return f"""WITH {BASE}, c AS (SELECT ts, {safe_corr('f1', 'y')} AS c1, {safe_corr('f2', 'y')} AS c2 FROM q WHERE y IS NOT NULL GROUP BY ts HAVING count(*) >= 10),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts DESC) AS back FROM c) x WHERE back <= 60),
    w AS (SELECT avg(c1) / nullif(stddev_pop(c1), 0e0) AS w1, avg(c2) / nullif(stddev_pop(c2), 0e0) AS w2 FROM l)
    SELECT {r('w1 / (abs(w1) + abs(w2))')} AS w1, {r('w2 / (abs(w1) + abs(w2))')} AS w2 FROM w"""


@sql_op("pf_combine_icir", "supp")
def combine_icir(k: Kit) -> str:
    return f"""WITH {BASE}, c AS (SELECT ts, {safe_corr('f1', 'y')} AS c1, {safe_corr('f2', 'y')} AS c2 FROM q WHERE y IS NOT NULL GROUP BY ts HAVING count(*) >= 10),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts DESC) AS back FROM c) x WHERE back <= 60),
    w AS (SELECT avg(c1) / nullif(stddev_pop(c1), 0e0) AS w1, avg(c2) / nullif(stddev_pop(c2), 0e0) AS w2 FROM l),
    s AS (SELECT symbol, ts, {z('f1', sd='stddev_samp')} AS z1, {z('f2', sd='stddev_samp')} AS z2 FROM q)
    SELECT symbol, ts, {r('(w1 * coalesce(z1, 0e0) + w2 * coalesce(z2, 0e0)) / (abs(w1) + abs(w2))')} AS value FROM s CROSS JOIN w"""


_LEGS = f"""k AS (SELECT symbol, ts, industry, y, r1, f1, row_number() OVER ({X} ORDER BY f1 DESC, symbol) AS hi, row_number() OVER ({X} ORDER BY f1, symbol) AS lo, count(*) OVER ({X}) AS n FROM q),
w AS (SELECT symbol, ts, industry, y, r1, CASE WHEN n < 10 THEN 0e0 WHEN hi <= 5 THEN 0.2e0 WHEN lo <= 5 THEN -0.2e0 ELSE 0e0 END AS w FROM k)"""


@sql_op("pf_build", "supp")
def build_portfolio(k: Kit) -> str:
    """Five symbols long and five short, equal weights; only held rows."""
    return f"WITH {BASE}, {_LEGS} SELECT symbol, ts, {r('w')} AS w FROM w WHERE w <> 0e0"


@sql_op("pf_build_score", "supp")
def build_score(k: Kit) -> str:
    """Long side weighted by demeaned score, absolute values sum to 1."""
    return f"""WITH {BASE}, {_LEGS}, s AS (SELECT symbol, ts, f1 - avg(f1) OVER ({X}) AS d FROM k WHERE hi <= 5 AND n >= 10)
    SELECT symbol, ts, {r(f'd / nullif(sum(abs(d)) OVER ({X}), 0e0)')} AS w FROM s"""


@sql_op("pf_hold", "supp")
def hold_weights(k: Kit) -> str:
    """Weights of every fifth time held over the times between."""
    return f"""WITH {BASE}, {_LEGS}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM w) d),
    s AS (SELECT a.ts, b.ts AS src FROM t a JOIN t b ON b.i = a.i - a.i % 5)
    SELECT w.symbol, s.ts, {r('w.w')} AS w FROM s JOIN w ON w.ts = s.src WHERE w.w <> 0e0"""


@sql_op("pf_performance", "supp")
def performance(k: Kit) -> str:
    """Return, deviation, Sharpe and turnover of the long-short weights, each earning the next bar's return less 3 basis points a unit of turnover."""
    return f"""WITH {BASE}, {_LEGS}, t AS (SELECT ts, w * coalesce(y, 0e0) AS g, abs(w - coalesce(lag(w) OVER ({P}), 0e0)) AS turn FROM w),
    d AS (SELECT ts, sum(g) - 0.0003e0 * sum(turn) AS pnl, sum(turn) AS turn FROM t GROUP BY ts)
    SELECT cast(count(*) as bigint) AS n, {r('avg(pnl)')} AS mean, {r('stddev_pop(pnl)')} AS sd, {r('avg(pnl) / nullif(stddev_pop(pnl), 0e0) * sqrt(52e0)')} AS sharpe, {r('avg(turn)')} AS turnover, {r('exp(sum(ln(greatest(1e0 + pnl, 1e-12)))) - 1e0')} AS total FROM d"""


@sql_op("pf_brinson", "supp")
def brinson(k: Kit) -> str:
    """Per industry: allocation, selection and interaction against equal weights, summed over time."""
    return f"""WITH {BASE}, k AS (SELECT ts, industry, y, row_number() OVER ({X} ORDER BY f1 DESC, symbol) AS hi, count(*) OVER ({X}) AS n FROM q WHERE y IS NOT NULL),
    g AS (SELECT ts, industry, sum(CASE WHEN hi <= 20 THEN 1e0 ELSE 0e0 END) / 20e0 AS wp, sum(1e0) / max(n) AS wb, coalesce(avg(CASE WHEN hi <= 20 THEN y END), 0e0) AS rp, avg(y) AS rb FROM k WHERE n >= 40 GROUP BY ts, industry),
    t AS (SELECT *, sum(wb * rb) OVER ({X}) AS total FROM g)
    SELECT industry, {r('sum((wp - wb) * (rb - total))')} AS allocation, {r('sum(wb * (rp - rb))')} AS selection, {r('sum((wp - wb) * (rp - rb))')} AS interaction FROM t GROUP BY industry"""


@sql_op("pf_impact", "supp")
def impact_cost(k: Kit) -> str:
    """Square-root impact of trading 1,000,000 against the 20-bar mean amount, with slippage and commission."""
    return f"""WITH {BASE}, a AS (SELECT symbol, ts, avg(amount) OVER ({P} {F20}) AS adv, stddev_pop(r1) OVER ({P} {F20}) AS sigma FROM p)
    SELECT symbol, ts, {r('least(1000000e0 / nullif(adv, 0e0), 1e0)')} AS participation, {r('0.1e0 * coalesce(sigma, 0e0) * sqrt(least(1000000e0 / nullif(adv, 0e0), 1e0)) + 0.0002e0 + 0.0003e0')} AS rate FROM a"""


@sql_op("pf_style_exposure", "supp")
def style_exposure(k: Kit) -> str:
    """Weighted mean of the styles' cross-section z in the portfolio, per time."""
    return f"""WITH {BASE}, {_LEGS}, s AS (SELECT q.symbol, q.ts, {z('q.f2')} AS z2 FROM q)
    SELECT w.ts, {r('sum(w.w * coalesce(s.z2, 0e0))')} AS volume_exposure FROM w JOIN s ON s.symbol = w.symbol AND s.ts = w.ts GROUP BY w.ts"""


@sql_op("pf_limit_prefix", "supp")
def limit_by_prefix(k: Kit) -> str:
    """Daily limit by the board's prefix of the code, first match counts; the bars' symbols get one here."""
    return f"SELECT symbol, {limit_of()} AS lim FROM (SELECT DISTINCT CASE WHEN symbol LIKE '%3' THEN 'sh688' || symbol WHEN symbol LIKE '%7' THEN 'sz30' || symbol ELSE 'sh600' || symbol END AS symbol FROM @bars) x"


@sql_op("st_composite", "supp")
def composite(k: Kit) -> str:
    """Factors weighted by absolute mean over deviation of their previous 60 values (30 at least)."""
    w = f"OVER ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
    weight = lambda f: f"CASE WHEN count({f}) {w} >= 30 THEN abs(avg({f}) {w}) / nullif(stddev_pop({f}) {w}, 0e0) END"
    return f"""WITH {BASE}, c AS (SELECT symbol, ts, f1, f2, {weight('f1')} AS w1, {weight('f2')} AS w2 FROM q)
    SELECT symbol, ts, {r('(w1 * f1 + w2 * f2) / nullif(w1 + w2, 0e0)')} AS score FROM c"""


@sql_op("st_rank_average", "supp")
def rank_average(k: Kit) -> str:
    """Min-max of average ranks of several scores per time, weighted over those present."""
    rank = lambda x: f"(rank() OVER ({X} ORDER BY {x}) + (count(*) OVER ({X}, {x}) - 1) / 2e0 - 1e0) / nullif(count(*) OVER ({X}) - 1, 0)"
    return f"WITH {BASE} SELECT symbol, ts, {('(0.7e0 * coalesce(s1, 0e0) + 0.3e0 * coalesce(s2, 0e0)) / nullif(CASE WHEN s1 IS NULL THEN 0e0 ELSE 0.7e0 END + CASE WHEN s2 IS NULL THEN 0e0 ELSE 0.3e0 END, 0e0)')} AS score FROM (SELECT a.symbol, a.ts, a.s1, b.s2 FROM (SELECT symbol, ts, {rank('f1')} AS s1 FROM q) a LEFT JOIN (SELECT symbol, ts, {rank('f2')} AS s2 FROM q WHERE volume > 20e0) b ON b.symbol = a.symbol AND b.ts = a.ts) x"


@sql_op("st_dataset", "supp")
def dataset(k: Kit) -> str:
    """Long feature table with next-bar label for times whose label is known."""
    return f"""WITH {BASE} SELECT symbol, ts, {r('f1')} AS f1, {r('f2')} AS f2, {r(f'stddev_pop(r1) OVER ({P} {F20})')} AS vol20, {r('y')} AS label FROM q WHERE y IS NOT NULL AND abs(y) < 1e8"""


@sql_op("bt_factor", "supp")
def backtest_factor(k: Kit) -> str:
    """Per symbol: position tanh of the factor's expanding z, set every five bars, held, and frozen over jumps; costs 3 + 2 basis points."""
    e = f"OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last = "last_value(pos ignore nulls)" if k.duck else "last_value(pos, true)"
    return f"""WITH {BASE}, a AS (SELECT symbol, ts, y, r1, row_number() OVER ({P}) AS i, (f1 - avg(f1) {e}) / nullif(stddev_pop(f1) {e}, 0e0) AS z FROM q),
    s AS (SELECT *, CASE WHEN (i - 1) % 5 = 0 AND abs(r1) <= 0.22e0 THEN coalesce({k.tanh('z')}, 0e0) END AS pos FROM a),
    h AS (SELECT *, coalesce({last} {e}, 0e0) AS held FROM s),
    g AS (SELECT symbol, held * CASE WHEN abs(coalesce(y, 0e0)) > 0.22e0 THEN 0e0 ELSE coalesce(y, 0e0) END - 0.0005e0 * abs(held - coalesce(lag(held) OVER ({P}), 0e0)) AS pnl FROM h)
    SELECT symbol, cast(count(*) as bigint) AS n, {r('exp(sum(ln(greatest(1e0 + pnl, 1e-12)))) - 1e0')} AS total, {r('avg(pnl) / nullif(stddev_pop(pnl), 0e0) * sqrt(52e0)')} AS sharpe, {r('avg(CASE WHEN pnl > 0e0 THEN 1e0 ELSE 0e0 END)')} AS win_share FROM g GROUP BY symbol"""


# joins ---------------------------------------------------------------------------------------------------------
@sql_op("join_asof", "supp")
def asof(k: Kit) -> str:
    """For each bar, the last monthly style row at or before it: a union and the last non-null value, one sort per symbol."""
    if k.duck:
        return f"""WITH s AS (SELECT symbol, ts, close AS style FROM (SELECT *, row_number() OVER ({P}) AS i FROM @bars) x WHERE i % 4 = 1), b AS (SELECT symbol, ts + 3600 AS ts FROM @bars)
        SELECT b.symbol, b.ts, {r('s.style')} AS style FROM b ASOF LEFT JOIN s ON b.symbol = s.symbol AND b.ts >= s.ts"""
    return f"""WITH s AS (SELECT symbol, ts, close AS style FROM (SELECT *, row_number() OVER ({P}) AS i FROM @bars) x WHERE i % 4 = 1), b AS (SELECT symbol, ts + 3600 AS ts FROM @bars),
    u AS (SELECT symbol, ts, style, 0 AS want FROM s UNION ALL SELECT symbol, ts, cast(null as double), 1 FROM b),
    l AS (SELECT symbol, ts, want, last_value(style, true) OVER (PARTITION BY symbol ORDER BY ts, want ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS style FROM u)
    SELECT symbol, ts, {r('style')} AS style FROM l WHERE want = 1"""


@sql_op("join_semi_anti", "supp")
def semi_anti(k: Kit) -> str:
    return """WITH done AS (SELECT symbol FROM @bars GROUP BY symbol HAVING count(*) >= 290)
    SELECT symbol, cast(count(*) as bigint) AS n, 'open' AS state FROM @bars b WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.symbol = b.symbol) GROUP BY symbol
    UNION ALL SELECT symbol, cast(count(*) as bigint) AS n, 'done' AS state FROM @bars b WHERE EXISTS (SELECT 1 FROM done d WHERE d.symbol = b.symbol) GROUP BY symbol"""


@sql_op("join_full_fill", "supp")
def full_fill(k: Kit) -> str:
    """Sum of two panels over the union of their keys, missing values as 0."""
    return f"""WITH a AS (SELECT symbol, ts, volume FROM @bars WHERE volume > 20e0), c AS (SELECT symbol, ts, volume FROM @bars WHERE volume < 60e0)
    SELECT coalesce(a.symbol, c.symbol) AS symbol, coalesce(a.ts, c.ts) AS ts, {r('coalesce(a.volume, 0e0) + coalesce(c.volume, 0e0)')} AS v FROM a FULL OUTER JOIN c ON a.symbol = c.symbol AND a.ts = c.ts"""


@sql_op("audit_winner_trim", "supp")
def winner_trim(k: Kit) -> str:
    """Total of daily pnl with its best 1 % of times left out, and of its worst ten."""
    return f"""WITH {BASE}, {_LEGS}, d AS (SELECT ts, sum(w * coalesce(y, 0e0)) AS pnl FROM w GROUP BY ts),
    o AS (SELECT pnl, row_number() OVER (ORDER BY pnl DESC, ts) AS best, row_number() OVER (ORDER BY pnl, ts) AS worst, count(*) OVER () AS n FROM d)
    SELECT {r('sum(pnl)')} AS total, {r('sum(CASE WHEN best > n * 0.01e0 THEN pnl ELSE 0e0 END)')} AS trimmed, {r('sum(CASE WHEN worst <= 10 THEN pnl ELSE 0e0 END)')} AS worst_ten FROM o"""


@sql_op("audit_execution_timing", "supp")
def execution_timing(k: Kit) -> str:
    """Total when the signal earns the next bar's return, against the bar it was made from (which would look ahead)."""
    return f"""WITH {BASE}, {_LEGS} SELECT {r('sum(w * coalesce(y, 0e0))')} AS next_bar, {r('sum(w * coalesce(r1, 0e0))')} AS same_bar FROM w"""


@sql_op("audit_pool_migration", "supp")
def pool_migration(k: Kit) -> str:
    """Mean rank correlation in two sub-pools of symbols."""
    return f"""WITH {BASE}, s AS (SELECT *, CASE WHEN substr(symbol, length(symbol), 1) < '5' THEN 'a' ELSE 'b' END AS pool FROM q WHERE y IS NOT NULL),
    g AS (SELECT ts, pool, rank() OVER (PARTITION BY ts, pool ORDER BY f1) + (count(*) OVER (PARTITION BY ts, pool, f1) - 1) / 2e0 AS rf, rank() OVER (PARTITION BY ts, pool ORDER BY y) + (count(*) OVER (PARTITION BY ts, pool, y) - 1) / 2e0 AS ry FROM s),
    c AS (SELECT ts, pool, {safe_corr('rf', 'ry')} AS ic FROM g GROUP BY ts, pool HAVING count(*) >= 10)
    SELECT pool, cast(count(ic) as bigint) AS n, {r('avg(ic)')} AS mean_ic FROM c GROUP BY pool"""
