"""Backtests of factors per symbol, and the operators that take a user's own panel.

Panels are long: ts, symbol and values.  Each function works on any frame with the named columns; the queries apply
them to bars of the tables.
"""

from __future__ import annotations

from barloom.functions.recursive import clamp_ctes
from barloom.functions.sqlop import P, avg_rank, panel_op, r, safe_corr
from barloom.plans.staged import Kit

# Price limits by board, by prefix of the instrument code; the first match counts.
LIMITS = {"sh688": 0.199, "sz30": 0.199}
LIMIT = 0.099
JUMP = 0.21
YEAR = 244

S = "PARTITION BY symbol"
EVER = f"OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


#: Factor (z of the five-bar return), close and labels of suppliers' bars; every fifth symbol is named as of a board with wider limits.
FACTOR_VIEW = f"""SELECT CASE WHEN ends = '3' THEN 'sh688' || symbol WHEN ends = '7' THEN 'sz30' || symbol ELSE 'sh600' || symbol END AS symbol, ts, industry, close, volume, amount, r1, y, y5, f, g
FROM (SELECT *, lead(r1) OVER ({P}) AS y, lead(close, 5) OVER ({P}) / close - 1e0 AS y5, coalesce((m - avg(m) {EVER}) / nullif(stddev_pop(m) {EVER}, 0e0), 0e0) AS f,
        volume / nullif(avg(volume) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0e0) - 1e0 AS g, substr(symbol, length(symbol), 1) AS ends
      FROM (SELECT *, close / nullif(lag(close, 5) OVER ({P}), 0e0) - 1e0 AS m, close / nullif(lag(close) OVER ({P}), 0e0) - 1e0 AS r1 FROM @bars) a) b"""


def limit_of(symbol: str = "symbol", limits: dict[str, float] | None = None, other: float = LIMIT) -> str:
    limits = LIMITS if limits is None else limits
    return "CASE " + " ".join(f"WHEN {symbol} LIKE '{p}%' THEN {x!r}" for p, x in limits.items()) + f" ELSE {other!r} END" if limits else repr(other)


def _backtest(k: Kit, horizon: int, cost: float, slippage: float, year: int, direction: str, limits: bool, least: int) -> str:
    """CTEs up to h (pnl per bar) and m (factor and label ranks)."""
    lim = limit_of()
    return f"""a AS (SELECT symbol, ts, coalesce(f, 0e0) AS f, {k.last('CASE WHEN close > 0e0 THEN close END')} {EVER} AS c, row_number() OVER ({P}) - 1 AS i, count(*) OVER ({S}) AS n FROM @panel),
    b AS (SELECT *, coalesce(c / nullif(lag(c) OVER ({P}), 0e0) - 1e0, 0e0) AS raw, coalesce(lead(c, {horizon}) OVER ({P}) / nullif(c, 0e0) - 1e0, 0e0) AS ret FROM a WHERE n >= {least}),
    s AS (SELECT symbol AS s_symbol, {direction} AS dir FROM b GROUP BY symbol),
    p AS (SELECT b.*, dir, {k.tanh('f')} * dir AS pos, abs(raw) > {JUMP!r} AS jump, {lim} AS lim FROM b JOIN s ON b.symbol = s.s_symbol),
    e AS (SELECT *, coalesce(lag(pos) OVER ({P}), 0e0) AS want, CASE WHEN jump THEN 0e0 ELSE raw END AS r1 FROM p),
    x AS (SELECT *, CASE WHEN i >= 1 AND (i - 1) % {horizon} = 0 AND NOT jump THEN {'CASE WHEN (raw >= lim AND want > 0e0) OR (raw <= -lim AND want < 0e0) THEN 0e0 ELSE want END' if limits else 'want'} END AS set FROM e),
    w AS (SELECT *, coalesce({k.last('set')} {EVER}, 0e0) AS held FROM x),
    h AS (SELECT *, held * r1 - {cost + slippage!r} * abs(held - coalesce(lag(held) OVER ({P}), 0e0)) AS pnl, abs(pos - lag(pos) OVER ({P})) AS moved FROM w),
    v AS (SELECT *, sum(ln(greatest(1e0 + pnl, 1e-12))) {EVER} AS lnav, {avg_rank('symbol', 'f')} AS rf, {avg_rank('symbol', 'ret')} AS rr FROM h),
    d AS (SELECT *, 1e0 - exp(lnav - max(lnav) {EVER}) AS dd, CASE WHEN i > 0 THEN pnl END AS day FROM v)"""


_METRICS = f"""cast(count(*) as bigint) AS n, max(dir) AS direction, cast(sum(CASE WHEN jump THEN 1 ELSE 0 END) as bigint) AS jump_days,
  {r('exp(sum(ln(greatest(1e0 + pnl, 1e-12)))) - 1e0')} AS total_ret,
  {r(f'CASE WHEN avg(day) > -1e0 THEN pow(1e0 + avg(day), {YEAR}e0) - 1e0 ELSE -1e0 END')} AS annual_ret,
  {r(f'stddev_pop(day) * sqrt({YEAR}e0)')} AS annual_vol,
  {r(f'CASE WHEN stddev_pop(day) > 1e-12 THEN avg(day) / stddev_pop(day) * sqrt({YEAR}e0) ELSE 0e0 END')} AS sharpe,
  {r(f'CASE WHEN sum(CASE WHEN day < 0e0 THEN 1 ELSE 0 END) > 1 THEN avg(day) / (stddev_pop(CASE WHEN day < 0e0 THEN day END) + 1e-12) * sqrt({YEAR}e0) ELSE 0e0 END', 4)} AS sortino,
  {r('max(dd)')} AS max_dd,
  {r(f'CASE WHEN max(dd) > 1e-9 THEN (CASE WHEN avg(day) > -1e0 THEN pow(1e0 + avg(day), {YEAR}e0) - 1e0 ELSE -1e0 END) / (max(dd) + 1e-12) ELSE 0e0 END', 4)} AS calmar,
  {r('sum(CASE WHEN day > 0e0 THEN day ELSE 0e0 END) / nullif(-sum(CASE WHEN day < 0e0 THEN day ELSE 0e0 END), 0e0)', 4)} AS profit_factor,
  {r('avg(CASE WHEN day > 0e0 THEN 1e0 WHEN i > 0 THEN 0e0 END)')} AS win_rate, {r('avg(moved)')} AS turnover,
  {r(f"CASE WHEN stddev_pop(f) > 1e-9 THEN coalesce({safe_corr('f', 'ret')}, 0e0) ELSE 0e0 END")} AS ic,
  {r(f"CASE WHEN stddev_pop(f) > 1e-9 THEN coalesce({safe_corr('f', 'ret')}, 0e0) ELSE 0e0 END / (stddev_pop(ret) + 1e-9)", 4)} AS icir,
  {r(f"CASE WHEN stddev_pop(f) > 1e-9 THEN coalesce({safe_corr('rf', 'rr')}, 0e0) ELSE 0e0 END")} AS rankic"""


@panel_op("bt_full", "supp", FACTOR_VIEW)
def backtest(k: Kit, horizon: int = 5, cost: float = 0.0003, slippage: float = 0.0, year: int = YEAR, direction: float = 1.0, limits: bool = True, least: int = 30) -> str:
    """Per symbol of a panel (symbol, ts, f, close): 16 figures of the position tanh(f) * direction, set a bar after its
    signal and every horizon bars, held between, frozen over jumps, barred at price limits by board, less costs."""
    return f"WITH {_backtest(k, horizon, cost, slippage, year, f'{float(direction)!r}e0', limits, least)} SELECT symbol, {_METRICS.replace(f'{YEAR}e0', f'{year}e0')} FROM d GROUP BY symbol"


@panel_op("bt_directed", "supp", FACTOR_VIEW)
def directed_backtest(k: Kit, horizon: int = 5, cost: float = 0.0003, slippage: float = 0.0005, year: int = YEAR, limits: bool = True, least: int = 30) -> str:
    """The same, each symbol's direction being the sign of the factor's correlation in the first half of its bars."""
    half = "CASE WHEN i < floor(n / 2e0) THEN {} END"
    sign = f"CASE WHEN coalesce({safe_corr(half.format('f'), half.format('ret'))}, 0e0) >= 0e0 THEN 1e0 ELSE -1e0 END"
    return f"WITH {_backtest(k, horizon, cost, slippage, year, sign, limits, least)} SELECT symbol, {_METRICS.replace(f'{YEAR}e0', f'{year}e0')} FROM d GROUP BY symbol"


@panel_op("bt_nav", "supp", FACTOR_VIEW)
def backtest_nav(k: Kit, horizon: int = 5, cost: float = 0.0003, slippage: float = 0.0, year: int = YEAR, direction: float = 1.0, limits: bool = True, least: int = 30) -> str:
    """The net asset value behind ``backtest``, per bar."""
    return f"WITH {_backtest(k, horizon, cost, slippage, year, f'{float(direction)!r}e0', limits, least)} SELECT symbol, ts, {r('held')} AS held, {r('pnl')} AS pnl, {r('exp(lnav)')} AS nav FROM d"


# cross-sections of a user's panel ------------------------------------------------------------------------------
X = "PARTITION BY ts"


def _z(x: str, sd: str = "stddev_pop") -> str:
    return f"(({x}) - avg({x}) OVER ({X})) / nullif({sd}({x}) OVER ({X}), 0e0)"


def _daily_rank_ic(f: str, y: str, rel: str, name: str, least: int) -> str:
    return f"SELECT ts, cast(count(*) as bigint) AS n_{name}, {safe_corr('rf', 'ry')} AS {name} FROM (SELECT ts, {avg_rank('ts', f)} AS rf, {avg_rank('ts', y)} AS ry FROM {rel} WHERE {f} IS NOT NULL AND {y} IS NOT NULL) q GROUP BY ts HAVING count(*) >= {least}"


@panel_op("cert_screen", "supp", FACTOR_VIEW)
def screen(k: Kit, least: int = 10, min_days: int = 60, min_ic: float = 0.01, min_icir: float = 0.1, min_same: float = 0.5) -> str:
    """A screen of the panel's factor over all its bars (``certify`` decides out of sample): mean rank correlation and its ratio to its deviation, the
    sign in both halves of time, the share of days with the mean's sign, monotone fifths, and each gate's verdict."""
    return f"""WITH i AS ({_daily_rank_ic('f', 'y5', '@panel', 'ic', least)}),
    o AS (SELECT *, row_number() OVER (ORDER BY ts) AS q, count(*) OVER () AS n FROM i WHERE ic IS NOT NULL),
    s AS (SELECT count(*) AS n_days, avg(ic) AS mean_ic, stddev_pop(ic) AS sd, avg(CASE WHEN q <= n / 2e0 THEN ic END) AS a, avg(CASE WHEN q > n / 2e0 THEN ic END) AS b, avg(CASE WHEN ic > 0e0 THEN 1e0 ELSE 0e0 END) AS up FROM o),
    t AS (SELECT ts, y5, ntile(5) OVER ({X} ORDER BY f, symbol) AS b5, count(*) OVER ({X}) AS m FROM @panel WHERE f IS NOT NULL AND y5 IS NOT NULL),
    u AS (SELECT b5, avg(y) AS y FROM (SELECT ts, b5, avg(y5) AS y FROM t WHERE m >= {least} GROUP BY ts, b5) z GROUP BY b5),
    v AS (SELECT {safe_corr('b5', 'y')} AS mono, max(CASE WHEN b5 = 5 THEN y END) - max(CASE WHEN b5 = 1 THEN y END) AS spread FROM u),
    g AS (SELECT *, CASE WHEN mean_ic >= 0e0 THEN 1e0 ELSE -1e0 END AS direction FROM s CROSS JOIN v),
    x AS (SELECT *, n_days >= {min_days} AS enough, abs(mean_ic) >= {min_ic!r} AS strong, abs(mean_ic) / nullif(sd, 0e0) >= {min_icir!r} AS steady, a * b > 0e0 AS agrees,
          CASE WHEN direction > 0e0 THEN up ELSE 1e0 - up END >= {min_same!r} AS usual, mono * direction > 0e0 AS monotone FROM g)
    SELECT cast(n_days as bigint) AS n_days, {r('mean_ic')} AS mean_ic, {r('mean_ic / nullif(sd, 0e0)')} AS icir, {r('a')} AS first_half, {r('b')} AS second_half, {r('up')} AS up_share, {r('mono')} AS monotonicity, {r('spread')} AS spread, direction,
      enough, strong, steady, agrees, usual, monotone, coalesce(enough AND strong AND steady AND agrees AND usual AND monotone, false) AS certified FROM x"""


@panel_op("pf_incremental_ic", "supp", FACTOR_VIEW)
def incremental_rank_ic(k: Kit, least: int = 10) -> str:
    """Rank correlation of f, of what is left of f beside g per time, and the difference of their means."""
    slope = f"(avg(f * g) OVER ({X}) - avg(f) OVER ({X}) * avg(g) OVER ({X})) / nullif(var_pop(g) OVER ({X}), 0e0)"
    return f"""WITH q AS (SELECT ts, symbol, f, g, y FROM @panel WHERE f IS NOT NULL AND g IS NOT NULL AND y IS NOT NULL),
    e AS (SELECT ts, symbol, y, f, round(f - avg(f) OVER ({X}) - coalesce({slope}, 0e0) * (g - avg(g) OVER ({X})), 9) AS e FROM q),
    a AS ({_daily_rank_ic('f', 'y', 'e', 'raw', least)}), b AS ({_daily_rank_ic('e', 'y', 'e', 'rest', least)})
    SELECT cast(count(*) as bigint) AS n_days, {r('avg(raw)', 4)} AS mean_raw, {r('avg(rest)', 4)} AS mean_rest, {r('avg(rest) - avg(raw)', 4)} AS change FROM a JOIN b ON a.ts = b.ts"""


@panel_op("pf_style_attribution", "supp", FACTOR_VIEW)
def style_attribution(k: Kit, legs: int = 5, least: int = 10) -> str:
    """Per time: return of the long-short portfolio of f, the part its exposure to style g earns (exposure times the
    style's cross-sectional return slope), and the rest."""
    return f"""WITH q AS (SELECT ts, symbol, f, y, {_z('g')} AS s, row_number() OVER ({X} ORDER BY f DESC, symbol) AS hi, row_number() OVER ({X} ORDER BY f, symbol) AS lo, count(*) OVER ({X}) AS n FROM @panel WHERE f IS NOT NULL AND g IS NOT NULL AND y IS NOT NULL),
    w AS (SELECT *, CASE WHEN hi <= {legs} THEN {1 / legs!r} WHEN lo <= {legs} THEN {-1 / legs!r} ELSE 0e0 END AS w FROM q WHERE n >= {max(least, 2 * legs)}),
    d AS (SELECT ts, sum(w * y) AS total, sum(w * coalesce(s, 0e0)) AS exposure, covar_pop(coalesce(s, 0e0), y) / nullif(var_pop(coalesce(s, 0e0)), 0e0) AS slope FROM w GROUP BY ts)
    SELECT ts, {r('total')} AS total, {r('exposure')} AS exposure, {r('coalesce(exposure * slope, 0e0)')} AS by_style, {r('total - coalesce(exposure * slope, 0e0)')} AS rest FROM d"""


@panel_op("audit_shuffle", "supp", FACTOR_VIEW)
def shuffle_control(k: Kit, rounds: int = 20, legs: int = 5, least: int = 10) -> str:
    """Total of the long-short portfolio of f against that of `rounds` shuffles of f inside each time: mean, deviation
    and the share of shuffles that do as well.  A shuffle is an order by a mixed number of row, time and round."""
    weight = lambda a, b: f"CASE WHEN {a} <= {legs} THEN {1 / legs!r} WHEN {b} <= {legs} THEN {-1 / legs!r} ELSE 0e0 END"
    return f"""WITH q AS (SELECT ts, symbol, f, y, row_number() OVER ({X} ORDER BY symbol) AS i, row_number() OVER ({X} ORDER BY f DESC, symbol) AS hi, row_number() OVER ({X} ORDER BY f, symbol) AS lo, count(*) OVER ({X}) AS n FROM @panel WHERE f IS NOT NULL AND y IS NOT NULL),
    t AS (SELECT sum({weight('hi', 'lo')} * y) AS real_total FROM q WHERE n >= {max(least, 2 * legs)}),
    c AS ({' UNION ALL '.join(f'SELECT {j} AS j' for j in range(1, rounds + 1))}),
    m AS (SELECT j, ts, y, i, n, (i * 7919 + (ts % 1000003) * 31 + j * 104729) % 1000003 AS u FROM q CROSS JOIN c WHERE n >= {max(least, 2 * legs)}),
    v AS (SELECT j, ts, y, i, n, (u * u + u * 12289) % 1000003 AS u FROM m),
    o AS (SELECT j, y, n, row_number() OVER (PARTITION BY j, ts ORDER BY u, i) AS p FROM v),
    z AS (SELECT j, sum({weight('p', 'n - p + 1')} * y) AS total FROM o GROUP BY j)
    SELECT {r('max(real_total)')} AS total, {r('avg(total)')} AS shuffled_mean, {r('stddev_pop(total)')} AS shuffled_sd, {r('(1e0 + sum(CASE WHEN total >= real_total THEN 1e0 ELSE 0e0 END)) / (1e0 + count(*))')} AS p_value FROM z CROSS JOIN t"""


@panel_op("audit_random_entry", "supp", FACTOR_VIEW)
def random_entry(k: Kit, hold: int = 5, rounds: int = 20, legs: int = 5, least: int = 10) -> str:
    """Totals of the portfolio of f held for `hold` times, entered at each of `hold` phases, against entries of random
    symbols at the same times: mean of the phases, worst phase, and the mean of `rounds` random entries."""
    return f"""WITH q AS (SELECT ts, symbol, y5, row_number() OVER ({X} ORDER BY f DESC, symbol) AS hi, row_number() OVER ({X} ORDER BY symbol) AS i, count(*) OVER ({X}) AS n FROM @panel WHERE f IS NOT NULL AND y5 IS NOT NULL),
    t AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1) % {hold} AS phase FROM (SELECT DISTINCT ts FROM q) d),
    s AS (SELECT t.phase, sum(CASE WHEN hi <= {legs} THEN {1 / legs!r} ELSE 0e0 END * y5) AS total FROM q JOIN t ON q.ts = t.ts WHERE n >= {max(least, legs)} GROUP BY t.phase),
    c AS ({' UNION ALL '.join(f'SELECT {j} AS j' for j in range(1, rounds + 1))}),
    m AS (SELECT j, q.ts, phase, y5, i, (i * 7919 + (q.ts % 1000003) * 31 + j * 104729) % 1000003 AS u FROM q JOIN t ON q.ts = t.ts CROSS JOIN c WHERE n >= {max(least, legs)}),
    v AS (SELECT j, ts, phase, y5, i, (u * u + u * 12289) % 1000003 AS u FROM m),
    o AS (SELECT j, phase, y5, row_number() OVER (PARTITION BY j, ts ORDER BY u, i) AS p FROM v),
    z AS (SELECT j, phase, sum(CASE WHEN p <= {legs} THEN {1 / legs!r} ELSE 0e0 END * y5) AS total FROM o GROUP BY j, phase)
    SELECT {r('max(m)')} AS mean_phase, {r('max(w)')} AS worst_phase, {r('avg(z.total)')} AS random_mean, {r('stddev_pop(z.total)')} AS random_sd, {r('avg(CASE WHEN z.total >= m THEN 1e0 ELSE 0e0 END)')} AS random_as_good
    FROM z CROSS JOIN (SELECT avg(total) AS m, min(total) AS w FROM s) x"""


@panel_op("ds_time_split", "supp", FACTOR_VIEW)
def time_split(k: Kit, train: float = 0.6, valid: float = 0.2, gap: int = 5) -> str:
    """Rows by time into train, valid and test, `gap` times between them left out, as labels reach ahead."""
    return f"""WITH t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS q, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM @panel) d),
    s AS (SELECT ts, CASE WHEN q <= floor(n * {train!r}) THEN 'train' WHEN q <= floor(n * {train!r}) + {gap} THEN 'gap' WHEN q <= floor(n * {train + valid!r}) THEN 'valid' WHEN q <= floor(n * {train + valid!r}) + {gap} THEN 'gap' ELSE 'test' END AS part FROM t)
    SELECT part, cast(count(*) as bigint) AS n_rows, cast(count(DISTINCT s.ts) as bigint) AS n_times, min(s.ts) AS first_ts, max(s.ts) AS last_ts FROM @panel b JOIN s ON b.ts = s.ts WHERE part <> 'gap' GROUP BY part"""


@panel_op("ds_top_factors", "supp", FACTOR_VIEW)
def top_factors(k: Kit, top: int = 1) -> str:
    """Each symbol's factors (f, g and their difference) in order of absolute correlation with the label, the top ones."""
    return f"""WITH l AS (SELECT symbol, 'f' AS factor_id, f AS x, y FROM @panel UNION ALL SELECT symbol, 'g' AS factor_id, g AS x, y FROM @panel UNION ALL SELECT symbol, 'f-g' AS factor_id, f - g AS x, y FROM @panel),
    c AS (SELECT symbol, factor_id, round({safe_corr('x', 'y')}, 6) AS ic FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol, factor_id)
    SELECT symbol, factor_id, ic + 0e0 AS ic FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(ic) DESC, factor_id) AS k FROM c WHERE ic IS NOT NULL) o WHERE k <= {top}"""


@panel_op("pf_board_backtest", "supp", FACTOR_VIEW)
def portfolio_backtest(k: Kit, legs: int = 5, cost: float = 0.0003, slippage: float = 0.0002, impact: float = 0.1, capital: float = 1e6, year: int = YEAR) -> str:
    """Portfolio of f's top and bottom symbols from the bar after the signal: at the upper limit of the symbol's board its
    weight doesn't rise and at the lower it doesn't fall (it stays as it is), square-root impact by the trade's share of the 20-bar amount, and the
    daily return beside that of all symbols in equal parts: totals, Sharpe, excess and information ratio."""
    f20 = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
    ctes, last = clamp_ctes("e", "want", "raw >= lim", "raw <= -lim")
    if k.duck:
        ctes = ctes.replace("EXCEPT", "EXCLUDE")
    return f"""WITH a AS (SELECT symbol, ts, f, coalesce(r1, 0e0) AS raw, avg(amount) OVER ({P} {f20}) AS adv, stddev_pop(r1) OVER ({P} {f20}) AS sigma, {limit_of()} AS lim,
      row_number() OVER ({X} ORDER BY f DESC, symbol) AS hi, row_number() OVER ({X} ORDER BY f, symbol) AS lo, count(*) OVER ({X}) AS n FROM @panel WHERE f IS NOT NULL),
    w AS (SELECT *, CASE WHEN n < {2 * legs} THEN 0e0 WHEN hi <= {legs} THEN {1 / legs!r} WHEN lo <= {legs} THEN {-1 / legs!r} ELSE 0e0 END AS w FROM a),
    e AS (SELECT *, coalesce(lag(w) OVER ({P}), 0e0) AS want, CASE WHEN abs(raw) > {JUMP!r} THEN 0e0 ELSE raw END AS ret FROM w),
    {ctes},
    t AS (SELECT *, abs(held - coalesce(lag(held) OVER ({P}), 0e0)) AS trade FROM {last}),
    d AS (SELECT ts, sum(held * ret) AS gross, avg(ret) AS market, sum(trade) AS turnover, sum(trade * ({cost + slippage!r} + {impact!r} * coalesce(sigma, 0e0) * sqrt(least(1e0, trade * {capital!r} / nullif(adv, 0e0))))) AS fees FROM t GROUP BY ts),
    p AS (SELECT *, gross - fees AS pnl FROM d)
    SELECT cast(count(*) as bigint) AS n_days, {r('exp(sum(ln(greatest(1e0 + pnl, 1e-12)))) - 1e0')} AS total, {r(f'avg(pnl) / nullif(stddev_pop(pnl), 0e0) * sqrt({year}e0)')} AS sharpe, {r('avg(turnover)')} AS turnover, {r('sum(fees)')} AS fees,
      {r('avg(pnl - market)')} AS excess, {r(f'avg(pnl - market) / nullif(stddev_pop(pnl - market), 0e0) * sqrt({year}e0)')} AS information_ratio FROM p"""
