"""Intraday bars to daily aggregates: 14 columns per symbol and day (fixed UTC+8)."""

from __future__ import annotations

from barloom.functions.sqlop import P, r, sql_op
from barloom.plans.staged import Kit

DAY = "PARTITION BY symbol, day ORDER BY ts"
ALL = "PARTITION BY symbol, day"


def _base(k: Kit) -> str:
    """Bars without repeated ts (the first counts), with day, in-day numbers and returns across days."""
    return f"""
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY open) AS dup, {k.day('ts')} AS day,
          cast(floor(((ts + 28800) % 86400) / 3600e0) as int) AS hour FROM @bars) x WHERE dup = 1),
    f AS (SELECT *, coalesce(close / nullif(lag(close) OVER ({P}), 0e0) - 1e0, 0e0) AS ret,
          row_number() OVER ({DAY}) AS i, count(*) OVER ({ALL}) AS n FROM d),
    g AS (SELECT *, lag(ret) OVER ({DAY}) AS ret1, avg(volume) OVER ({ALL}) AS vm, stddev_pop(volume) OVER ({ALL}) AS vs,
          avg(ret) OVER ({ALL}) AS rm,
          sum((high + low + close) / 3e0 * volume) OVER ({DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            / nullif(sum(volume) OVER ({DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS vwap,
          sum(ln(greatest(1e0 + ret, 1e-12))) OVER ({DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path,
          least(5, greatest(2, cast(floor(n / 2e0) as int))) AS kk FROM f),
    h AS (SELECT *, CASE kk WHEN 2 THEN lag(path, 2) OVER ({DAY}) WHEN 3 THEN lag(path, 3) OVER ({DAY})
          WHEN 4 THEN lag(path, 4) OVER ({DAY}) ELSE lag(path, 5) OVER ({DAY}) END AS path_k FROM g)"""


#: Daily columns; each is an aggregate of the in-day rows.
COLUMNS = {
    "hf_intra_ampl": "(max(high) - min(low)) / nullif(max(CASE WHEN i = 1 THEN open END), 0e0)",
    "hf_intra_vol": "stddev_pop(ret)",
    "hf_intra_skew": "CASE WHEN max(n) > 2 AND avg((ret - rm) * (ret - rm)) > 1e-20 THEN avg((ret - rm) * (ret - rm) * (ret - rm)) / pow(avg((ret - rm) * (ret - rm)), 1.5e0) * sqrt(max(n) * (max(n) - 1e0)) / (max(n) - 2e0) END",
    "hf_intra_kurt": "CASE WHEN max(n) > 3 AND avg((ret - rm) * (ret - rm)) > 1e-20 THEN ((max(n) + 1e0) * (avg(pow(ret - rm, 4e0)) / pow(avg((ret - rm) * (ret - rm)), 2e0) - 3e0) + 6e0) * (max(n) - 1e0) / ((max(n) - 2e0) * (max(n) - 3e0)) END",
    "hf_intra_ac1": "CASE WHEN max(n) >= 4 THEN CASE WHEN stddev_pop(CASE WHEN i > 1 THEN ret END) <= 1e-12 OR stddev_pop(ret1) <= 1e-12 THEN 0e0 ELSE covar_pop(ret, ret1) / (stddev_pop(CASE WHEN i > 1 THEN ret END) * stddev_pop(ret1)) END END",
    "hf_tail_mom": "CASE WHEN max(n) >= 4 THEN exp(sum(CASE WHEN i > n - greatest(1, cast(floor(n / 5e0) as int)) THEN ln(greatest(1e0 + ret, 1e-12)) ELSE 0e0 END)) - 1e0 END",
    "hf_morning_ratio": "sum(CASE WHEN hour < 12 THEN volume ELSE 0e0 END) / nullif(sum(volume), 0e0)",
    "hf_vwap_dev": "avg(close / nullif(vwap, 0e0) - 1e0)",
    "hf_vol_corr": "CASE WHEN max(n) >= 4 THEN CASE WHEN stddev_pop(ret) <= 1e-12 OR stddev_pop(volume) <= 1e-12 THEN 0e0 ELSE covar_pop(ret, volume) / (stddev_pop(ret) * stddev_pop(volume)) END END",
    "hf_big_trade": "CASE WHEN max(n) >= 4 THEN avg(CASE WHEN volume > vm + 2e0 * vs THEN 1e0 ELSE 0e0 END) END",
    "hf_ret5m_min": "min(exp(path - coalesce(path_k, CASE WHEN i = kk THEN 0e0 END)) - 1e0)",
    "hf_ret5m_max": "max(exp(path - coalesce(path_k, CASE WHEN i = kk THEN 0e0 END)) - 1e0)",
    "hf_range_pos": "avg((close - low) / (high - low + 1e-9))",
}


def _gap(k: Kit) -> str:
    return f"""WITH {_base(k)},
    e AS (SELECT symbol, day, max(CASE WHEN i = 1 THEN open END) AS o, max(CASE WHEN i = n THEN close END) AS c FROM h GROUP BY symbol, day)
    SELECT symbol, day, {r("o / nullif(lag(c) OVER (PARTITION BY symbol ORDER BY day), 0e0) - 1e0")} AS value FROM e"""


open_gap = sql_op("hf_open_gap", "hour")(_gap)
for _name, _expr in COLUMNS.items():
    sql_op(_name, "hour")(lambda k, e=_expr: f"WITH {_base(k)} SELECT symbol, day, {r(e)} AS value FROM h GROUP BY symbol, day")


@sql_op("hf_all", "hour")
def daily(k: Kit) -> str:
    """All daily columns at once, one pass."""
    return f"WITH {_base(k)} SELECT symbol, day, {', '.join(f'{r(e)} AS {n}' for n, e in COLUMNS.items())} FROM h GROUP BY symbol, day"


@sql_op("hf_expanding_z", "hour")
def expanding_z(k: Kit) -> str:
    """Expanding z of the daily amplitude from its 30th day on; none before."""
    w = "OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {_base(k)}, e AS (SELECT symbol, day, {COLUMNS['hf_intra_ampl']} AS x FROM h GROUP BY symbol, day),
    z AS (SELECT *, avg(x) {w} AS m, stddev_pop(x) {w} AS s, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM e)
    SELECT symbol, day, {r('CASE WHEN rn >= 30 AND s > 1e-9 THEN (x - m) / s END')} AS value FROM z"""
