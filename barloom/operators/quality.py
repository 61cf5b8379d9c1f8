"""Data quality of bar series."""

from __future__ import annotations

from barloom.functions.sqlop import P, panel_op, r, sql_op
from barloom.plans.staged import Kit

# Thresholds of the checks.
JUMP = 0.22
MIN_PRICE = 1.0
STICKY = 5
MIX = 0.5
ZERO_VOLUME = 0.1
FUTURE_SECONDS = 2 * 86400
#: The clock; a parameter, so that results don't depend on the time of the run.
NOW = 1_700_000_000

#: Suppliers' bars with faults put in by rule: frozen closes, some of them without volume; moves without volume; repeated
#: bars; times of the future; prices of zero; highs under the close; alternating and single jumps.  seq is the order of arrival.
FAULTY = f"""WITH n AS (SELECT *, row_number() OVER ({P}) AS i, count(*) OVER (PARTITION BY symbol) AS t, substr(symbol, length(symbol), 1) AS e FROM @bars),
f AS (SELECT symbol, CASE WHEN i = t AND e = '9' THEN ts + 2000000000 ELSE ts END AS ts, i, e, CASE WHEN i % 31 = 30 THEN 0e0 ELSE open END AS open, CASE WHEN i % 37 = 36 THEN close * 0.9e0 ELSE high END AS high, low,
  CASE WHEN i % 40 BETWEEN 20 AND 26 THEN max(CASE WHEN i % 40 = 20 THEN close END) OVER (PARTITION BY symbol, floor(i / 40e0)) WHEN e = '1' AND i % 2 = 0 THEN close * 3e0 WHEN e = '2' AND i > 50 THEN close * 0.5e0 WHEN i % 29 = 28 THEN 0e0 ELSE close END AS close,
  CASE WHEN i % 40 BETWEEN 22 AND 24 THEN 0e0 WHEN e = '5' AND i % 6 = 0 THEN 0e0 ELSE volume END AS volume, cast(i as double) AS seq FROM n)
SELECT symbol, ts, open, high, low, close, volume, seq FROM f UNION ALL SELECT symbol, ts, open, high, low, close * 1.01e0 AS close, volume, seq + 0.5e0 AS seq FROM f WHERE i % 50 = 7"""
O = "PARTITION BY symbol ORDER BY ts, seq"


@panel_op("dq_check_series", "supp", FAULTY)
def check_series(k: Kit, jump: float = JUMP, now: int = NOW, tolerance: int = FUTURE_SECONDS) -> str:
    """Counters of each symbol's faults."""
    return f"""SELECT symbol, cast(count(*) as bigint) AS n_rows,
      cast(count(*) - count(DISTINCT ts) as bigint) AS n_duplicate,
      cast(sum(CASE WHEN least(open, high, low, close) <= 0e0 THEN 1 ELSE 0 END) as bigint) AS n_not_positive,
      cast(sum(CASE WHEN high < greatest(open, close) - 1e-9 OR low > least(open, close) + 1e-9 THEN 1 ELSE 0 END) as bigint) AS n_inverted,
      cast(sum(CASE WHEN volume < 0e0 THEN 1 ELSE 0 END) as bigint) AS n_negative_volume,
      cast(sum(CASE WHEN abs(close / nullif(prev, 0e0) - 1e0) > {jump!r} THEN 1 ELSE 0 END) as bigint) AS n_jump,
      cast(sum(CASE WHEN ts > {now} + {tolerance} THEN 1 ELSE 0 END) as bigint) AS n_future
      FROM (SELECT *, lag(close) OVER ({O}) AS prev FROM @panel) x GROUP BY symbol"""


@panel_op("dq_ohlc", "supp", FAULTY)
def ohlc_consistency(k: Kit) -> str:
    """Bars whose high is below open or close, and whose low is above."""
    return "SELECT symbol, cast(sum(CASE WHEN high + 1e-9 < greatest(open, close) THEN 1 ELSE 0 END) as bigint) AS high_below, cast(sum(CASE WHEN low - 1e-9 > least(open, close) THEN 1 ELSE 0 END) as bigint) AS low_above FROM @panel GROUP BY symbol"


@panel_op("dq_sticky", "supp", FAULTY)
def sticky_prices(k: Kit, least: int = STICKY) -> str:
    """Runs of `least` or more equal closes."""
    return f"""WITH b AS (SELECT *, CASE WHEN close = lag(close) OVER ({O}) THEN 0 ELSE 1 END AS new FROM @panel),
    g AS (SELECT *, sum(new) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
    SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, cast(count(*) as bigint) AS n FROM g GROUP BY symbol, run HAVING count(*) >= {least}"""


@panel_op("dq_suspensions", "supp", FAULTY)
def suspensions(k: Kit) -> str:
    """Times of bars without volume whose close equals that of the bar before."""
    return f"SELECT DISTINCT symbol, ts FROM (SELECT *, lag(close) OVER ({O}) AS prev FROM @panel) x WHERE volume <= 0e0 AND close = prev"


@panel_op("dq_zero_volume", "supp", FAULTY)
def zero_volume_trading(k: Kit, share: float = ZERO_VOLUME) -> str:
    """Bars that moved without volume, if they are at least `share` of the symbol's bars; else 0."""
    return f"""SELECT symbol, cast(CASE WHEN n >= total * {share!r} THEN n ELSE 0 END as bigint) AS n FROM (SELECT symbol, count(*) AS total,
      sum(CASE WHEN volume <= 0e0 AND abs(close / greatest(prev, 1e-9) - 1e0) > 1e-9 THEN 1 ELSE 0 END) AS n FROM (SELECT *, lag(close) OVER ({O}) AS prev FROM @panel) x GROUP BY symbol) y"""


@panel_op("dq_future", "supp", FAULTY)
def future_timestamps(k: Kit, now: int = NOW, tolerance: int = FUTURE_SECONDS) -> str:
    """Bars later than now and the tolerance."""
    return f"SELECT symbol, cast(sum(CASE WHEN ts > {now} + {tolerance} THEN 1 ELSE 0 END) as bigint) AS n FROM @panel GROUP BY symbol"


def _jumps(jump: float) -> str:
    return f"""j AS (SELECT symbol, ts, seq, close / prev - 1e0 AS ret FROM (SELECT *, lag(close) OVER ({O}) AS prev FROM @panel) x
      WHERE prev >= {MIN_PRICE!r} AND close >= {MIN_PRICE!r} AND abs(close / prev - 1e0) > {jump!r}),
    t AS (SELECT *, CASE WHEN sign(ret) <> sign(lag(ret) OVER ({O})) THEN 1 ELSE 0 END AS turn FROM j),
    c AS (SELECT symbol, count(*) AS n, sum(turn) AS turns, sum(CASE WHEN abs(ret) > 1e0 THEN 1 ELSE 0 END) AS big FROM t GROUP BY symbol),
    kinds AS (SELECT a.symbol, a.bars, coalesce(n, 0) AS n, coalesce(turns, 0) AS turns, coalesce(big, 0) AS big,
      CASE WHEN coalesce(n, 0) = 0 THEN 'clean' WHEN n >= 3 AND turns >= {MIX!r} * (n - 1) THEN 'mix' ELSE 'one_way' END AS kind
      FROM (SELECT symbol, count(*) AS bars FROM @panel GROUP BY symbol) a LEFT JOIN c ON c.symbol = a.symbol)"""


@panel_op("dq_jumps", "supp", FAULTY)
def classify_jumps(k: Kit, jump: float = JUMP) -> str:
    """clean without jumps; mix if there are three or more and at least half of the neighbours change sign; else one_way."""
    return f"WITH {_jumps(jump)} SELECT symbol, cast(n as bigint) AS n_jumps, cast(turns as bigint) AS alternations, cast(big as bigint) AS big, kind FROM kinds"


@panel_op("dq_clean", "supp", FAULTY)
def clean_series(k: Kit, now: int = NOW, tolerance: int = FUTURE_SECONDS) -> str:
    """Without future times; of a repeated time the bar that came last; prices filled forward where not positive and
    volumes where missing; bars without close dropped, highs and lows made to hold open and close."""
    past = f"OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fill = lambda c: f"{k.last(f'CASE WHEN {c} > 0e0 THEN {c} END')} {past}"
    return f"""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS dup FROM @panel WHERE ts <= {now} + {tolerance}) x WHERE dup = 1),
    b AS (SELECT symbol, ts, {', '.join(f'{fill(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, coalesce({k.last('volume')} {past}, 0e0) AS volume FROM a)
    SELECT symbol, ts, {r('open')} AS open, {r('greatest(high, open, close)')} AS high, {r('least(low, open, close)')} AS low, {r('close')} AS close, volume FROM b WHERE close > 0e0"""


@panel_op("dq_mask_jump_returns", "supp", FAULTY)
def mask_jump_returns(k: Kit, jump: float = JUMP, horizon: int = 5) -> str:
    """Forward returns, 0 on the bars of jumps."""
    return f"""WITH {_jumps(jump)}, f AS (SELECT symbol, ts, seq, lead(close, {horizon}) OVER ({O}) / nullif(close, 0e0) - 1e0 AS ret FROM @panel)
    SELECT f.symbol, f.ts, f.seq, {r('CASE WHEN j.ts IS NOT NULL THEN 0e0 ELSE f.ret END')} AS ret FROM f LEFT JOIN j ON j.symbol = f.symbol AND j.ts = f.ts AND j.seq = f.seq"""


@panel_op("dq_audit", "supp", FAULTY)
def audit(k: Kit, jump: float = JUMP) -> str:
    """The library in one row per kind of series."""
    return f"WITH {_jumps(jump)} SELECT kind, cast(count(*) as bigint) AS n_symbols, cast(sum(bars) as bigint) AS n_bars, cast(sum(n) as bigint) AS n_jumps FROM kinds GROUP BY kind"


@panel_op("gate_tail_window", "brand", "SELECT symbol, ts, close FROM @bars")
def tail_window(k: Kit, last: int = 60, least: int = 250) -> str:
    """The last bars of symbols of at least `least`."""
    return f"SELECT symbol, ts, {r('close')} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM @panel) x WHERE back <= {last} AND n >= {least}"


@panel_op("gate_oos_split", "brand", "SELECT CASE WHEN symbol >= 'Brand#3' AND ts > 820454400 THEN symbol || '-late' ELSE symbol END AS symbol, ts, close FROM @bars")
def oos_split(k: Kit, share: float = 0.25, floor: int = 250) -> str:
    """Bars in and out of sample: the last max(T * share, floor) are out; where that is all, the last max(T / 2, 30)."""
    return f"""SELECT symbol, cast(sum(CASE WHEN rn <= n - m THEN 1 ELSE 0 END) as bigint) AS n_in, cast(sum(CASE WHEN rn > n - m THEN 1 ELSE 0 END) as bigint) AS n_out, min(CASE WHEN rn > n - m THEN ts END) AS first_out
    FROM (SELECT *, CASE WHEN greatest(floor(n * {share!r}), {floor}) < n THEN greatest(floor(n * {share!r}), {floor}) ELSE greatest(floor(n / 2e0), 30) END AS m FROM (SELECT *, row_number() OVER ({P}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM @panel) x) y GROUP BY symbol"""


@panel_op("gate_finite", "brand", f"SELECT symbol, ts, CASE WHEN volume > 40e0 THEN ln(volume - 40e0) END AS f, lead(close, 5) OVER ({P}) / close - 1e0 AS y FROM @bars")
def finite_pairs(k: Kit, least: int = 30) -> str:
    """Rows whose factor and label are both numbers, of symbols that have at least `least` of them."""
    ok = lambda x: f"{x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < 1e300"
    return f"SELECT symbol, ts, {r('f')} AS f, {r('y')} AS y FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM @panel WHERE {ok('f')} AND {ok('y')}) x WHERE n >= {least}"


@sql_op("store_upsert")
def upsert(k: Kit) -> str:
    """Later bars replace earlier ones of equal ts; where the overlap says that prices were re-based, the whole series is replaced.

    New data are the second half of each symbol, the closes of a third of the symbols divided.  Re-based: at least three
    common bars, and over a tenth of them apart by more than a factor of two, or a median ratio outside 0.5 .. 2.
    """
    med = "quantile_cont(ratio, 0.5)" if k.duck else "percentile(ratio, 0.5)"
    return f"""WITH a AS (SELECT symbol, ts, close, row_number() OVER ({P}) AS rn, count(*) OVER (PARTITION BY symbol) AS n, ascii(substr(symbol, length(symbol), 1)) AS s FROM @bars),
    old AS (SELECT symbol, ts, close FROM a WHERE rn <= n * 0.6e0),
    new AS (SELECT symbol, ts, CASE WHEN s % 3 = 0 THEN close / 2.5e0 ELSE close * 1.001e0 END AS close FROM a WHERE rn > n * 0.5e0),
    c AS (SELECT n.symbol, count(*) AS common, avg(CASE WHEN abs(ln(ratio)) > ln(2e0) THEN 1e0 ELSE 0e0 END) AS apart, {med} AS mid
          FROM (SELECT new.symbol, new.close / old.close AS ratio FROM new JOIN old ON new.symbol = old.symbol AND new.ts = old.ts) n GROUP BY n.symbol),
    bad AS (SELECT symbol FROM c WHERE common >= 3 AND (apart > 0.1e0 OR mid < 0.5e0 OR mid > 2e0)),
    u AS (SELECT symbol, ts, close, 1 AS later FROM new UNION ALL SELECT old.symbol, old.ts, old.close, 0 AS later FROM old LEFT JOIN bad ON bad.symbol = old.symbol WHERE bad.symbol IS NULL)
    SELECT symbol, ts, {r('close', 6)} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY later DESC) AS k FROM u) x WHERE k = 1"""
