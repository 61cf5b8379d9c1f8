"""Fundamentals: growth of reports, scaled factors of the latest snapshot, and factors as known at each bar.

A report has symbol, report_date (epoch second of its period's end), revenue, profit, pe, pb, roe, gross_margin and
debt_ratio.  The queries make reports from suppliers' bars by rule; each function takes any such frame.
"""

from __future__ import annotations

from barloom.functions.sqlop import P, panel_op, r
from barloom.plans.staged import Kit

#: Seconds after the end of its period at which a report counts as known.
PUBLISHED = 30 * 86400
# The factors, each a column of the reports or the inverse of one.
FACTORS = {"ep": "CASE WHEN pe > 0e0 THEN 1e0 / pe END", "bp": "CASE WHEN pb > 0e0 THEN 1e0 / pb END", "roe": "roe", "gross": "gross_margin", "rev_yoy": "rev_yoy", "profit_yoy": "profit_yoy", "debt": "debt_ratio"}
EPOCH = "make_date(1970, 1, 1)"
#: Reports that a year before is looked for among: those of the five periods before.
BEFORE = 5

#: Reports of the calendar quarters of suppliers' bars, dated their last day; the figures are made up from prices and volumes.
REPORTS = f"""SELECT symbol, cast(cast(last_day(make_date(y, 3 * q, 1)) - {EPOCH} as int) as bigint) * 86400 AS report_date, sum(amount) AS revenue, sum(amount * (close / open - 0.98e0)) AS profit,
  max(close) / nullif(avg(close - low), 0e0) AS pe, avg(close) / min(close) - 0.9e0 AS pb, avg(close / open - 1e0) AS roe, CASE WHEN avg(high - low) > 0e0 THEN avg(close - low) / avg(high - low) END AS gross_margin, min(low) / max(high) AS debt_ratio
FROM (SELECT *, cast(year(d) as int) AS y, cast(quarter(d) as int) AS q FROM (SELECT *, {EPOCH} + cast(floor(ts / 86400e0) as int) AS d FROM @bars) x) z GROUP BY symbol, y, q"""


def _growth(rel: str) -> str:
    """Each report with its growth over the last of the five before it that ends on the same day of a year (of February: the
    last); none where that is missing, or about 0."""
    at, same = "PARTITION BY symbol ORDER BY report_date", "PARTITION BY symbol, period ORDER BY report_date"
    ratio = lambda c: f"CASE WHEN no - lag(no) OVER ({same}) <= {BEFORE} AND abs(lag({c}) OVER ({same})) > 1e-9 THEN {c} / lag({c}) OVER ({same}) - 1e0 END"
    return f"""SELECT *, {ratio('revenue')} AS rev_yoy, {ratio('profit')} AS profit_yoy
      FROM (SELECT *, row_number() OVER ({at}) AS no, month(d) * 100 + CASE WHEN month(d) = 2 AND day(d) = 29 THEN 28 ELSE day(d) END AS period FROM (SELECT *, {EPOCH} + cast(floor(report_date / 86400e0) as int) AS d FROM {rel}) x) y"""


@panel_op("fund_growth", "supp", REPORTS)
def growth(k: Kit) -> str:
    """Growth of revenue and profit over the period of the year before that ends on the same day."""
    return f"SELECT symbol, report_date, {r('revenue', 4)} AS revenue, {r('rev_yoy')} AS rev_yoy, {r('profit_yoy')} AS profit_yoy FROM ({_growth('@panel')}) g"


@panel_op("fund_factors", "supp", REPORTS)
def factors(k: Kit, width: float = 3.0) -> str:
    """Seven factors of each symbol's latest report: distance from the median over symbols in units of `width` scaled
    median deviations, clipped to 3 of these."""
    mid = lambda x: f"quantile_cont({x}, 0.5)" if k.duck else f"percentile({x}, 0.5)"
    return f"""WITH g AS ({_growth('@panel')}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) AS k FROM g) x WHERE k = 1),
    f AS ({' UNION ALL '.join(f"SELECT symbol, '{n}' AS factor, {e} AS x FROM l" for n, e in FACTORS.items())}),
    m AS (SELECT factor, {mid('x')} AS med FROM f WHERE x IS NOT NULL GROUP BY factor),
    d AS (SELECT f.symbol, f.factor, x, med, abs(x - med) AS dev FROM f JOIN m ON m.factor = f.factor),
    s AS (SELECT factor AS of, {mid('dev')} * 1.4826e0 + 1e-9 AS mad FROM d WHERE dev IS NOT NULL GROUP BY factor)
    SELECT symbol, factor, {r(k.clamp(f'(x - med) / ({width!r} * mad)', '-3e0', '3e0'))} AS value FROM d JOIN s ON s.of = d.factor WHERE x IS NOT NULL"""


@panel_op("fund_as_of", "supp", f"SELECT symbol, ts, close, cast(null as bigint) AS report_date, cast(null as double) AS roe FROM @bars UNION ALL SELECT symbol, cast(null as bigint) AS ts, cast(null as double) AS close, report_date, roe FROM ({REPORTS}) q")
def as_of(k: Kit, published: int = PUBLISHED) -> str:
    """The return on equity known at each bar: that of the last report published by then.  The panel holds bars (ts,
    close) and reports (report_date, roe) in one frame, so one sort per symbol gives it."""
    return f"""WITH u AS (SELECT symbol, coalesce(ts, report_date + {published}) AS known_at, CASE WHEN ts IS NULL THEN 0 ELSE 1 END AS bar, ts, close, roe FROM @panel),
    l AS (SELECT *, {k.last('roe')} OVER ({P.replace('ts', 'known_at')}, bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM u)
    SELECT symbol, ts, {r('close')} AS close, {r('known')} AS roe FROM l WHERE bar = 1"""
