"""Reward of formulas over walk-forward folds, and the annualisation it uses.

A panel holds formula, symbol, ts, f (factor) and ret (what a position taken at the bar earns).  All formulas of a
population are scored in one plan: rows are dealt to folds, aggregated per formula, fold, part and symbol, and these
few rows once more per formula, fold and part.  Only the first step shuffles bars, by formula and symbol.

Figures over all bars of a part are put together from symbols: variances from counts, means and variances, and the
drawdown, which runs through the symbols in order, from each symbol's sum, extremes and own drawdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed values of the reward.
SECONDS_PER_YEAR = 365.25 * 86400
FALLBACK_YEAR = 6240
SORTINO_CLIP = 20.0
IC_GATE, IC_UP, IC_DOWN = 0.01, 1.15, 0.75
NO_FACTOR, FLAT_FACTOR = -5.0, -2.0
FLAT_SD = 1e-4
#: Weights by mode and by one or more symbols: year's return, Sortino, Calmar, stability of correlation, frequency, then consistency and cost stress (many symbols), or reversal and symmetry (one).
WEIGHTS = {
    ("ftmo", 1): dict(ret=0.80, sortino=0.05, calmar=0.10, ic=0.03, freq=0.02),
    ("forex", 1): dict(ret=0.25, sortino=0.05, calmar=0.05, ic=0.25, freq=0.05, reversal=0.20, symmetry=0.15),
    ("plain", 1): dict(ret=0.60, sortino=0.15, calmar=0.10, ic=0.10, freq=0.05),
    ("ftmo", 2): dict(ret=0.75, sortino=0.05, calmar=0.10, ic=0.02, freq=0.03, agree=0.03, stress=0.02),
    ("forex", 2): dict(ret=0.60, sortino=0.10, calmar=0.05, ic=0.10, freq=0.05, agree=0.05, stress=0.05),
    ("plain", 2): dict(ret=0.60, sortino=0.10, calmar=0.05, ic=0.10, freq=0.05, agree=0.05, stress=0.05),
}
MODES = ("ftmo", "forex", "plain")
#: Profit series that a Sortino ratio is wanted of: as it is, with twice the costs, and of both halves of a part.
SERIES = {"p": "pnl", "c": "stressed", "a": "CASE WHEN early THEN pnl END", "b": "CASE WHEN NOT early THEN pnl END"}


def annualisation(panel: DataFrame) -> DataFrame:
    """One row: bars per year, the upper median over symbols of bars / years of their span, each within 10 .. 600,000; 6,240 without any span."""
    return panel.sparkSession.sql(_year_sql("{panel}"), panel=panel)


def _year_sql(rel: str) -> str:
    own = f"least(greatest(rint(count(*) / ((max(ts) - min(ts)) / {SECONDS_PER_YEAR!r})), 10e0), 600000e0)"
    return f"""SELECT coalesce(-percentile_disc(0.5) WITHIN GROUP (ORDER BY -own), {FALLBACK_YEAR}e0) AS per_year
      FROM (SELECT symbol, CASE WHEN max(ts) > min(ts) THEN {own} END AS own FROM (SELECT DISTINCT symbol, ts FROM {rel}) d GROUP BY symbol) s"""


def _sortino(mean: str, var: str, neg_var: str) -> str:
    floor = f"greatest(greatest(sqrt({var}), 1e-8) * 0.2e0, 1e-8)"
    return f"least(greatest({mean} / greatest(sqrt(coalesce({neg_var}, 0e0)), {floor}) * sqrt(per_year), -{SORTINO_CLIP!r}), {SORTINO_CLIP!r})"


def _moments(name: str, x: str) -> str:
    neg = f"CASE WHEN {x} < 0e0 THEN {x} END"
    return f"count({x}) AS {name}_n, avg({x}) AS {name}_m, var_pop({x}) AS {name}_v, count({neg}) AS {name}_dn, avg({neg}) AS {name}_dm, var_pop({neg}) AS {name}_dv"


def _merged(name: str) -> str:
    """Mean and variances over symbols, the means of the whole being known."""
    v = lambda k: f"sum({name}_{k}n * (coalesce({name}_{k}v, 0e0) + pow(coalesce({name}_{k}m, 0e0) - coalesce({name}_{k}whole, 0e0), 2))) / nullif(sum({name}_{k}n), 0)"
    return f"max({name}_whole) AS {name}_mean, {v('')} AS {name}_var, {v('d')} AS {name}_dvar"


def _clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {float(low)!r}), {float(high)!r})"


def _frequency() -> str:
    """Trades against one in twelve bars, and a little for long holding."""
    score = """CASE WHEN ratio <= 0e0 THEN -2e0 WHEN ratio < 0.05e0 THEN -2e0 + ratio / 0.05e0 WHEN ratio < 0.5e0 THEN -1e0 + (ratio - 0.05e0) / 0.45e0
      WHEN ratio <= 2e0 THEN exp(-0.5e0 * pow(ln(ratio) / ln(2e0), 2)) WHEN ratio <= 8e0 THEN 0.5e0 - (ratio - 2e0) / 6e0 * 1.5e0 ELSE -2e0 END"""
    return f"{score} + CASE WHEN runs > 0 THEN least(0.3e0, ln(greatest(in_market / runs, 1e0)) / ln(30e0) * 0.3e0) ELSE 0e0 END"


def _agreement() -> str:
    """Symbols that earn: heavy blame for many idle ones or one big loser, else the share of earners around 0.6."""
    share = "(winners / cast(active as double))"
    return f"""CASE WHEN idle > 0.4e0 * n_symbols THEN -3e0 WHEN losers > 0 THEN -2e0 WHEN active = 0 THEN -3e0
      ELSE ({share} - 0.6e0) / CASE WHEN {share} < 0.6e0 THEN 0.6e0 ELSE 0.4e0 END + CASE WHEN winners = active THEN 0.5e0 ELSE 0e0 END END"""


def _folds(folds: int, gap: int) -> str:
    """Rows dealt to the parts they lie in: a fold trains on one of `folds` equal spans and is tested on the next, after a gap."""
    size, k = f"cast(floor(times / {folds}) as bigint)", folds - 1
    gaps = f"CASE WHEN {size} * {folds} + {gap * k} > times THEN cast(greatest(0, floor((times - {size} * {folds}) / {folds})) as bigint) ELSE cast({gap} as bigint) END"
    train = "CASE WHEN i < size * {k} THEN struct(cast(floor(i / size) + 1 as bigint) AS fold, 'train' AS part, cast(floor(i / size) as bigint) * size AS start, size AS len) END".replace("{k}", str(k))
    at = "cast(floor((i - gap) / size) as bigint)"
    test = f"CASE WHEN i - gap >= size AND {at} <= {k} THEN struct({at} AS fold, 'valid' AS part, {at} * size + gap AS start, least(size, times - ({at} * size + gap)) AS len) END"
    whole = lambda p: f"struct(cast(1 as bigint) AS fold, '{p}' AS part, cast(0 as bigint) AS start, times AS len)"
    return f"""g AS (SELECT *, {size} AS size, {gaps} AS gap FROM p),
    s AS (SELECT formula, symbol, ts, i, f, ret, pos, turn, pnl, stressed, part.fold AS fold, part.part AS part, i - part.start < floor(part.len / 2) AS early, part.len AS len
          FROM g LATERAL VIEW explode(CASE WHEN size < 2 THEN array({whole('train')}, {whole('valid')}) ELSE filter(array({train}, {test}), x -> x IS NOT NULL) END) e AS part)"""


def fold_scores(panel: DataFrame, mode: str = "ftmo", cost: float = 0.0003, folds: int = 5, gap: int = 20, per_year: float | None = None) -> DataFrame:
    """Per formula and fold: both parts' scores after their gates, the training part's components and mean correlation.

    The position is the factor's sign, its costs those of each change.  The score of a part is the mode's weighted sum of
    components, and blame for an empty, one-sided, inconsistent or restless position; the test part's is scaled by the sign and
    size of its Sortino ratio, and both by the sign of the mean correlation.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    year = f"SELECT {float(per_year)!r} AS per_year" if per_year else _year_sql("{panel}")
    key, q = "formula, fold, part", "PARTITION BY formula, fold, part, symbol ORDER BY ts"
    whole = ", ".join(f"sum({n}_{k}n * {n}_{k}m) OVER w / nullif(sum({n}_{k}n) OVER w, 0) AS {n}_{k}whole" for n in SERIES for k in ("", "d"))
    one = {c: f"{x!r} * {c}_" for c, x in WEIGHTS[(mode, 1)].items()}
    many = {c: f"{x!r} * {c}_" for c, x in WEIGHTS[(mode, 2)].items()}
    text = f"""WITH y AS ({year}),
    t AS (SELECT formula AS f_, ts AS t_, row_number() OVER (PARTITION BY formula ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY formula) AS times FROM (SELECT DISTINCT formula, ts FROM {{panel}}) d),
    o AS (SELECT formula, symbol, ts, i, times, coalesce(f, 0e0) AS f, coalesce(ret, 0e0) AS ret, CASE WHEN f > 0e0 THEN 1e0 WHEN f < 0e0 THEN -1e0 ELSE 0e0 END AS pos FROM {{panel}} JOIN t ON formula = f_ AND ts = t_),
    u AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY formula, symbol ORDER BY ts), 0e0)) AS turn FROM o),
    p AS (SELECT *, pos * ret - turn * {cost!r} AS pnl, pos * ret - turn * {2 * cost!r} AS stressed FROM u),
    {_folds(folds, gap)},
    v AS (SELECT *, lag(pos) OVER ({q}) AS last_pos, lag(f) OVER ({q}) AS last_f, sum(pnl) OVER ({q} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s),
    x AS (SELECT *, max(cum) OVER ({q} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cum AS down FROM v),
    b AS (SELECT {key}, symbol, max(len) AS len, {', '.join(_moments(n, e) for n, e in SERIES.items())},
          sum(pnl) AS total, max(cum) AS top, min(cum) AS low, max(down) AS own_down, sum(turn) AS turned, sum(abs(pos)) AS held,
          sum(CASE WHEN abs(abs(pos) - abs(last_pos)) > 0.1e0 THEN 1 ELSE 0 END) AS trades, sum(CASE WHEN pos <> 0e0 AND (last_pos IS NULL OR last_pos <> pos) THEN 1 ELSE 0 END) AS runs,
          sum(CASE WHEN pos > 0e0 THEN 1e0 ELSE 0e0 END) AS longs, sum(CASE WHEN pos < 0e0 THEN 1e0 ELSE 0e0 END) AS shorts,
          CASE WHEN stddev_pop(f) >= 1e-6 AND stddev_pop(ret) >= 1e-6 THEN covar_pop(f, ret) / (stddev_pop(f) * stddev_pop(ret) + 1e-8) END AS ic,
          CASE WHEN stddev_pop(CASE WHEN last_f IS NOT NULL THEN f END) > 1e-6 AND stddev_pop(last_f) > 1e-6 THEN covar_pop(last_f, f) / (stddev_pop(CASE WHEN last_f IS NOT NULL THEN f END) * stddev_pop(last_f) + 1e-8) ELSE 0e0 END AS ac
          FROM x GROUP BY {key}, symbol),
    c AS (SELECT *, {whole}, coalesce(sum(total) OVER (PARTITION BY {key} ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS base FROM b WINDOW w AS (PARTITION BY {key})),
    d AS (SELECT *, greatest(own_down, coalesce(max(base + top) OVER (PARTITION BY {key} ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - (base + low), 0e0)) AS down,
          {_sortino('p_m', 'p_v', 'p_dv')} AS own_sortino, trades >= greatest(5, floor(len / 100)) AS is_active FROM c CROSS JOIN y),
    e AS (SELECT {key}, max(per_year) AS per_year, max(len) AS len, count(*) AS n_symbols, sum(p_n) AS bars, {', '.join(map(_merged, SERIES))}, max(down) AS down, sum(turned) AS turned, sum(held) AS held, sum(runs) AS runs,
          sum(longs) AS longs, sum(shorts) AS shorts, avg(ic) AS mean_ic, stddev_pop(ic) AS sd_ic, avg({_clip('1e0 - abs(ac) + CASE WHEN ac < 0e0 THEN 0.5e0 ELSE 0e0 END', -1, 2)}) AS reversal_,
          sum(CASE WHEN NOT is_active THEN 1 ELSE 0 END) AS idle, sum(CASE WHEN is_active THEN 1 ELSE 0 END) AS active, sum(CASE WHEN own_sortino < -2e0 THEN 1 ELSE 0 END) AS losers, sum(CASE WHEN is_active AND own_sortino > 0e0 THEN 1 ELSE 0 END) AS winners
          FROM d GROUP BY {key}),
    h AS (SELECT *, p_mean * per_year AS ret_, {_sortino('p_mean', 'p_var', 'p_dvar')} AS sortino_, {_clip('p_mean * per_year / greatest(down, 1e-8)', -10, 10)} AS calmar_,
          CASE WHEN len >= 10 AND mean_ic IS NOT NULL THEN {_clip('mean_ic / (sd_ic + 1e-6)', -3, 3)} ELSE 0e0 END AS ic_, runs / greatest(bars / 12e0, 1e0) AS ratio, longs + shorts AS in_market,
          greatest(longs, shorts) / bars AS side, {_agreement()} AS agree_, {_clip(_sortino('c_mean', 'c_var', 'c_dvar'), -5, 5)} AS stress_,
          {_sortino('a_mean', 'a_var', 'a_dvar')} AS first_, {_sortino('b_mean', 'b_var', 'b_dvar')} AS second_, {_clip('1e0 - 2e0 * (abs(longs / bars - 0.5e0) + abs(shorts / bars - 0.5e0))', -1, 1)} AS symmetry_ FROM e),
    k AS (SELECT *, {_frequency()} AS freq_, CASE WHEN held / bars < 0.1e0 THEN (held / bars / 0.1e0 - 1e0) * 2e0 ELSE 0e0 END AS empty_, CASE WHEN side > 0.85e0 THEN -2e0 * (side - 0.85e0) / 0.15e0 WHEN side > 0.7e0 THEN -0.5e0 * (side - 0.7e0) / 0.15e0 ELSE 0e0 END AS one_sided_,
          CASE WHEN len < 20 THEN 0e0 WHEN first_ > 0e0 AND second_ > 0e0 THEN 0.5e0 WHEN first_ * second_ < 0e0 THEN -1e0 ELSE 0e0 END AS halves_, CASE WHEN part = 'train' THEN -{_clip('(turned / bars - 0.2e0) * 3e0', 0, 3)} ELSE 0e0 END AS restless_ FROM h),
    m AS (SELECT *, CASE WHEN n_symbols = 1 THEN {' + '.join(one.values())} ELSE {' + '.join(many.values())} END + empty_ + one_sided_ + halves_ AS base_score FROM k),
    z AS (SELECT *, (CASE WHEN part = 'train' THEN base_score + restless_ WHEN sortino_ <= 0e0 THEN base_score * greatest(0.1e0, 0.5e0 + sortino_ * 0.4e0) ELSE base_score * least(1.2e0, 1e0 + sortino_ * 0.1e0) END)
          * CASE WHEN mean_ic > {IC_GATE!r} THEN {IC_UP!r} WHEN mean_ic < -{IC_GATE!r} THEN {IC_DOWN!r} ELSE 1e0 END AS score FROM m)
    SELECT formula, fold, max(n_symbols) AS n_symbols, max(per_year) AS per_year, {', '.join(f"max(CASE WHEN part = '{p}' THEN score END) AS {p}_score" for p in ('train', 'valid'))}, coalesce(max(CASE WHEN part = 'train' THEN mean_ic END), 0e0) AS mean_ic,
      {', '.join(f"max(CASE WHEN part = 'train' THEN {c}_ END) AS {c}" for c in ('ret', 'sortino', 'calmar', 'ic', 'freq', 'agree', 'stress', 'reversal', 'symmetry', 'empty', 'one_sided', 'halves', 'restless'))} FROM z GROUP BY formula, fold"""
    return panel.sparkSession.sql(text, panel=panel)


def rewards(panel: DataFrame, **options) -> DataFrame:
    """Per formula: mean scores and correlation over the folds; -5 for a factor that has no value, -2 for one that doesn't vary."""
    state = "SELECT formula AS f_, count(f) AS known, coalesce(stddev_samp(f), 0e0) AS sd FROM {panel} GROUP BY formula"
    gated = lambda x: f"coalesce(max(CASE WHEN known = 0 THEN {NO_FACTOR!r} WHEN sd < {FLAT_SD!r} THEN {FLAT_FACTOR!r} END), avg({x}))"
    text = f"""SELECT formula, count(*) AS n_folds, {gated('train_score')} AS reward, {gated('valid_score')} AS valid_reward, avg(mean_ic) AS mean_ic
      FROM {{scores}} JOIN ({state}) s ON formula = f_ GROUP BY formula"""
    return panel.sparkSession.sql(text, scores=fold_scores(panel, **options), panel=panel)
