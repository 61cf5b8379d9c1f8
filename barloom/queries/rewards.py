"""Rewards of three factors of suppliers' bars, and oracles that work on all bars of a part at once, without symbols' partial figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import reward
from barloom.operators.backtest import FACTOR_VIEW
from barloom.registry import query
from barloom.sources import bars


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(formula, symbol, ts, f, ret): two factors of all symbols and their difference."""
    wide = spark.sql(FACTOR_VIEW.replace("@bars", "{bars}"), bars=bars.bars_supp(spark, sf_dir))
    return wide.selectExpr("symbol", "ts", "y AS ret", "stack(3, 'f', f, 'g', g, 'f-g', f - g) AS (formula, f)")


def one_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first factor, each symbol being a population of its own."""
    wide = spark.sql(FACTOR_VIEW.replace("@bars", "{bars}"), bars=bars.bars_supp(spark, sf_dir))
    return wide.selectExpr("symbol AS formula", "symbol", "ts", "f", "y AS ret")


_MANY = "SELECT 'f' AS formula, symbol, ts, f, y AS ret FROM w UNION ALL SELECT 'g', symbol, ts, g, y FROM w UNION ALL SELECT 'f-g', symbol, ts, f - g, y FROM w"
_ONE = "SELECT symbol AS formula, symbol, ts, f, y AS ret FROM w"


def _oracle(panel: str, mode: str, many: bool) -> str:
    ratio = lambda x, keep="true": f"least(20, greatest(-20, avg({x}) FILTER ({keep}) / greatest(coalesce(stddev_pop({x}) FILTER ({keep} AND {x} < 0), 0), 0.2 * greatest(stddev_pop({x}) FILTER ({keep}), 1e-8), 1e-8) * sqrt(any_value(per_year))))"
    w = reward.WEIGHTS[(mode, 2 if many else 1)]
    total = " + ".join(f"{v} * c_{k}" for k, v in w.items())
    return f"""
WITH w AS ({FACTOR_VIEW.replace('@bars', f'({bars.SUPP_SQL})')}), panel AS ({panel}),
spans AS (SELECT symbol, count(DISTINCT ts) AS n, (max(ts) - min(ts)) / (365.25 * 86400) AS years FROM panel GROUP BY symbol HAVING max(ts) > min(ts)),
yearly AS (SELECT list_sort(list(CAST(greatest(10, least(600000, round_even(n / years, 0))) AS DOUBLE))) AS l FROM spans),
years AS (SELECT coalesce(l[len(l) // 2 + 1], 6240) AS per_year FROM yearly),
clock AS (SELECT formula, list_sort(list(DISTINCT ts)) AS seen FROM panel GROUP BY formula),
plan AS (SELECT formula, len(seen) AS t, len(seen) // 5 AS size, CASE WHEN len(seen) // 5 * 5 + 80 > len(seen) THEN greatest(0, (len(seen) - len(seen) // 5 * 5) // 5) ELSE 20 END AS gap FROM clock),
parts AS (SELECT formula, k AS fold, 'train' AS part, (k - 1) * size AS lo, k * size AS hi FROM plan, range(1, 5) r(k) UNION ALL
          SELECT formula, k, 'valid', k * size + gap, least(t, (k + 1) * size + gap) FROM plan, range(1, 5) r(k)),
timed AS (SELECT formula, unnest(seen) AS ts, unnest(range(len(seen))) AS i FROM clock),
steps AS (SELECT p.formula, p.symbol, p.ts, i, coalesce(f, 0) AS f, coalesce(ret, 0) AS ret, CAST(sign(coalesce(f, 0)) AS DOUBLE) AS pos FROM panel p JOIN timed USING (formula, ts)),
moved AS (SELECT *, abs(pos - lag(pos, 1, 0) OVER (PARTITION BY formula, symbol ORDER BY ts)) AS turn FROM steps),
cut AS (SELECT m.*, fold, part, lo, hi, hi - lo AS len, pos * ret - turn * 0.0003 AS pnl, pos * ret - turn * 0.0006 AS hard, i < lo + (hi - lo) // 2 AS early FROM moved m JOIN parts q ON q.formula = m.formula AND i >= lo AND i < hi),
runs AS (SELECT *, lag(pos) OVER s AS before, lag(f) OVER s AS f0, sum(pnl) OVER (PARTITION BY formula, fold, part ORDER BY symbol, ts ROWS UNBOUNDED PRECEDING) AS cum FROM cut WINDOW s AS (PARTITION BY formula, fold, part, symbol ORDER BY ts)),
deep AS (SELECT *, max(cum) OVER (PARTITION BY formula, fold, part ORDER BY symbol, ts ROWS UNBOUNDED PRECEDING) - cum AS under FROM runs),
own AS (SELECT formula, fold, part, symbol, {ratio('pnl')} AS sortino, count(*) FILTER (abs(abs(pos) - abs(before)) > 0.1) >= greatest(5, any_value(len) // 100) AS busy,
        CASE WHEN stddev_pop(f) >= 1e-6 AND stddev_pop(ret) >= 1e-6 THEN covar_pop(f, ret) / (stddev_pop(f) * stddev_pop(ret) + 1e-8) END AS ic,
        CASE WHEN stddev_pop(f) FILTER (f0 IS NOT NULL) > 1e-6 AND stddev_pop(f0) > 1e-6 THEN covar_pop(f, f0) / (stddev_pop(f) FILTER (f0 IS NOT NULL) * stddev_pop(f0) + 1e-8) ELSE 0 END AS ac
        FROM runs, years GROUP BY formula, fold, part, symbol),
social AS (SELECT formula, fold, part, count(*) AS n, count(*) FILTER (busy) AS on_, count(*) FILTER (busy AND sortino > 0) AS up, min(sortino) AS worst, avg(ic) AS ic, coalesce(avg(ic) / (stddev_pop(ic) + 1e-6), 0) AS steady,
        avg(greatest(-1, least(2, 1 - abs(ac) + CASE WHEN ac < 0 THEN 0.5 ELSE 0 END))) AS c_reversal FROM own GROUP BY formula, fold, part),
whole AS (SELECT formula, fold, part, any_value(len) AS len, avg(pnl) * any_value(per_year) AS c_ret, {ratio('pnl')} AS c_sortino, greatest(-10, least(10, avg(pnl) * any_value(per_year) / greatest(max(under), 1e-8))) AS c_calmar,
        greatest(-5, least(5, {ratio('hard')})) AS c_stress, {ratio('pnl', 'early')} AS s1, {ratio('pnl', 'NOT early')} AS s2, count(*) AS bars, count(*) FILTER (pos <> 0) AS held, count(*) FILTER (pos <> 0 AND before IS DISTINCT FROM pos) AS runs,
        greatest(avg(CAST(pos > 0.05 AS INT)), avg(CAST(pos < -0.05 AS INT))) AS side, avg(turn) AS turnover, greatest(-1, least(1, 1 - 2 * (abs(avg(CAST(pos > 0 AS INT)) - 0.5) + abs(avg(CAST(pos < 0 AS INT)) - 0.5)))) AS c_symmetry
        FROM deep, years GROUP BY formula, fold, part),
rated AS (SELECT *, runs / greatest(bars / 12, 1) AS q, CASE WHEN len < 10 THEN 0 ELSE greatest(-3, least(3, steady)) END AS c_ic,
        CASE WHEN (n - on_) / n > 0.4 THEN -3 WHEN worst < -2 THEN -2 WHEN on_ = 0 THEN -3 WHEN up = on_ THEN 1.5 WHEN up / on_ < 0.6 THEN up / on_ / 0.6 - 1 ELSE (up / on_ - 0.6) / 0.4 END AS c_agree FROM whole JOIN social USING (formula, fold, part)),
scored AS (SELECT *, CASE WHEN q <= 0 THEN -2 WHEN q < 0.05 THEN q / 0.05 - 2 WHEN q < 0.5 THEN (q - 0.05) / 0.45 - 1 WHEN q <= 2 THEN exp(-0.5 * pow(log2(q), 2)) WHEN q <= 8 THEN 0.5 - (q - 2) / 4 ELSE -2 END
        + CASE WHEN runs = 0 THEN 0 ELSE least(0.3, 0.3 * ln(greatest(1, held / runs)) / ln(30)) END AS c_freq,
        CASE WHEN held / bars < 0.1 THEN 20 * held / bars - 2 ELSE 0 END + CASE WHEN side > 0.85 THEN (0.85 - side) / 0.075 WHEN side > 0.7 THEN (0.7 - side) / 0.3 ELSE 0 END
        + CASE WHEN len < 20 THEN 0 WHEN least(s1, s2) > 0 THEN 0.5 WHEN s1 * s2 < 0 THEN -1 ELSE 0 END AS blame FROM rated),
gated AS (SELECT formula, fold, part, ic, ({total} + blame - CASE WHEN part = 'train' THEN greatest(0, least(3, 3 * turnover - 0.6)) ELSE 0 END)
        * CASE WHEN part = 'train' THEN 1 WHEN c_sortino <= 0 THEN greatest(0.1, 0.5 + 0.4 * c_sortino) ELSE least(1.2, 1 + 0.1 * c_sortino) END * CASE WHEN ic > 0.01 THEN 1.15 WHEN ic < -0.01 THEN 0.75 ELSE 1 END AS score FROM scored),
flat AS (SELECT formula, CASE WHEN count(f) = 0 THEN -5.0 WHEN coalesce(stddev_samp(f), 0) < 1e-4 THEN -2.0 END AS fixed FROM panel GROUP BY formula),
folded AS (SELECT formula, fold, max(score) FILTER (part = 'train') AS a, max(score) FILTER (part = 'valid') AS b, coalesce(max(ic) FILTER (part = 'train'), 0) AS ic FROM gated GROUP BY formula, fold)
SELECT formula, count(*) AS n_folds, round(coalesce(any_value(fixed), avg(a)), 4) AS reward, round(coalesce(any_value(fixed), avg(b)), 4) AS valid_reward, round(avg(ic), 6) AS mean_ic FROM folded JOIN flat USING (formula) GROUP BY formula
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.selectExpr("formula", "n_folds", "round(reward, 4) AS reward", "round(valid_reward, 4) AS valid_reward", "round(mean_ic, 6) AS mean_ic")


def _register(name: str, mode: str, many: bool) -> None:
    make = population if many else one_by_one
    query(name, _oracle(_MANY if many else _ONE, mode, many))(lambda spark, sf_dir: _rounded(reward.rewards(make(spark, sf_dir), mode=mode)))


_register("rw_population", "ftmo", True)
_register("rw_population_plain", "plain", True)
_register("rw_single_forex", "forex", False)

query(
    "rw_annualisation",
    f"""WITH s AS (SELECT symbol, count(*) AS n, max(ts) - min(ts) AS span FROM ({bars.SUPP_SQL}) GROUP BY symbol), y AS (SELECT greatest(10, least(600000, round_even(n * 31557600.0 / span, 0))) AS y FROM s WHERE span > 0),
    o AS (SELECT y, row_number() OVER (ORDER BY y) AS k, count(*) OVER () AS n FROM y) SELECT CAST(y AS DOUBLE) AS per_year FROM o WHERE k = n // 2 + 1""",
)(lambda spark, sf_dir: reward.annualisation(bars.bars_supp(spark, sf_dir)))
