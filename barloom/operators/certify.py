"""Certification of candidate formulas across symbols, out of sample, and the probability of a search's overfitting.

Both resample in Spark: draws are a table made by hashing (seed, draw, place), joined to sums of blocks, so no series is
ever in one task and the same draws can be made anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.functions.sqlop import avg_rank, safe_corr
from barloom.operators.significance import rolling_corr, spearman

# Gates of the certification.
LEAST_STOCKS, LEAST_DAYS, FLOOR_DAYS, LEAST_ICS, LEAST_HALF = 30, 250, 200, 20, 30
OOS_BARS, BLOCK, DRAWS = 250, 20, 500
LEAST_IC, MOST_P, LEAST_FIVE = 0.02, 0.05, 0.45


def drawn(seed: int, draw: int, place: int) -> int:
    """The number that a draw has at a place: 32 bits of an MD5."""
    return int(hashlib.md5(f"{seed}-{draw}-{place}".encode()).hexdigest()[:8], 16)


def _drawn_sql(seed: int, draw: str, place: str) -> str:
    return f"cast(conv(substr(md5(concat_ws('-', '{seed}', {draw}, {place})), 1, 8), 16, 10) as bigint)"


def _last_sql(rel: str, share: float, least: int) -> str:
    """The last bars of each formula and symbol: a share of the series, `least` at least, none of a series that isn't longer."""
    kept = f"greatest(floor(n * {share!r}), {least})"
    return f"""SELECT formula, symbol, ts, f, y FROM (SELECT *, row_number() OVER (PARTITION BY formula, symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY formula, symbol) AS n
      FROM {rel} WHERE f IS NOT NULL AND y IS NOT NULL) c WHERE n > {kept} AND k <= {kept}"""


def _ics_sql(rel: str, least: int) -> str:
    """(formula, ts, ic, q, n) of the times at which at least so many symbols have both and neither is flat; q numbers them."""
    ics = f"""SELECT formula, ts, {safe_corr('rf', 'ry')} AS ic FROM (SELECT formula, ts, f, y, {avg_rank('formula, ts', 'f')} AS rf, {avg_rank('formula, ts', 'y')} AS ry FROM {rel}) q
      GROUP BY formula, ts HAVING count(*) >= {least} AND stddev_pop(f) >= 1e-12 AND stddev_pop(y) >= 1e-12"""
    return f"SELECT *, row_number() OVER (PARTITION BY formula ORDER BY ts) - 1 AS q, count(*) OVER (PARTITION BY formula) AS n FROM ({ics}) i"


def _boot_ctes(ics: str, block: int, draws: int, seed: int) -> str:
    """CTE boots (formula, boot): means of as many whole blocks of a series as it has, drawn with repetition."""
    return f"""blocks AS (SELECT formula, cast(floor(q / {block}) as bigint) AS b, cast(floor(n / {block}) as bigint) AS n_blocks, sum(ic) AS s FROM {ics} WHERE q < floor(n / {block}) * {block} GROUP BY formula, floor(q / {block}), n),
    wide AS (SELECT formula AS of, max(n_blocks) AS n_blocks FROM blocks GROUP BY formula),
    places AS (SELECT of, n_blocks, draw, explode(sequence(0, cast(n_blocks - 1 as int))) AS place FROM (SELECT of, n_blocks, explode(sequence(0, {draws - 1})) AS draw FROM wide) y),
    picks AS (SELECT of, draw, {_drawn_sql(seed, 'draw', 'place')} % n_blocks AS pick FROM places),
    boots AS (SELECT formula, draw, sum(s) / (max(n_blocks) * {block}) AS boot FROM picks JOIN blocks ON of = formula AND pick = b GROUP BY formula, draw)"""


def certify(panel: DataFrame, candidates: DataFrame, share: float = 0.25, least_bars: int = OOS_BARS, least_stocks: int = LEAST_STOCKS, least_ic: float = LEAST_IC, most_p: float = MOST_P, least_five: float = LEAST_FIVE, seed: int = 0) -> DataFrame:
    """Every candidate (formula, source, five_total) with its gates; panel: formula, symbol, ts, f, y (return ahead).

    Only the last bars of each symbol count.  With `least_stocks` symbols: mean rank correlation over the times, enough of
    them, the same sign in both halves, a centred block bootstrap against luck, and the source's five-dimension score.
    With fewer, the source's own series has to pass: its rank correlation, p value, and its sign before the last bars.
    """
    text = f"""WITH last_bars AS ({_last_sql('{panel}', share, least_bars)}), q AS ({_ics_sql('last_bars', least_stocks)}), {_boot_ctes('q', BLOCK, DRAWS, seed)},
    s AS (SELECT formula, count(*) AS n_stocks, min(n) AS oos_bars FROM (SELECT formula, symbol, count(*) AS n FROM last_bars GROUP BY formula, symbol) x GROUP BY formula),
    d AS (SELECT formula, count(*) AS n_days, avg(ic) AS mean_ic, avg(CASE WHEN q < floor(n / 2) THEN ic END) AS first_half, avg(CASE WHEN q >= floor(n / 2) THEN ic END) AS second_half FROM q GROUP BY formula),
    b AS (SELECT formula, boot, avg(boot) OVER (PARTITION BY formula) AS centre FROM boots),
    p AS (SELECT b.formula, avg(CASE WHEN abs(boot - centre) >= abs(mean_ic) THEN 1e0 ELSE 0e0 END) AS p FROM b JOIN d ON b.formula = d.formula GROUP BY b.formula),
    j AS (SELECT c.formula, c.source, c.five_total, coalesce(n_stocks, 0) AS n_stocks, coalesce(n_days, 0) AS n_days, mean_ic, first_half, second_half, p, oos_bars,
          CASE WHEN coalesce(n_stocks, 0) >= {least_stocks} THEN 'cross' ELSE 'single' END AS mode FROM {{candidates}} c LEFT JOIN s ON c.formula = s.formula LEFT JOIN d ON c.formula = d.formula LEFT JOIN p ON c.formula = p.formula),
    g AS (SELECT *, n_days >= least({LEAST_DAYS}, greatest({FLOOR_DAYS}, oos_bars - 10)) AND n_days >= {LEAST_ICS} AS enough, floor(n_days / 2) < {LEAST_HALF} OR first_half * second_half > 0e0 AS agrees,
          abs(mean_ic) >= {least_ic!r} AS strong, p <= {most_p!r} AS significant, five_total >= {least_five!r} AS rounded FROM j)
    SELECT formula, source, mode, n_stocks, n_days, mean_ic, p, first_half, second_half, five_total, coalesce(enough, false) AS enough, coalesce(agrees, false) AS agrees, coalesce(strong, false) AS strong,
      coalesce(significant, false) AS significant, coalesce(rounded, false) AS rounded, coalesce(enough AND agrees AND strong AND significant AND rounded, false) AS certified FROM g"""
    spark = panel.sparkSession
    crossed = spark.sql(text, panel=panel, candidates=candidates)
    single = _single(panel, crossed.where("mode = 'single'"), share, least_bars, least_ic, most_p, seed)
    return crossed.where("mode = 'cross'").unionByName(single.selectExpr(*crossed.columns))


def _single(panel: DataFrame, waiting: DataFrame, share: float, least_bars: int, least_ic: float, most_p: float, seed: int) -> DataFrame:
    """The verdict of the source's own series, one series a group."""
    keep = waiting.select("formula", "source", "five_total", "n_stocks", "rounded")
    schema = T.StructType([*keep.schema.fields, *T._parse_datatype_string("mode string, n_days long, mean_ic double, p double, first_half double, second_half double, enough boolean, agrees boolean, strong boolean, significant boolean, certified boolean").fields])
    series = panel.join(keep.withColumnRenamed("source", "symbol"), ["formula", "symbol"]).where("f IS NOT NULL AND y IS NOT NULL")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", kind="stable")
        f, y = g["f"].to_numpy(float), g["y"].to_numpy(float)
        n = max(int(len(f) * share), least_bars)
        row = {"formula": g["formula"].iloc[0], "source": g["symbol"].iloc[0], **{c: g[c].iloc[0] for c in ("five_total", "n_stocks", "rounded")}, "mode": "single", "n_days": min(n, len(f))}
        row |= {"mean_ic": None, "p": None, "first_half": None, "second_half": None, "enough": n < len(f), "agrees": False, "strong": False, "significant": False, "certified": False}
        if n < len(f):
            a, b = f[-n:], y[-n:]
            real, before = spearman(a, b), rolling_corr(f[:-n], y[:-n], ranks=True)
            before, p = float(before.mean()) if len(before) else 0.0, bootstrap_p(a, b, real, seed=seed)
            row |= {"mean_ic": real, "p": p, "first_half": before, "second_half": real, "agrees": before * real > 0, "strong": abs(real) >= least_ic, "significant": p <= most_p}
            row["certified"] = bool(row["agrees"] and row["strong"] and row["significant"] and row["rounded"])
        return pd.DataFrame([row])[schema.names].astype({"mean_ic": float, "p": float, "first_half": float, "second_half": float})

    found = series.groupBy("formula", "symbol").applyInPandas(plain_names(run), schema)
    rest = keep.join(found.select("formula", "source"), ["formula", "source"], "left_anti")
    none = rest.selectExpr(*[f"cast({'null' if f.name not in rest.columns else f.name} as {f.dataType.simpleString()}) AS {f.name}" for f in schema if f.name not in ("mode", "n_days", "enough", "agrees", "strong", "significant", "certified")], "'single' AS mode", "0L AS n_days", *[f"false AS {c}" for c in ("enough", "agrees", "strong", "significant", "certified")])
    return found.unionByName(none.select(*schema.names))


def plain_names(run):
    """As ``plain``, for results with several columns of text."""
    def out(g: pd.DataFrame) -> pd.DataFrame:
        made = run(g)
        return made.astype({c: object for c in made.columns if isinstance(made[c].dtype, pd.StringDtype)})

    return out


def bootstrap_p(f: np.ndarray, y: np.ndarray, real: float, block: int = BLOCK, draws: int = DRAWS, seed: int = 0) -> float:
    """Share of block resamples whose rank correlation, centred, is as large as the real one; 1 with under four blocks."""
    n = len(f) // block
    if n < 4:
        return 1.0
    boot = np.empty(draws)
    for i in range(draws):
        at = (np.array([drawn(seed, i, j) % n for j in range(n)])[:, None] * block + np.arange(block)).ravel()
        boot[i] = spearman(f[at], y[at])
    return float((np.abs(boot - boot.mean()) >= abs(real)).mean())


def overfit_probability(panel: DataFrame, blocks: int = 16) -> DataFrame:
    """One row: share of all symmetric splits of time in which the best series (series, ts, pnl) of one half is below the
    median of the other (combinatorially symmetric cross-validation); 0.5 with under 3 series or 2 times a block.

    A series becomes its block sums, a split a number whose bits are its training blocks: there are C(blocks, blocks / 2) of them,
    whatever the data, so that table is the small side of the join; each task keeps one best series a split.
    """
    if not 2 <= blocks <= 20 or blocks % 2:
        raise ValueError("blocks: an even number up to 20")
    half = blocks // 2
    score = lambda want: " + ".join(f"CASE WHEN shiftright(m, {b}) % 2 = {want} THEN b{b} ELSE 0e0 END" for b in range(blocks))
    sums = ", ".join(f"sum(CASE WHEN b = {b} THEN pnl ELSE 0e0 END) / size AS b{b}" for b in range(blocks))
    text = f"""WITH t AS (SELECT ts AS at, row_number() OVER (ORDER BY ts) - 1 AS i, cast(floor(count(*) OVER () / {blocks}) as bigint) AS size FROM (SELECT DISTINCT ts FROM {{panel}}) d),
    r AS (SELECT series, coalesce(pnl, 0e0) AS pnl, size, cast(floor(i / size) as bigint) AS b FROM {{panel}} JOIN t ON ts = at WHERE size >= 2 AND i < size * {blocks}),
    s AS (SELECT series, {sums} FROM r GROUP BY series, size),
    m AS (SELECT /*+ BROADCAST */ cast(id as int) AS m FROM range(0, {1 << blocks}) WHERE bit_count(id) = {half}),
    a AS (SELECT m, series, ({score(1)}) / {half}e0 AS train, ({score(0)}) / {half}e0 AS test FROM s CROSS JOIN m),
    w AS (SELECT m AS best_m, min(struct(-train AS less, series, test)).test AS best_test, stddev_pop(train) >= 1e-9 AS told FROM a GROUP BY m),
    v AS (SELECT m, avg(CASE WHEN test > best_test THEN 1e0 ELSE 0e0 END) > 0.5e0 AND max(told) AS worse FROM a JOIN w ON m = best_m GROUP BY m),
    n AS (SELECT count(*) AS n_series FROM s)
    SELECT CASE WHEN n_series < 3 THEN 0.5e0 ELSE avg(CASE WHEN worse THEN 1e0 ELSE 0e0 END) END AS pbo, n_series, count(m) AS n_splits FROM n LEFT JOIN v ON true GROUP BY n_series"""
    return panel.sparkSession.sql(text, panel=panel)
