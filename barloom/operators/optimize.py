"""Weights from expected returns and covariances, cross-section regressions and risk models, in numpy per time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import plain


def project(v: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """Nearest weights in 0 .. cap that sum to 1, by bisection on the shift."""
    cap = max(cap, 1.0 / len(v))
    lo, hi = v.min() - 1.0, v.max()
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
    w = np.clip(v - (lo + hi) / 2, 0, cap)
    return w / w.sum()


def quadratic(mu: np.ndarray, cov: np.ndarray, risk: float = 1.0, cap: float = 1.0, rounds: int = 500) -> np.ndarray:
    """Long-only weights of largest mu w - risk / 2 w cov w, by projected gradient."""
    w = np.full(len(mu), 1 / len(mu))
    step = 1 / (risk * np.linalg.eigvalsh(cov)[-1] + 1e-12)
    for _ in range(rounds):
        new = project(w + step * (mu - risk * cov @ w), cap)
        if np.abs(new - w).max() < 1e-10:
            return new
        w = new
    return w


def markowitz(returns: np.ndarray, aversion: float = 1.0, cap: float = 1.0) -> np.ndarray:
    """aversion multiplies the risk: more of it, less variance."""
    return quadratic(returns.mean(0), np.atleast_2d(np.cov(returns.T)) + 1e-10 * np.eye(returns.shape[1]), max(aversion, 1e-9), cap)


def risk_parity(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Equal risk contributions by cyclical coordinate descent."""
    n = len(cov)
    w = 1 / np.sqrt(np.diag(cov) + 1e-18)
    for _ in range(rounds):
        old = w.copy()
        for i in range(n):
            b = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(w - old).max() < 1e-12 * np.abs(w).max():
            break
    return w / w.sum()


def black_litterman(cov: np.ndarray, market: np.ndarray, views: np.ndarray, values: np.ndarray, tau: float = 0.05, aversion: float = 2.5, cap: float = 1.0) -> np.ndarray:
    """Weights for equilibrium returns updated by views (rows of `views` times returns are `values`)."""
    prior, spread = aversion * cov @ market, tau * cov
    omega = np.diag(np.diag(views @ spread @ views.T)) + 1e-12 * np.eye(len(views))
    mu = prior + spread @ views.T @ np.linalg.solve(views @ spread @ views.T + omega, values - views @ prior)
    return quadratic(mu, cov, aversion, cap)


def efficient_frontier(returns: np.ndarray, points: int = 10) -> list[tuple[float, float]]:
    """(deviation, mean) for aversions from 100 down to 0.1."""
    cov, out = np.atleast_2d(np.cov(returns.T)), []
    for a in np.geomspace(100, 0.1, points):
        w = markowitz(returns, a)
        out.append((float(np.sqrt(w @ cov @ w)), float(returns.mean(0) @ w)))
    return out


def ledoit_wolf(returns: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk to its diagonal; the intensity is the estimation variance over the distance, both per observation."""
    x = returns - returns.mean(0)
    t = len(x)
    s = x.T @ x / t
    target = np.diag(np.diag(s))
    variance = ((x[:, :, None] * x[:, None, :] - s) ** 2).sum(0).sum() / t**2
    gap = ((s - target) ** 2).sum()
    delta = float(np.clip(variance / gap, 0, 1)) if gap > 1e-18 else 1.0
    return delta * target + (1 - delta) * s, delta


def optimize_panel(panel: DataFrame, method: str = "markowitz", n_top: int = 5, window: int = 60, every: int = 4, least: int = 30) -> DataFrame:
    """Weights (ts, symbol, w) of the n_top best and worst scores of each rebalance; panel: ts, symbol, score, ret.

    ret is known at ts.  The rebalance's candidates are joined to the returns of the `window` times before it, so a
    group is one rebalance of at most 2 n_top symbols by window rows.
    """
    times = panel.select("ts").distinct().withColumn("i", F.expr("row_number() over (order by ts)"))
    ranked = panel.where("score is not null").join(times, "ts").where(F.col("i") % every == 0)
    ranked = ranked.withColumns({"hi": F.expr("row_number() over (partition by ts order by score desc, symbol)"), "lo": F.expr("row_number() over (partition by ts order by score, symbol)")})
    chosen = ranked.where((F.col("hi") <= n_top) | (F.col("lo") <= n_top)).select(F.col("ts").alias("at"), F.col("i").alias("at_i"), "symbol", (F.col("hi") <= n_top).alias("long"))
    steps = F.explode(F.sequence(F.col("at_i") - window + 1, F.col("at_i")))
    past = chosen.withColumn("i", steps).join(times, "i").join(panel.select("ts", "symbol", "ret"), ["ts", "symbol"], "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for long, side in g.groupby("long"):
            x = side.pivot_table(index="ts", columns="symbol", values="ret").fillna(0.0)
            if len(x) < least or x.shape[1] < 2:
                continue
            m = x.to_numpy() * (1 if long else -1)
            w = risk_parity(ledoit_wolf(m)[0]) if method == "risk_parity" else markowitz(m, 10.0, 0.5)
            out.append(pd.DataFrame({"ts": g["at"].iloc[0], "symbol": x.columns, "w": w * (1.0 if long else -1.0)}))
        return pd.concat(out) if out else pd.DataFrame({"ts": [], "symbol": [], "w": []})

    return past.groupBy("at").applyInPandas(plain(run), "ts long, symbol string, w double")


def neutralize(panel: DataFrame, value: str, styles: list[str], group: str | None = None, least: int = 10) -> DataFrame:
    """Residual z (ts, symbol, value, r2) of a value on styles and group dummies, per time, by least squares."""
    cols = ["ts", "symbol", value, *styles, *([group] if group else [])]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=[value, *styles])
        if len(g) < least:
            return pd.DataFrame({"ts": [], "symbol": [], "value": [], "r2": []})
        parts = [np.ones((len(g), 1)), g[styles].to_numpy(float)]
        if group:
            parts.append(pd.get_dummies(g[group], drop_first=True).to_numpy(float))
        x, y = np.column_stack(parts), g[value].to_numpy(float)
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        sd, total = e.std(), ((y - y.mean()) ** 2).sum()
        return pd.DataFrame({"ts": g["ts"], "symbol": g["symbol"], "value": (e - e.mean()) / sd if sd > 1e-12 else e * 0, "r2": 1 - (e**2).sum() / total if total > 1e-18 else 0.0})

    return panel.select(*cols).groupBy("ts").applyInPandas(plain(run), "ts long, symbol string, value double, r2 double")


def factor_returns(panel: DataFrame, styles: list[str], least: int = 10) -> DataFrame:
    """Style returns per time (ts, one column each): the slopes of ret on the styles, with an intercept.

    panel: ts, symbol, ret and styles.  A time's cross-section becomes its covariances, which combine before the shuffle;
    only these few numbers are solved in Python.
    """
    k = len(styles)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.covar_pop(styles[i], styles[j]).alias(f"c{i}_{j}") for i, j in pairs] + [F.covar_pop(s, "ret").alias(f"y{i}") for i, s in enumerate(styles)]
    moments = panel.dropna(subset=["ret", *styles]).groupBy("ts").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, y = np.empty((len(f), k, k)), f[[f"y{i}" for i in range(k)]].to_numpy(float)
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = f[f"c{i}_{j}"]
            yield pd.DataFrame(np.einsum("tij,tj->ti", np.linalg.pinv(a, hermitian=True), y), columns=styles).assign(ts=f["ts"].to_numpy())[["ts", *styles]]

    return moments.mapInPandas(solve, "ts long, " + ", ".join(f"{s} double" for s in styles))


def risk_model(panel: DataFrame, styles: list[str], least: int = 10) -> tuple[DataFrame, np.ndarray, list[str]]:
    """``factor_returns``, their shrunk covariance, and the styles.  As many rows as the panel has times go to the driver."""
    returns = factor_returns(panel, styles, least)
    known = returns.orderBy("ts").toPandas()[styles].to_numpy(float)
    return returns, ledoit_wolf(known)[0] if len(known) > 1 else np.eye(len(styles)), styles


def decompose_risk(panel: DataFrame, styles: list[str], least: int = 10) -> DataFrame:
    """Variance of the portfolio w per ts: exposures to styles under their covariance, the rest by each symbol's own
    residual variance, and the styles' share.

    panel: ts, symbol, ret, w and styles.  Only the covariance of the styles is on the driver.
    """
    cov = risk_model(panel, styles, least)[1]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=["ret", *styles])
        if len(g) < least:
            return pd.DataFrame({"symbol": [], "e": []})
        x = np.column_stack([np.ones(len(g)), g[styles].to_numpy(float)])
        y = g["ret"].to_numpy(float)
        return pd.DataFrame({"symbol": g["symbol"], "e": y - x @ np.linalg.lstsq(x, y, rcond=None)[0]})

    rest = panel.select("ts", "symbol", "ret", *styles).groupBy("ts").applyInPandas(plain(run), "symbol string, e double")
    own = rest.groupBy("symbol").agg(F.var_pop("e").alias("own"))
    held = panel.where("w <> 0").join(own, "symbol", "left")
    at = held.groupBy("ts").agg(*[F.sum(F.col("w") * F.coalesce(s, F.lit(0.0))).alias(s) for s in styles], F.sum(F.col("w") * F.col("w") * F.coalesce("own", F.lit(0.0))).alias("specific"))
    common = sum((F.lit(float(cov[i, j])) * F.col(a) * F.col(b) for i, a in enumerate(styles) for j, b in enumerate(styles)), F.lit(0.0))
    at = at.withColumn("common", common)
    return at.select("ts", *styles, "common", "specific", (F.col("common") / F.nullif(F.col("common") + F.col("specific"), F.lit(0.0))).alias("share"))
