"""All reducers of language B against plain loops over windows, with and without masks, lags, slices and the whole series."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import reducers
from barloom.plans.formula_b import BINARY, UNARY, ParamFormula
from barloom.plans.staged import SPARK, Plan
from barloom.sources.bars import numbered

EPS = 1e-9


@pytest.fixture(scope="module")
def bars():
    draw = np.random.default_rng(9)
    rows = []
    for s in ("a", "b"):
        t = np.sort(draw.choice(400, 150, replace=False)) * 86400
        close = np.round(20 * np.exp(draw.normal(0, 0.02, 150).cumsum()), 2)
        high, low = close * (1 + draw.uniform(0, 0.02, 150)), close * (1 - draw.uniform(0, 0.02, 150))
        volume = np.round(draw.lognormal(3, 0.5, 150))
        rows.append(pd.DataFrame({"symbol": s, "ts": t, "open": close, "high": high, "low": low, "close": close, "volume": volume, "amount": close * volume}))
    return pd.concat(rows)


def indicators(g):
    c = g["close"].to_numpy()
    return {"ret": np.concatenate([[0.0], c[1:] / c[:-1] - 1]), "hl_range": ((g["high"] - g["low"]) / g["close"]).to_numpy(), "volume": g["volume"].to_numpy(), "close": c}


def kept(v, rule):
    side, q = rule.split("_")
    return (v >= np.quantile(v, 1 - float(q)) if side == "high" else v <= np.quantile(v, float(q))).astype(float)


def one(op, x, m):
    n = len(x)
    w = np.ones(n) if m is None else m
    extra = 0.0 if m is None else EPS
    mean = lambda v: (v * w).sum() / (w.sum() + extra)
    mu = mean(x)
    sd = np.sqrt(mean((x - mu) ** 2))
    on = x[w > 0]
    i = np.arange(n) - (n - 1) / 2
    if op == "Slope":
        im = 0.0 if m is None else mean(i)
        return ((x - mu) * (i - im) * w).sum() / (((i - im) ** 2 * w).sum() + EPS) if m is not None else (i * x).mean() / ((i**2).mean() + EPS)
    if op == "AC1":
        both = w[:-1] * w[1:]
        u, v = x[:-1] * (both if m is not None else 1), x[1:] * (both if m is not None else 1)
        u, v = u - u.sum() / (both.sum() + extra), v - v.sum() / (both.sum() + extra)
        return (u * v * both).sum() / (np.sqrt((u**2 * both).sum()) * np.sqrt((v**2 * both).sum()) + EPS)
    if op == "Volatility":
        return (x[1:] / (x[:-1] + EPS) - 1).std()
    return {
        "Mean": mu, "Std": sd, "Sum": mu * w.sum(), "Skew": mean(((x - mu) / (sd + EPS)) ** 3), "Kurt": mean(((x - mu) / (sd + EPS)) ** 4) - 3,
        "Quantile": mean((x < x[-1]).astype(float)), "Range": on.max() - on.min(), "Last": x[-1], "Med": np.median(on), "Mad": np.median(np.abs(on - np.median(on))), "Momentum": x[-1] - x[0],
    }[op]


def two(op, x, y, m):
    w = np.ones(len(x)) if m is None else m
    mean = lambda v: (v * w).sum() / (w.sum() + (0.0 if m is None else EPS))
    mx, my = mean(x), mean(y)
    c, sx, sy = mean((x - mx) * (y - my)), np.sqrt(mean((x - mx) ** 2)), np.sqrt(mean((y - my) ** 2))
    rank = lambda v: v.argsort(kind="stable").argsort(kind="stable") / max(len(v) - 1, 1)
    return {
        "Corr": c / (sx * sy + EPS), "R2": (c / (sx * sy + EPS)) ** 2, "Slope2": c / (sx**2 + EPS), "Intercept": mx - c / (sx**2 + EPS) * my, "Euclid": np.sqrt(mean((x - y) ** 2)),
        "DeltaRatio": mx / (my + EPS) - 1, "Cov": c, "RankDiff": mean(rank(x) - rank(y)),
    }[op]


def plain(g, f):
    ind = indicators(g)
    n = len(g)
    w = n if f.window == "All" else min(f.window, n)
    size = max(2, w - (0 if f.slice is None else int((1 - f.slice) * w)))
    x, y = ind[f.A], ind[f.B] if f.mode == 2 else None
    if y is not None and f.B_shift_lag:
        k = abs(f.B_shift_lag)
        y = np.concatenate([np.full(k, y[0]), y[:-k]])
    out = np.zeros(n)
    for t in range(size - 1, n):
        at = slice(t - size + 1, t + 1)
        m = kept(ind[f.mask_field][at], f.mask_rule) if f.mask_rule else None
        out[t] = one(f.mode1, x[at], m) if f.mode == 1 else two(f.mode2, x[at], y[at], m)
    return out


def check(spark, bars, formulas):
    p = Plan(SPARK)
    cols = {f"f{i}": p.let(reducers.evaluate(p, f, post=False)) for i, f in enumerate(formulas)}
    got = p.spark(numbered(spark.createDataFrame(bars)), cols).toPandas()
    for s, g in bars.groupby("symbol"):
        mine = got[got["symbol"] == s].sort_values("ts")
        for i, f in enumerate(formulas):
            np.testing.assert_allclose(mine[f"f{i}"], plain(g.sort_values("ts"), f), rtol=1e-6, atol=1e-8, err_msg=f.signature())


def formula(**x):
    return ParamFormula(**({"A": "ret", "B": None, "window": 20, "slice": None, "mask_field": None, "mask_rule": None, "mode": 1, "mode1": "Mean", "mode2": None, "B_shift_lag": 0} | x))


@pytest.mark.parametrize("mask", [{}, {"mask_field": "volume", "mask_rule": "high_0.7"}, {"mask_field": "hl_range", "mask_rule": "low_0.3"}])
def test_one_indicator(spark, bars, mask):
    check(spark, bars, [formula(A="hl_range", mode1=op, **mask) for op in UNARY])


@pytest.mark.parametrize("mask", [{}, {"mask_field": "volume", "mask_rule": "low_0.5"}])
def test_two_indicators(spark, bars, mask):
    check(spark, bars, [formula(A="ret", B="hl_range", mode=2, mode2=op, window=10, B_shift_lag=-2 if op in ("Corr", "Cov") else 0, **mask) for op in BINARY])


def test_slices_lags_and_the_whole_series(spark, bars):
    check(spark, bars, [formula(mode1="Std", slice=0.3), formula(A="volume", mode1="Med", slice=0.0), formula(A="close", mode1="Range", window="All"), formula(A="close", mode1="Mad", window="All"), formula(A="volume", mode1="AC1", window="All", slice=0.7), formula(A="ret", B="volume", mode=2, mode2="Corr", B_shift_lag=4, window=60), formula(A="close", mode1="Std", window=5)])


def test_whole_series_is_held_once(spark, bars):
    """A long series: the array is at the last row alone, so 20,000 rows take a few arrays and not 20,000."""
    n = 20_000
    long = spark.range(n).selectExpr("'a' AS symbol", "id * 60 AS ts", "10e0 + id % 97 AS close").selectExpr("symbol", "ts", "close AS open", "close AS high", "close AS low", "close", "1e0 AS volume", "close AS amount")
    p = Plan(SPARK)
    got = p.spark(numbered(long), {"x": p.let(reducers.evaluate(p, formula(A="close", mode1="Med", window="All"), post=False))})
    assert got.where("x <> 0").collect() == [("a", (n - 1) * 60, float(np.median(10 + np.arange(n) % 97)))]
