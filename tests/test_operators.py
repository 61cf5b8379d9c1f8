"""Operators against plain numpy on short series, heads included, and causality of everything by changing the tail."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import features, indicators, language_a
from barloom.plans.staged import SPARK, Plan
from barloom.sources.bars import numbered

T = 30


def window(x, d):
    """The last d values at each row, zeros before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(d - 1), x]), d)


def lagged(x, k):
    return np.concatenate([np.zeros(k), x[:-k]])


def ema(x, span):
    out, a = [x[0]], 2 / (span + 1)
    for v in x[1:]:
        out.append(a * v + (1 - a) * out[-1])
    return np.array(out)


def zscore(x, d):
    w = window(x, d)
    s = w.std(1)
    return np.where(s < 1e-9, 0, (x - w.mean(1)) / (s + 1e-9))


def corr10(x, y):
    a, b = window(x, 10), window(y, 10)
    c = ((a - a.mean(1, keepdims=True)) * (b - b.mean(1, keepdims=True))).mean(1)
    return np.where((a.std(1) < 1e-6) | (b.std(1) < 1e-6), 0, c / (a.std(1) * b.std(1) + 1e-8))


def jump(x):
    n = np.arange(1, len(x) + 1)
    m = x.cumsum() / n
    s = np.sqrt(np.maximum((x * x).cumsum() / n - m * m, 1e-12)) + 1e-6
    return np.where(n <= 5, 0, np.tanh((x - m) / s - 1.5))


def winsor(x):
    lo, hi = np.quantile(window(x, 20), [0.05, 0.95], axis=1)
    return np.where(hi - lo < 1e-9, x, np.clip(x, lo, hi))


def decay_exp(x):
    w = 0.5 ** np.arange(1, 6)
    return window(x, 5) @ (w / w.sum())


def skew(x):
    w = window(x, 10)
    d = w - w.mean(1, keepdims=True)
    return (d**3).mean(1) / (w.std(1) + 1e-6) ** 3


UNARY = {
    "NEG": lambda x: -x, "ABS": np.abs, "SIGN": np.sign, "JUMP": jump, "DELAY1": lambda x: lagged(x, 1), "DELAY4": lambda x: lagged(x, 4),
    "DECAY": lambda x: (x + 0.8 * lagged(x, 1) + 0.6 * lagged(x, 2)) / 2.4, "MAX3": lambda x: window(x, 3).max(1), "WMA": lambda x: window(x, 3) @ [1, 2, 3] / 6,
    **{f"TS_MEAN_{d}": lambda x, d=d: window(x, d).mean(1) for d in (5, 10, 20)}, **{f"TS_STD_{d}": lambda x, d=d: window(x, d).std(1) + 1e-6 for d in (5, 10, 20)},
    **{f"TS_RANK_{d}": lambda x, d=d: (window(x, d) < x[:, None]).mean(1) for d in (5, 10, 20)}, **{f"TS_SUM_{d}": lambda x, d=d: window(x, d).sum(1) for d in (5, 10, 20)},
    "MOMENTUM_5": lambda x: window(x, 5).mean(1) - window(x, 20).mean(1), "MOMENTUM_10": lambda x: window(x, 10).mean(1) - window(x, 20).mean(1),
    **{f"TS_MAX_{d}": lambda x, d=d: window(x, d).max(1) for d in (10, 20)}, **{f"TS_MIN_{d}": lambda x, d=d: window(x, d).min(1) for d in (10, 20)},
    "EMA_5": lambda x: ema(x, 5), "EMA_20": lambda x: ema(x, 20), "TS_QUANTILE_10": lambda x: (window(x, 10) < x[:, None]).mean(1), "TS_SKEW_10": skew,
    "DELTA": lambda x: np.concatenate([[0], np.diff(x)]), "DELTA_5": lambda x: np.concatenate([np.zeros(5), x[5:] - x[:-5]]),
    "TS_ARG_MAX_5": lambda x: window(x, 5).argmax(1) / 4, "TS_ARG_MIN_5": lambda x: window(x, 5).argmin(1) / 4, "DECAY_LINEAR_5": lambda x: window(x, 5) @ np.arange(1, 6) / 15,
    "SCALE": lambda x: x / (np.abs(x).cumsum() + 1e-6), "PRODUCT_5": lambda x: np.expm1(np.clip(window(np.log1p(np.maximum(x, -0.999)), 5).sum(1), -10, 10)),
    "SIGNED_POWER_2": lambda x: np.sign(x) * x * x, "POWER": lambda x: np.sign(x) * x * x, "TS_DECAY_EXP_5": decay_exp, "SIGNED_LOG": lambda x: np.sign(x) * np.log1p(np.abs(x)),
    "SQRT": lambda x: np.sign(x) * np.sqrt(np.abs(x)), "TS_ZSCORE_10": lambda x: zscore(x, 10), "TS_ZSCORE_20": lambda x: zscore(x, 20), "WINSORIZE": winsor,
    "CLIP": lambda x: np.clip(x, -3, 3), "SIGMOID": lambda x: 2 / (1 + np.exp(-x)) - 1, "TANH_SQUASH": np.tanh,
}
BINARY = {
    "ADD": lambda x, y: x + y, "SUB": lambda x, y: x - y, "MUL": lambda x, y: x * y, "DIV": lambda x, y: x / (y + 1e-6), "TS_CORR_10": corr10,
    "COVARIANCE_10": lambda x, y: (window(x, 10) * window(y, 10)).mean(1) - window(x, 10).mean(1) * window(y, 10).mean(1), "MIN": np.minimum, "MAX": np.maximum,
}
TERNARY = {"GATE": lambda c, x, y: np.where(c > 0, x, y), "IF_GT": lambda c, x, y: np.where(c > 0, x, y)}


def bars(n=T, symbols=2, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(symbols):
        c = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        o = c * (1 + rng.normal(0, 0.01, n))
        out.append(pd.DataFrame({"symbol": f"s{s}", "ts": np.arange(n, dtype="int64") * 86400, "open": o, "high": np.maximum(o, c) * 1.01, "low": np.minimum(o, c) * 0.99, "close": c, "volume": rng.uniform(10, 90, n).round()}))
    return pd.concat(out).assign(amount=lambda d: d["close"] * d["volume"])


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    f = bars()
    return f.assign(x=rng.normal(0, 2, len(f)), y=rng.normal(0, 1, len(f)).round(1), z=rng.normal(0, 1, len(f)), flat=3.0)


def test_operators(spark, frame):
    """Every time-series operator in one plan, of a random and of a constant series."""
    p = Plan(SPARK)
    out = {}
    for name, op in language_a.OPERATORS.items():
        if not name.startswith("CS_"):
            out[name] = language_a.apply(p, name, *["x", "y", "z"][: op.arity])
            if op.arity == 1:
                out[f"{name}_flat"] = language_a.apply(p, name, "flat")
    got = p.spark(numbered(spark.createDataFrame(frame)), out).toPandas().sort_values(["symbol", "ts"])
    for s, g in got.groupby("symbol"):
        src = frame[frame["symbol"] == s]
        x, y, z, flat = (src[c].to_numpy(float) for c in ("x", "y", "z", "flat"))
        for name, f in UNARY.items():
            np.testing.assert_allclose(g[name], f(x), atol=1e-7, err_msg=name)
            np.testing.assert_allclose(g[f"{name}_flat"], f(flat), atol=1e-5, err_msg=f"{name} flat")
        for name, f in BINARY.items():
            np.testing.assert_allclose(g[name], f(x, y), rtol=1e-6, atol=1e-7, err_msg=name)
        for name, f in TERNARY.items():
            np.testing.assert_allclose(g[name], f(x, y, z), atol=1e-9, err_msg=name)
    assert {*UNARY, *BINARY, *TERNARY} | {"CS_RANK", "CS_SCALE", "CS_NEUTRALIZE"} == set(language_a.OPERATORS)


def test_cross_section(spark):
    f = pd.DataFrame({"symbol": list("abca"), "ts": [1, 1, 1, 2], "x": [2.0, 2.0, 5.0, 7.0]})
    p = Plan(SPARK)
    out = {n: language_a.apply(p, n, "x") for n in ("CS_RANK", "CS_SCALE", "CS_NEUTRALIZE")}
    got = p.spark(numbered(spark.createDataFrame(f)), out).toPandas().sort_values(["ts", "symbol"])
    np.testing.assert_allclose(got["CS_RANK"], [0, 0.5, 1, 7])
    np.testing.assert_allclose(got["CS_SCALE"], [0, 0, 1, 7])
    np.testing.assert_allclose(got["CS_NEUTRALIZE"], [-1, -1, 2, 7])


def test_arity_is_checked():
    with pytest.raises(ValueError, match="takes 2"):
        language_a.apply(Plan(SPARK), "ADD", "x")


def values(spark, frame, names, table):
    p = Plan(SPARK)
    out = {n: p.let(table[n].build(p) if hasattr(table[n], "build") else table[n](p)) for n in names}
    return p.spark(numbered(spark.createDataFrame(frame)), out).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("kind", ["indicators", "features"])
def test_tail_doesn_t_change_the_past(spark, kind):
    table = indicators.INDICATORS if kind == "indicators" else features.FEATURES
    names = [n for n in table if n not in ("ROLL_SKEW_20", "ROLL_KURT_20", "HURST_50")] if kind == "indicators" else list(table)[::4]
    n, cut = 215, 208
    a = bars(n)
    b = a.copy()
    late = b["ts"] >= cut * 86400
    for c in ("open", "high", "low", "close", "volume", "amount"):
        b.loc[late, c] *= 3.7
    x, y = (values(spark, f, names, table) for f in (a, b))
    early = x["ts"] < cut * 86400
    for name in names:
        np.testing.assert_allclose(x.loc[early, name], y.loc[early, name], rtol=1e-9, atol=1e-9, err_msg=name)
    assert any(not np.allclose(x.loc[~early, m], y.loc[~early, m]) for m in names)


@pytest.mark.parametrize(("n", "some"), [(199, False), (200, True)])
def test_robust_norm_needs_a_full_window(spark, n, some):
    got = values(spark, bars(n, 1), ["RET"], features.FEATURES)["RET"]
    assert (got.abs() > 0).any() == some
