"""Operators on long series and on large levels, against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import features, indicators, language_a
from barloom.plans.staged import SPARK, Plan, rolling_scores
from barloom.sources.bars import numbered

N = 10_000


def ema(x, span):
    a, out = 2 / (span + 1), np.empty(len(x))
    out[0] = x[0]
    for i in range(1, len(x)):
        out[i] = a * x[i] + (1 - a) * out[i - 1]
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(8)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, N)))
    frame = pd.DataFrame({"symbol": "a", "ts": np.arange(N) * 86400, "open": close * (1 + rng.normal(0, 0.002, N)), "close": close, "volume": rng.uniform(1e3, 1e6, N)})
    frame["high"], frame["low"] = frame[["open", "close"]].max(axis=1) * 1.003, frame[["open", "close"]].min(axis=1) * 0.997
    frame["amount"] = frame["close"] * frame["volume"]
    return frame


def run(spark, frame, build):
    p = Plan(SPARK)
    out = {n: p.let(x) for n, x in build(p).items()}
    return p.spark(numbered(spark.createDataFrame(frame)), out).toPandas().sort_values("ts")


def test_ema_at_any_length(spark, bars):
    got = run(spark, bars, lambda p: {f"e{d}": language_a.ema(p, "close", d) for d in (2, 5, 12, 20, 26)} | {"five": language_a.apply(p, "EMA_5", "close"), "twenty": language_a.apply(p, "EMA_20", "close")})
    close = bars["close"].to_numpy()
    for d in (2, 5, 12, 20, 26):
        np.testing.assert_allclose(got[f"e{d}"], ema(close, d), rtol=1e-9)
    np.testing.assert_allclose(got["five"], ema(close, 5), rtol=1e-9)
    np.testing.assert_allclose(got["twenty"], ema(close, 20), rtol=1e-9)


def test_users_of_ema_at_any_length(spark, bars):
    names = ["MACD_HIST", "EMA_RATIO_12_26", "TRIX_15", "PPO", "TRIX_SIGNAL", "KELTNER_POS_20", "SAR_DIST"]
    inds = ["macd_hist", "ema_ratio_12_26", "trix_15", "ppo"]
    got = run(spark, bars, lambda p: {n.lower(): features.FEATURES[n].build(p) for n in names} | {f"i_{n}": indicators.INDICATORS[n](p) for n in inds})
    values = got.drop(columns=["symbol", "ts"])
    assert values.notna().all().all()
    assert (values.iloc[-2000:].std() > 1e-9).all()  # none of them has fallen to a constant
    # what comes of the last 3,000 bars is what comes of them alone, since older ones weigh nothing
    late = run(spark, bars.iloc[-3000:], lambda p: {n.lower(): features.FEATURES[n].build(p) for n in names} | {f"i_{n}": indicators.INDICATORS[n](p) for n in inds})
    np.testing.assert_allclose(values.iloc[-1000:], late.drop(columns=["symbol", "ts"]).iloc[-1000:], rtol=1e-5, atol=1e-5)


def test_variance_at_large_levels(spark):
    x = 1e6 + np.arange(60) / 1000
    frame = pd.DataFrame({"symbol": "a", "ts": np.arange(60), "x": x, "c": 98765.43})
    got = run(spark, frame, lambda p: {"s": language_a.std(p, "x", 10), "flat": language_a.std(p, "c", 10), "corr": language_a.corr(p, "x", "c", 10), "z": language_a.zscore(p, "c", 10)})
    want = pd.Series(x).rolling(10).std(ddof=0)
    np.testing.assert_allclose(got["s"].iloc[9:], want.iloc[9:], rtol=1e-5)
    assert got["flat"].iloc[9:].abs().max() < 1e-9 and (got["corr"].iloc[9:] == 0).all() and (got["z"].iloc[9:] == 0).all()
    padded = np.concatenate([np.zeros(9), x])
    np.testing.assert_allclose(got["s"].iloc[:9], [padded[i : i + 10].std() for i in range(9)], rtol=1e-9)


def test_rolling_scores():
    rng = np.random.default_rng(9)
    x, w = rng.normal(0, 1, 500), 200
    got = rolling_scores(x, w)
    assert (got[: w - 1] == 0).all()
    for t in (w - 1, 300, 499):
        win = np.sort(x[t - w + 1 : t + 1])
        med = win[w // 2 - 1]
        mad = np.sort(np.abs(win - med))[w // 2 - 1] + 1e-6
        assert abs(got[t] - np.clip((x[t] - med) / mad, -5, 5)) < 1e-12


def test_feature_table_in_chunks(spark, bars):
    names = ["RET", "ATR", "MACD_HIST", "RSI14", "CS_RANK_RET5"]
    frame = pd.concat([bars.iloc[:300], bars.iloc[300:600].assign(symbol="b", ts=bars["ts"].iloc[:300].to_numpy())])
    got = features.table(spark.createDataFrame(frame), names, 2).toPandas().sort_values(["symbol", "ts"])
    want = run(spark, frame, lambda p: {n: features.FEATURES[n].build(p) for n in names}).sort_values(["symbol", "ts"])
    assert got.columns.tolist() == want.columns.tolist() and len(got) == 600
    np.testing.assert_allclose(got[names], want[names], rtol=1e-9, atol=1e-12)
