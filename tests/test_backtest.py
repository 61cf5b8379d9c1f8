"""The per-symbol backtest, its direction and net values against loops."""

import math

import numpy as np
import pandas as pd
import pytest

from barloom.operators import backtest


def panel(seed=0):
    draw = np.random.default_rng(seed)
    rows = []
    for s, n in (("sh600000", 90), ("sh688001", 120), ("sz300002", 77), ("sz000003", 31), ("sz000004", 29)):
        r = draw.normal(0, 0.03, n)
        r[draw.random(n) < 0.1] = draw.choice([0.1, -0.1, 0.2, -0.2, 0.5, -0.4])
        close = 10 * np.cumprod(1 + r)
        close[draw.integers(5, n - 5)] = 0.0
        f = draw.normal(size=n)
        rows.append(pd.DataFrame({"symbol": s, "ts": np.arange(n) * 86400, "f": np.where(draw.random(n) < 0.05, np.nan, f), "close": close}))
    return pd.concat(rows)


def loop(g, horizon=5, cost=0.0003, slippage=0.0, year=244, direction=1.0, limits=True):
    f = g["f"].fillna(0.0).to_numpy()
    c, last = [], math.nan
    for x in g["close"]:
        last = x if x > 0 else last
        c.append(last)
    n = len(c)
    raw = [0.0, *(c[i] / c[i - 1] - 1 for i in range(1, n))]
    ret = [c[i + horizon] / c[i] - 1 if i + horizon < n else 0.0 for i in range(n)]
    lim = 0.199 if g["symbol"].iloc[0].startswith(("sh688", "sz30")) else 0.099
    if direction is None:
        h = n // 2
        same = np.std(f[:h]) > 0 and np.std(ret[:h]) > 0
        direction = 1.0 if not same or np.corrcoef(f[:h], ret[:h])[0, 1] >= 0 else -1.0
    pos = np.tanh(f) * direction
    held, now, pnl, nav = [], 0.0, [], []
    for i in range(n):
        jump = abs(raw[i]) > 0.21
        before = now
        if i >= 1 and (i - 1) % horizon == 0 and not jump:
            now = pos[i - 1]
            if limits and ((raw[i] >= lim and now > 0) or (raw[i] <= -lim and now < 0)):
                now = 0.0
        held.append(now)
        pnl.append(now * (0.0 if jump else raw[i]) - (cost + slippage) * abs(now - before))
        nav.append((nav[-1] if nav else 1.0) * max(1 + pnl[-1], 1e-12))
    day, peak = np.array(pnl[1:]), np.maximum.accumulate(nav)
    down = day[day < 0]
    annual = (1 + day.mean()) ** year - 1 if day.mean() > -1 else -1.0
    dd = float((1 - np.array(nav) / peak).max())
    ic = np.corrcoef(f, ret)[0, 1]
    rank = np.corrcoef(pd.Series(f).rank(), pd.Series(ret).rank())[0, 1]
    return {
        "n": n, "direction": direction, "jump_days": sum(abs(x) > 0.21 for x in raw), "total_ret": nav[-1] - 1, "annual_ret": annual, "annual_vol": day.std() * year**0.5,
        "sharpe": day.mean() / day.std() * year**0.5 if day.std() > 1e-12 else 0.0, "sortino": day.mean() / (down.std() + 1e-12) * year**0.5 if len(down) > 1 else 0.0, "max_dd": dd,
        "calmar": annual / (dd + 1e-12) if dd > 1e-9 else 0.0, "profit_factor": day[day > 0].sum() / -down.sum(), "win_rate": (day > 0).mean(), "turnover": np.abs(np.diff(pos)).mean(),
        "ic": ic, "icir": ic / (np.std(ret) + 1e-9), "rankic": rank,
    }, held, nav


@pytest.fixture(scope="module")
def frame(spark):
    f = panel()
    return f, spark.createDataFrame(f).selectExpr("symbol", "ts", "CASE WHEN isnan(f) THEN null ELSE f END AS f", "close")


@pytest.mark.parametrize(("run", "options", "mine"), [
    (backtest.backtest, {}, {}),
    (backtest.backtest, {"horizon": 1, "cost": 0.001, "slippage": 0.002, "direction": -1.0, "limits": False, "year": 52}, {"horizon": 1, "cost": 0.001, "slippage": 0.002, "direction": -1.0, "limits": False, "year": 52}),
    (backtest.directed_backtest, {}, {"slippage": 0.0005, "direction": None}),
])
def test_figures(frame, run, options, mine):
    f, df = frame
    got = {r.symbol: r.asDict() for r in run(df, **options).collect()}
    assert sorted(got) == sorted(s for s, g in f.groupby("symbol") if len(g) >= 30)
    for s, r in got.items():
        for k, v in loop(f[f["symbol"] == s], **mine)[0].items():
            assert r[k] == pytest.approx(v, rel=2e-6, abs=6e-5 if k in ("sortino", "calmar", "profit_factor", "icir") else 1.1e-6), (s, k)


def test_net_values(frame):
    f, df = frame
    got = backtest.backtest_nav(df, horizon=3).toPandas()
    for s, g in got.groupby("symbol"):
        _, held, nav = loop(f[f["symbol"] == s], horizon=3)
        g = g.sort_values("ts")
        np.testing.assert_allclose(g["held"], held, atol=1e-6)
        np.testing.assert_allclose(g["nav"], nav, atol=1e-6)


def test_direction_is_a_double(frame):
    _, df = frame
    assert {backtest.backtest(df).schema["direction"].dataType.typeName(), backtest.directed_backtest(df).schema["direction"].dataType.typeName()} == {"double"}
