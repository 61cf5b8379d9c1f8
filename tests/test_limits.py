"""Trades that price limits block, against plain loops."""

import numpy as np
import pandas as pd
import pytest

from barloom.functions import recursive
from barloom.operators import backtest


def held(want, ret, up, down):
    last, out = 0.0, []
    for w, r in zip(want, ret, strict=True):
        if (r >= up and w > last) or (r <= -down and w < last):
            w = last
        out.append(w)
        last = w
    return out


@pytest.mark.parametrize("share", [0.1, 0.5, 0.95])
def test_recursion(spark, share):
    draw = np.random.default_rng(int(share * 100))
    rows = []
    for s in range(6):
        n = [1, 2, 40, 300, 700, 700][s]
        ret = np.where(draw.random(n) < share, np.where(draw.random(n) < 0.5, 0.1, -0.1), draw.normal(0, 0.01, n))
        rows.append(pd.DataFrame({"symbol": f"s{s}", "ts": np.arange(n), "w": np.round(draw.normal(size=n), 1), "ret": ret}))
    f = pd.concat(rows)
    got = recursive.limit_blocked(spark.createDataFrame(f)).toPandas().sort_values(["symbol", "ts"])
    assert list(got.columns) == ["symbol", "ts", "w", "ret", "held"]
    for _, g in got.groupby("symbol"):
        assert g["held"].tolist() == held(g["w"], g["ret"], 0.099, 0.099)


def test_nulls_are_no_weight_and_no_move(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, None, 0.0), ("a", 3, 1.0, 0.2), ("a", 4, 1.0, None)], "symbol string, ts long, w double, ret double")
    assert [r.held for r in recursive.limit_blocked(df).orderBy("ts").collect()] == [1.0, 0.0, 0.0, 1.0]


def board(panel, legs=5, cost=0.0003, slippage=0.0002, impact=0.1, capital=1e6, year=244):
    """The portfolio backtest in pandas, a matrix of times by symbols each."""
    wide = {c: panel.pivot(index="ts", columns="symbol", values=c) for c in ("f", "r1", "amount")}
    lim = np.array([0.199 if s.startswith(("sh688", "sz30")) else 0.099 for s in wide["f"].columns])
    raw = wide["r1"].fillna(0.0)
    target = pd.DataFrame(0.0, raw.index, raw.columns)
    for t, row in wide["f"].iterrows():
        order = sorted(row.index, key=lambda s: (-row[s], s))
        back = sorted(row.index, key=lambda s: (row[s], s))
        if len(order) >= 2 * legs:
            target.loc[t, back[:legs]] = -1 / legs
            target.loc[t, order[:legs]] = 1 / legs
    want = target.shift(fill_value=0.0)
    w = pd.DataFrame({s: held(want[s], raw[s], x, x) for s, x in zip(raw.columns, lim, strict=True)}, raw.index)
    ret = raw.where(raw.abs() <= 0.21, 0.0)
    trade = (w - w.shift(fill_value=0.0)).abs()
    adv = wide["amount"].rolling(20, 1).mean()
    sigma = wide["r1"].rolling(20, 1).std(ddof=0)
    fees = (trade * (cost + slippage + impact * sigma.fillna(0) * np.sqrt(np.minimum(1.0, trade * capital / adv)))).sum(axis=1)
    pnl, market = (w * ret).sum(axis=1) - fees, ret.mean(axis=1)
    extra = pnl - market
    return {"total": np.exp(np.log(np.maximum(1 + pnl, 1e-12)).sum()) - 1, "sharpe": pnl.mean() / pnl.std(ddof=0) * year**0.5, "turnover": trade.sum(axis=1).mean(), "fees": fees.sum(), "excess": extra.mean(), "information_ratio": extra.mean() / extra.std(ddof=0) * year**0.5}


def test_board_backtest(spark):
    draw = np.random.default_rng(8)
    names = [f"{p}{i:03d}" for p in ("sh688", "sz30", "sh600") for i in range(5)]
    rows = []
    for s in names:
        r1 = draw.normal(0, 0.02, 150)
        r1[draw.random(150) < 0.1] = draw.choice([0.1, -0.1, 0.2, -0.2, 0.3])
        r1[0] = np.nan
        rows.append(pd.DataFrame({"symbol": s, "ts": np.arange(150), "f": draw.normal(size=150).cumsum(), "r1": r1, "amount": draw.uniform(1e5, 1e7, 150)}))
    f = pd.concat(rows)
    df = spark.createDataFrame(f).selectExpr("symbol", "ts", "f", "CASE WHEN isnan(r1) THEN null ELSE r1 END AS r1", "amount")
    got = backtest.portfolio_backtest(df).collect()[0].asDict()
    for k, v in board(f).items():
        assert got[k] == pytest.approx(v, abs=2e-6), k


def test_position_at_a_limit_stays(spark):
    """A long held throughout earns the day at its upper limit, and isn't sold at its lower."""
    days = [0.01, 0.02, 0.1, 0.01, -0.1, 0.01]
    rows = [(s, t, 1.0 if s == "sh600a" else 0.0, d if s == "sh600a" else 0.0, 1e12) for s in ("sh600a", "sh600b") for t, d in enumerate(days)]
    df = spark.createDataFrame(rows, "symbol string, ts long, f double, r1 double, amount double")
    got = backtest.portfolio_backtest(df, legs=1, cost=0.0, slippage=0.0, impact=0.0).collect()[0]
    assert got.total == pytest.approx(np.prod([1 + d for d in days[1:]]) - 1, abs=1e-6) and got.turnover == pytest.approx(2 / 6, abs=1e-6)
