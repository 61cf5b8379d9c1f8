"""Certification and overfitting in Spark against numpy on the same draws."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import certify, significance


def panel_of(spark, formulas, y):
    n, t = y.shape
    rows = [(k, f"s{i:03d}", j * 86400, None if np.isnan(f[i, j]) else float(f[i, j]), float(y[i, j])) for k, f in formulas.items() for i in range(n) for j in range(t)]
    return spark.createDataFrame(rows, "formula string, symbol string, ts long, f double, y double")


def population(n=36, t=430, seed=0):
    draw = np.random.default_rng(seed)
    y = draw.normal(0, 0.01, (n, t))
    sign = np.where(np.arange(t) < t - 125, 1, -1)
    made = {"good": 8 * y + draw.normal(0, 0.3, (n, t)), "noise": draw.normal(size=(n, t)), "flips": 40 * y * sign + draw.normal(size=(n, t)), "tied": np.round(60 * y + draw.normal(size=(n, t)))}
    made["gaps"] = np.where(draw.random((n, t)) < 0.05, np.nan, -30 * y + draw.normal(size=(n, t)))
    return made, y


def plain_cross(f, y, five, share=0.25):
    last = []
    for a, b in zip(f, y, strict=True):
        ok = ~np.isnan(a)
        n = max(int(ok.sum() * share), 250)
        if n < ok.sum():
            last.append(np.flatnonzero(ok)[-n:])
    ics = []
    for j in range(y.shape[1]):
        who = [i for i, at in enumerate(last) if j in at]
        if len(who) >= 30 and f[who, j].std() >= 1e-12:
            ics.append(significance.spearman(f[who, j], y[who, j]))
    ics = np.array(ics)
    m = len(ics) // 20
    boot = np.array([np.concatenate([ics[certify.drawn(0, i, k) % m * 20 :][:20] for k in range(m)]).mean() for i in range(500)])
    half = len(ics) // 2
    p = float((np.abs(boot - boot.mean()) >= abs(ics.mean())).mean())
    ok = [len(ics) >= min(250, max(200, min(map(len, last)) - 10)), half < 30 or ics[:half].mean() * ics[half:].mean() > 0, abs(ics.mean()) >= 0.02, p <= 0.05, five >= 0.45]
    return len(last), len(ics), ics.mean(), p, ok


def test_across_symbols(spark):
    made, y = population()
    five = {"good": 0.6, "noise": 0.6, "flips": 0.6, "tied": 0.6, "gaps": 0.2}
    cands = spark.createDataFrame([(k, "s000", v) for k, v in five.items()] + [("absent", "s000", 0.9)], "formula string, source string, five_total double")
    got = {r.formula: r for r in certify.certify(panel_of(spark, made, y), cands).collect()}
    for k, f in made.items():
        stocks, days, mean, p, gates = plain_cross(f, y, five[k])
        r = got[k]
        assert (r.mode, r.n_stocks, r.n_days) == ("cross", stocks, days) and r.mean_ic == pytest.approx(mean, abs=1e-12) and r.p == pytest.approx(p, abs=0.003)
        assert [r.enough, r.agrees, r.strong, r.significant, r.rounded] == gates and r.certified == all(gates)
    assert got["good"].certified and got["tied"].certified and not got["noise"].certified and not got["flips"].agrees and not got["gaps"].rounded
    assert got["absent"].mode == "single" and not got["absent"].certified


def test_one_symbol(spark):
    made, y = population(3, 700, 5)
    made = {k: made[k] for k in ("good", "noise", "flips")}
    cands = spark.createDataFrame([(k, "s001", 0.5) for k in made], "formula string, source string, five_total double")
    got = {r.formula: r for r in certify.certify(panel_of(spark, made, y), cands).collect()}
    for k, f in made.items():
        a, b = f[1][-250:], y[1][-250:]
        real, before = significance.spearman(a, b), significance.rolling_corr(f[1][:-250], y[1][:-250], ranks=True).mean()
        r = got[k]
        assert r.mode == "single" and r.n_days == 250 and r.mean_ic == pytest.approx(real) and r.first_half == pytest.approx(before)
        assert abs(r.p - significance.block_bootstrap_p(a, b, draws=500)) < 0.06
        assert r.certified == (before * real > 0 and abs(real) >= 0.02 and r.p <= 0.05)
    assert got["good"].certified
    short = certify.certify(panel_of(spark, {"good": made["good"][:, :200]}, y[:, :200]), cands.where("formula = 'good'")).collect()[0]
    assert not short.enough and not short.certified


@pytest.mark.parametrize(("n", "t", "blocks"), [(9, 69, 8), (5, 67, 4), (30, 169, 10), (3, 16, 8), (2, 100, 4), (5, 15, 8)])
def test_overfit_probability(spark, n, t, blocks):
    draw = np.random.default_rng(n * t)
    pnl = np.round(draw.normal(0, 9, (n, t)))  # whole numbers and blocks of 2, 8 and 16: sums are exact, so ties are ties
    pnl[-1] = pnl[0]  # ties
    rows = pd.DataFrame([(f"s{i:02d}", j * 60, pnl[i, j]) for i in range(n) for j in range(t)], columns=["series", "ts", "pnl"])
    got = certify.overfit_probability(spark.createDataFrame(rows), blocks).collect()[0]
    assert got.pbo == pytest.approx(significance.overfit_probability(pnl, blocks, most=10**6), abs=1e-12)


def test_overfit_extremes(spark):
    t = np.arange(160)
    best = np.vstack([np.full(160, 1.0) + 0.01 * np.sin(t), *[0.1 * np.sin(t * k) for k in range(2, 8)]])
    rows = pd.DataFrame([(f"s{i:02d}", j, best[i, j]) for i in range(7) for j in range(160)], columns=["series", "ts", "pnl"])
    r = certify.overfit_probability(spark.createDataFrame(rows)).collect()[0]
    assert (r.pbo, r.n_series, r.n_splits) == (0.0, 7, 12870)
    with pytest.raises(ValueError, match="even number"):
        certify.overfit_probability(spark.createDataFrame(rows), 7)
