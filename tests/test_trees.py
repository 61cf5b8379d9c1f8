"""Boosted trees and forests: what stumps can't learn, missing values, importances, and no look ahead."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import models


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.fixture(scope="module")
def interaction():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, 4))
    y = np.sign(x[:, 0] * x[:, 1]) + 0.1 * draw.normal(size=4000)
    return x[:3000], y[:3000], x[3000:], y[3000:]


def test_interactions_are_learned(interaction):
    x, y, to, want = interaction
    assert abs(r2(want, models.stumps(x, y, to))) < 0.05
    gains = []
    assert r2(want, models.boosted(x, y, to, gains=gains)) > 0.9 and gains[0][:2].sum() > 0.9 and gains[0].sum() == pytest.approx(1)
    assert r2(want, models.forest(x, y, to)) > 0.85


def test_one_split_is_the_best_one():
    draw = np.random.default_rng(3)
    x, y = np.round(draw.normal(size=(60, 3)), 1), draw.normal(size=60)
    t = models.Trees(x, 64)
    tree = t.grow(t.binned(x), y, 1, 5, np.arange(3))
    best = (-1.0, None)
    for j in range(3):
        for c in t.cuts[j]:
            left = x[:, j] < c
            if min(left.sum(), (~left).sum()) >= 5:
                gain = left.sum() * (y[left].mean() - y.mean()) ** 2 + (~left).sum() * (y[~left].mean() - y.mean()) ** 2
                best = max(best, (gain, left.tolist()), key=lambda b: b[0])
    left = np.array(best[1])
    assert t.gain.sum() == pytest.approx(best[0])
    np.testing.assert_allclose(t.told(tree, t.binned(x)), np.where(left, y[left].mean(), y[~left].mean()))


def test_missing_values_tell():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 2))
    gone = draw.random(2000) < 0.3
    x[gone, 0] = np.nan
    y = np.where(gone, 2.0, 0.0) + 0.1 * draw.normal(size=2000)
    for model in (models.boosted, models.forest):
        assert r2(y[1500:], model(x[:1500], y[:1500], x[1500:])) > 0.95
    none = np.full((100, 1), np.nan)
    assert np.isfinite(models.boosted(none, y[:100], none)).all()


@pytest.fixture(scope="module")
def panel():
    draw = np.random.default_rng(5)
    f = pd.DataFrame([(t, f"s{i}", *draw.normal(size=3)) for t in range(70) for i in range(12)], columns=["ts", "symbol", "a", "b", "c"])
    f["label"] = np.sign(f["a"] * f["b"]) + 0.2 * draw.normal(size=len(f))
    return f


def test_combination(spark, panel):
    scores, weights = models.combine_ml(spark.createDataFrame(panel), ["a", "b", "c"], window=30, step=10, gap=2)
    got = scores.toPandas().merge(panel, on=["ts", "symbol"])
    assert sorted(got["ts"].unique()) == list(range(32, 70)) and np.corrcoef(got["score"], got["label"])[0, 1] > 0.6
    w = weights.toPandas().pivot(index="fold", columns="factor", values="importance")
    np.testing.assert_allclose(w.sum(axis=1), 1)
    assert (w["c"] < w["a"]).all() and (w["c"] < w["b"]).all() and len(w) == got["fold"].nunique() == 4


@pytest.mark.parametrize("model", ["forest", "trees"])
def test_no_label_of_the_gap_is_used(spark, panel, model):
    run = lambda f: models.combine_ml(spark.createDataFrame(f), ["a", "b", "c"], window=30, step=10, gap=2, model=model)[0].toPandas().set_index(["ts", "symbol"])["score"]
    a, b = run(panel), run(panel.assign(label=panel["label"].where(panel["ts"] < 40, 1e6)))
    early = a.index.get_level_values("ts") < 42  # the fold of 42 .. 51 learns from 10 .. 39
    later = (a.index.get_level_values("ts") >= 42) & (a.index.get_level_values("ts") < 52)
    for part in (early, later):
        pd.testing.assert_series_equal(a[part], b.loc[a[part].index])
    assert not np.allclose(a[a.index.get_level_values("ts") >= 52], b.loc[a[a.index.get_level_values("ts") >= 52].index])
