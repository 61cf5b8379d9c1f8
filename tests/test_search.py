"""Five objectives against numpy, the shortboard penalty, crossover, mutation and the search as a whole."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import search
from barloom.plans.formula_b import SPACES, normalized, random_genes


def five(f, r):
    """The objectives of one series."""
    n = len(f)
    if n < 20:
        return np.zeros(5)
    ic = []
    for t in range(20, n):
        x, y = f[t - 20 : t] - f[t - 20 : t].mean(), r[t - 20 : t] - r[t - 20 : t].mean()
        if x.std() >= 1e-9 and y.std() >= 1e-9:
            ic.append((x * y).mean() / (x.std() * y.std()))
    if not ic:
        return np.zeros(5)
    head = [abs(np.mean(ic)), np.mean(np.array(ic) > 0)]
    top = r[f >= np.quantile(f, 0.9)]
    if len(top) < 5:
        return np.array([*head, 0, 0, 0])
    sharpe = top.mean() / (top.std() + 1e-9) * np.sqrt(244) if top.std() > 1e-9 else 0
    return np.array([*head, top.mean(), np.clip(sharpe, -10, 10), (top > 0).mean()])


def test_objectives(spark):
    draw = np.random.default_rng(4)
    rows = []
    for s, n in (("a", 300), ("b", 60), ("c", 19), ("d", 21), ("e", 45)):
        y = draw.normal(0, 0.01, n)
        rows.append(pd.DataFrame({"symbol": s, "ts": np.arange(n), "y": y, "good": y * 50 + draw.normal(size=n), "flat": 1.0, "steps": np.floor(np.arange(n) / 15.0), "few": np.where(np.arange(n) == 3, 1.0, draw.normal(size=n) - 5)}))
    f = pd.concat(rows)
    got = search.series_objectives(spark.createDataFrame(f), ["good", "flat", "steps", "few"]).toPandas().set_index("symbol")
    for s, g in f.groupby("symbol"):
        for c in ("good", "flat", "steps", "few"):
            np.testing.assert_allclose(got.loc[s, [f"{c}_{k}" for k in ("ic", "up", "ret", "sharpe", "win")]].to_numpy(float), five(g[c].to_numpy(), g["y"].to_numpy()), atol=1e-9, err_msg=f"{s} {c}")
    assert got.loc["a", "good_ic"] > 0.3 and (got["flat_ic"] == 0).all()


def test_shortboard():
    x = np.array([[0.0, 1.0, 5.0], [0.01, 2.0, 5.0], [0.02, 3.0, 5.0], [0.03, 4.0, 5.0], [1.0, 5.0, 5.0]])
    got = search.shortboard(x)
    np.testing.assert_allclose(got[:, 1:], x[:, 1:])  # spread evenly, and without any range
    np.testing.assert_allclose(got[:, 0], x[:, 0] * (1 - 0.05 * (1 - np.arange(5) / 4)))


def test_crossover_and_mutation():
    rng = np.random.default_rng(0)
    near, far, same = [], [], 0
    for _ in range(400):
        a, b = normalized(random_genes(rng)), normalized(random_genes(rng))
        kids = search.crossed(a, b, rng)
        for k in (*kids, search.mutated(a, rng)):
            assert all(0 <= x < len(s) for x, s in zip(k, SPACES, strict=True))
        near += [abs(x + y - p - q) for x, y, p, q in zip(*kids, a, b, strict=True)]
        m = search.mutated(a, rng, share=1.0)
        far += [abs(x - p) / max(1, len(s) - 1) for x, p, s in zip(m, a, SPACES, strict=True)]
        same += search.mutated(a, rng, share=0.0) == a
    assert same == 400 and np.mean(np.array(near) <= 2) > 0.9 and 0 < np.mean(far) < 0.15  # children around their parents, small steps


def test_directions_fit_the_population():
    assert [len(search.reference_points(5, search.parts_for(n))) for n in (12, 70, 126, 210)] == [35, 70, 126, 210]
    np.testing.assert_allclose(search.reference_points(5, 4).sum(1), 1)


def test_search_gets_better():
    goal = [len(s) // 2 for s in SPACES]
    score = lambda pop: np.array([[-abs(g[i] - goal[i]) - abs(g[j] - goal[j]) for i, j in ((0, 1), (2, 3), (4, 5), (6, 7), (8, 9))] for g in pop], float)
    first, last = search.evolve(score, 40, 0, seed=1), search.evolve(score, 40, 15, seed=1)
    assert len({tuple(g) for g, _ in last}) == 40
    assert np.mean([s.sum() for _, s in last]) > np.mean([s.sum() for _, s in first]) + 3
    kept = search.evolve(score, 40, 3, seed=2, start=[goal])
    assert any(s.sum() >= score([normalized(goal)])[0].sum() for _, s in kept)


def test_front_of_a_real_search(spark):
    from barloom.sources import bars

    found = search.mine(bars.bars_brand(spark, "/root/testdata/sf0.001"), 6, 1)
    scores = np.array([s for _, s in found])
    assert scores.shape[1] == 5 and len(search.fronts(scores)) == 1 and (np.diff(scores[:, 0]) <= 0).all()
    assert scores[:, 0].max() > 0 and ((scores[:, 1] >= 0) & (scores[:, 1] <= 1)).all()
