import numpy as np
import pandas as pd
import pytest

from barloom.functions import recursive
from barloom.operators import models, optimize, search, significance
from barloom.sources.codes import normalized
from barloom.sources.store import BarStore, FactorStore

RNG = np.random.default_rng(0)


def test_deflated_sharpe_falls_with_trials():
    pnl = RNG.normal(1.0, 1, 500)
    few, many = significance.deflated_sharpe(pnl, 2), significance.deflated_sharpe(pnl, 1000)
    assert few > many and 0 <= many <= 1
    assert significance.expected_max_sharpe(1) == 0 and 2.4 < significance.expected_max_sharpe(100) < 2.6


def test_overfitting_of_noise_and_of_a_better_series():
    x = RNG.normal(0, 1, (10, 400))
    assert 0.2 < significance.overfit_probability(x, 8) < 0.9
    x[0] += 1
    assert significance.overfit_probability(x, 8) == 0


def test_cpcv_paths():
    p = significance.cpcv_paths(np.ones(60))
    assert len(p) == 20 and (p == 30).all() and significance.cpcv_summary(p)["all_positive"]
    assert len(significance.cpcv_paths(np.ones(10))) == 0


def test_bootstrap_and_five_dim():
    f = RNG.normal(0, 1, 400)
    y = f + RNG.normal(0, 1, 400)
    assert significance.block_bootstrap_p(f, y) < 0.05 < significance.block_bootstrap_p(f, RNG.normal(0, 1, 400))
    assert significance.five_dim(f, y)["total"] > significance.five_dim(f, RNG.normal(0, 1, 400))["total"]
    assert significance.five_dim(f[:50], y[:50])["total"] == 0


def test_optimisers():
    r = RNG.normal(0.001, 0.02, (300, 6)) * np.array([1, 1, 1, 1, 2, 3])
    cov = np.cov(r.T)
    w = optimize.risk_parity(cov)
    share = w * (cov @ w)
    assert abs(w.sum() - 1) < 1e-9 and share.std() / share.mean() < 1e-4
    m = optimize.markowitz(r, 1000.0)
    even = np.full(6, 1 / 6)
    assert abs(m.sum() - 1) < 1e-9 and (m >= 0).all() and m @ cov @ m < even @ cov @ even
    bl = optimize.black_litterman(cov, even, np.eye(6)[:1], np.array([0.05]))
    assert bl[0] > optimize.black_litterman(cov, even, np.eye(6)[:1], np.array([-0.05]))[0]
    front = optimize.efficient_frontier(r, 4)
    assert front[0][0] <= front[-1][0] + 1e-9
    shrunk, delta = optimize.ledoit_wolf(r)
    assert 0 <= delta <= 1 and (np.linalg.eigvalsh(shrunk) > 0).all()


def test_neutralized_values_don_t_follow_the_styles(spark):
    n = 40
    f = pd.DataFrame({"ts": np.repeat([1, 2], n), "symbol": [f"s{i}" for i in range(n)] * 2, "size": RNG.normal(0, 1, 2 * n), "industry": ["a", "b"] * n})
    f["x"] = 3 * f["size"] + RNG.normal(0, 1, 2 * n)
    got = optimize.neutralize(spark.createDataFrame(f), "x", ["size"], "industry").toPandas().merge(f, on=["ts", "symbol"])
    assert got.groupby("ts").apply(lambda g: abs(np.corrcoef(g["value"], g["size"])[0, 1])).max() < 1e-9
    assert (got["r2"] > 0.5).all()


@pytest.mark.parametrize("name", list(models.MODELS))
def test_models_beat_the_mean(name):
    x = RNG.normal(0, 1, (800, 3))
    x[::7, 1] = np.nan
    y = 2 * x[:, 0] + RNG.normal(0, 0.5, 800)
    e = models.MODELS[name](x[:600], y[:600], x[600:]) - y[600:]
    assert (e**2).mean() < 0.6 * y[600:].var()


def test_walk_forward_doesn_t_see_the_future(spark):
    f = pd.DataFrame({"ts": np.repeat(np.arange(60), 4), "symbol": list("abcd") * 60, "x": RNG.normal(0, 1, 240)})
    f["label"] = f["x"] * 2
    run = lambda d: models.walk_forward(spark.createDataFrame(d), ["x"], "ridge", 20, 10, 2, 10).toPandas().sort_values(["ts", "symbol"])
    a = run(f)
    assert a["ts"].min() == 22 and a["ts"].max() == 59 and not a.duplicated(["ts", "symbol"]).any()
    b = run(f.assign(label=f["label"].where(f["ts"] < 41, 99.0)))
    same = a["ts"] < 43
    np.testing.assert_allclose(a.loc[same, "pred"], b.loc[same, "pred"])


def test_limits_block_trades(spark):
    f = pd.DataFrame({"ts": [1, 2, 3, 4], "symbol": "a", "w": [0.0, 1.0, 1.0, 0.0], "ret": [0.0, 0.1, 0.0, -0.1]})
    got = recursive.limit_blocked(spark.createDataFrame(f)).toPandas().sort_values("ts")
    assert got["held"].tolist() == [0, 0, 1, 1]


def test_selection_keeps_the_front():
    s = np.array([[1, 0], [0, 1], [0.6, 0.6], [0.1, 0.1]])
    assert [sorted(f.tolist()) for f in search.fronts(s)] == [[0, 1, 2], [3]]
    assert sorted(search.select(s, 3).tolist()) == [0, 1, 2] and len(search.select(s, 2)) == 2
    found = search.evolve(lambda pop: np.array([[g[0], -g[1]] for g in pop], float), 8, 3)
    assert len(found) == 8


def test_pool_and_proposals(spark):
    pool = search.upsert_pool(spark, None, [("a", "f", 0.5), ("b", "g", 0.9)])
    pool = search.upsert_pool(spark, pool, [("a", "f", 0.7)], most=2)
    assert {(r.key, r.dsr, r.hits) for r in pool.collect()} == {("a", 0.7, 2), ("b", 0.9, 1)}
    assert search.propose(3) == search.propose(3)


def test_stores(spark, tmp_path):
    def frame(ts, close):
        return spark.createDataFrame([("a", t, c, c, c, c, 1.0, c) for t, c in zip(ts, close, strict=True)], "symbol string, ts long, open double, high double, low double, close double, volume double, amount double")

    s = BarStore(spark, f"file://{tmp_path}/bars", 4)
    assert s.load().count() == 0
    s.upsert(frame(range(10), [10.0] * 10))
    s.upsert(frame(range(8, 12), [10.5] * 4))
    assert [r.close for r in s.load().orderBy("ts").collect()] == [10.0] * 8 + [10.5] * 4
    s.upsert(frame(range(5, 12), [2.0] * 7))
    assert s.load(["a"]).count() == 7
    f = FactorStore(spark, f"file://{tmp_path}/factors")
    fid = f.save(s.load().withColumnRenamed("close", "factor"), [1, 2], "v1", report={"ic": 0.1})
    assert f.load(fid).count() == 7 and f.listing().first().factor_id == fid


def test_codes(spark):
    got = {r.x: (r.market, r.symbol, r.is_index) for r in normalized(spark.createDataFrame([("SH600000",), ("000001.SZ",), ("600519",), ("rb2410",), ("sh000001",), ("?",), (None,)], "x string"), "x").collect()}
    assert got["SH600000"] == ("sh", "sh600000", False) and got["000001.SZ"] == ("sz", "sz000001", False) and got["600519"][0] == "sh"
    assert got["rb2410"] == ("fut", "RB2410", False) and got["sh000001"][2] and got["?"] == (None, None, False) and got[None] == (None, None, False)
