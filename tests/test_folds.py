"""Folds are read in chunks from one copy of the rows: same results as all at once, and nothing is copied per fold."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import models
from barloom.sources import timed


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(900, 3))
    x[draw.random(x.shape) < 0.1] = np.nan
    return x[:700], np.where(np.isfinite(x[:700, 0]), x[:700, 0], 0) + 0.3 * draw.normal(size=700), x[700:]


@pytest.mark.parametrize("name", list(models.MODELS))
def test_chunks_give_what_all_rows_at_once_give(name, rows, monkeypatch):
    want = models.MODELS[name](*rows)
    monkeypatch.setattr(models, "CHUNK", 101)
    monkeypatch.setattr(models, "KEEP", 3000)
    np.testing.assert_allclose(models.MODELS[name](*rows), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", ["ridge", "mlp", "stumps", "forest"])
def test_no_array_as_long_as_the_rows(name, monkeypatch):
    """Models see chunks only, so what they allocate is bounded whatever the number of rows."""
    import tracemalloc

    draw, n = np.random.default_rng(0), 600_000
    x, y = draw.normal(size=(n, 3)), draw.normal(size=n)
    monkeypatch.setattr(models, "KEEP", 1 << 20)
    fit = {"mlp": lambda r: models.mlp.fit(r, rounds=2), "forest": lambda r: models.forest.fit(r, n=2), "stumps": lambda r: models.stumps.fit(r, rounds=5)}.get(name, models.MODELS[name].fit)
    tracemalloc.start()
    fit(models.Rows.of(x, y))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * 2**20  # all rows with flags and a one: 34 MB; a layer of 16: 77 MB; ranks of a pass alone: 32 MB


def test_values_of_ranks_without_holding_them():
    draw = np.random.default_rng(4)
    v = np.concatenate([draw.normal(size=5000), np.round(draw.normal(size=5000), 1), [0.0, -0.0, 1e300, -1e300, 5e-324]])
    at = np.array([0, 1, 17, 5000, 9000, len(v) - 1])
    np.testing.assert_array_equal(models._ranked(lambda: iter(np.array_split(v, 7)), at), np.sort(v)[at])


def test_draws_in_parts_are_those_of_one_call():
    for n in (3, 1000, 1 << 21):
        got = models._drawn(np.random.default_rng(7), n)
        np.testing.assert_array_equal(got, np.bincount(np.random.default_rng(7).integers(0, n, n), minlength=n))
    a, b = np.random.default_rng(1), np.random.default_rng(1)
    a.permutation(5), b.permutation(5)
    np.testing.assert_array_equal(models._ahead(a, 11).random(11), b.random(11))
    np.testing.assert_array_equal(a.permutation(9), b.permutation(9))


def test_folds_against_a_loop(spark, monkeypatch):
    """Files of small row groups, more files than are held open, missing labels and times with unlike numbers of rows."""
    monkeypatch.setattr(timed, "GROUP_BYTES", 2000)
    monkeypatch.setattr(timed, "OPEN", 2)
    draw = np.random.default_rng(8)
    f = pd.DataFrame([(t * 60, f"s{i:03d}", *draw.normal(size=3)) for t in range(47) for i in range(draw.integers(1, 90))], columns=["ts", "symbol", "a", "b", "label"])
    f.loc[draw.random(len(f)) < 0.1, "label"] = np.nan
    f.loc[draw.random(len(f)) < 0.1, "a"] = np.nan
    made = models.walk_forward(spark.createDataFrame(f.sample(frac=1, random_state=1)), ["a", "b"], "bagging", 20, 10, 2, 10)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan  # rows aren't sent to folds
    want = []
    for k in range(3):
        a, b = (f[(f["ts"] >= lo * 60) & (f["ts"] < hi * 60)] for lo, hi in ((10 * k, 10 * k + 20), (10 * k + 22, 10 * k + 32)))
        a = a[a["label"].notna()].sort_values(["ts", "symbol"])
        b = b.assign(pred=models.bagged(models.ridge)(a[["a", "b"]].to_numpy(), a["label"].to_numpy(), b[["a", "b"]].to_numpy()), fold=k)
        want.append(b[["ts", "symbol", "pred", "fold"]])
    order = ["ts", "symbol"]
    pd.testing.assert_frame_equal(made.toPandas().sort_values(order, ignore_index=True), pd.concat(want).sort_values(order, ignore_index=True), check_dtype=False)


def test_a_table_without_folds_gives_none(spark):
    table = spark.createDataFrame([(1, "a", 0.5, 1.0)], "ts long, symbol string, x double, label double")
    scores, weights = models.combine_ml(table, ["x"])
    assert scores.count() == weights.count() == models.walk_forward(table.where("false"), ["x"]).count() == 0
