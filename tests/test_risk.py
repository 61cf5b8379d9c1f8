"""Decomposition of risk against numpy."""

import numpy as np
import pandas as pd

from barloom.operators import optimize


def test_decomposition(spark):
    rng = np.random.default_rng(11)
    rows = [(t, f"s{i}", *rng.normal(0, 1, 2)) for t in range(40) for i in range(15)]
    frame = pd.DataFrame(rows, columns=["ts", "symbol", "a", "b"])
    frame["ret"] = 0.02 * frame["a"] - 0.01 * frame["b"] + rng.normal(0, 0.01, len(frame))
    frame["w"] = np.where(frame["symbol"].isin(["s1", "s2"]), 0.5, 0.0)
    got = optimize.decompose_risk(spark.createDataFrame(frame), ["a", "b"]).toPandas().sort_values("ts")
    slopes, rest = [], []
    for _, g in frame.groupby("ts"):
        x = np.column_stack([np.ones(len(g)), g[["a", "b"]]])
        beta = np.linalg.lstsq(x, g["ret"].to_numpy(), rcond=None)[0]
        slopes.append(beta[1:])
        rest.append(pd.Series(g["ret"].to_numpy() - x @ beta, index=g["symbol"]))
    cov = optimize.ledoit_wolf(np.array(slopes))[0]
    own = pd.DataFrame(rest).var(ddof=0)
    for r in got.itertuples():
        g = frame[(frame["ts"] == r.ts) & (frame["w"] > 0)]
        x = g["w"].to_numpy() @ g[["a", "b"]].to_numpy()
        np.testing.assert_allclose([r.common, r.specific], [x @ cov @ x, (0.25 * own[["s1", "s2"]]).sum()], rtol=1e-9)
        assert 0 <= r.share <= 1
