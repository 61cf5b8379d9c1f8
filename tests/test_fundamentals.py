"""Fundamentals against pandas, with calendar dates."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import fundamentals


def reports(ends, seed=0, symbols=("a", "b", "c")):
    draw = np.random.default_rng(seed)
    cols = ["revenue", "profit", "pe", "pb", "roe", "gross_margin", "debt_ratio"]
    rows = [(s, int(pd.Timestamp(d).timestamp()), *draw.normal(1, 1, len(cols))) for s in symbols for d in ends]
    return pd.DataFrame(rows, columns=["symbol", "report_date", *cols])


def growth(f, column):
    """Of each report: over the nearest of the five before that ends on the same month and day."""
    out = {}
    for s, g in f.sort_values("report_date").groupby("symbol"):
        days = [pd.Timestamp(x, unit="s") for x in g["report_date"]]
        key = [(d.month, 28 if (d.month, d.day) == (2, 29) else d.day) for d in days]
        values = g[column].tolist()
        for i in range(len(g)):
            same = [j for j in range(max(0, i - 5), i) if key[j] == key[i]]
            ok = same and pd.notna(values[same[-1]]) and abs(values[same[-1]]) > 1e-9 and pd.notna(values[i])
            out[(s, g["report_date"].iloc[i])] = values[i] / values[same[-1]] - 1 if ok else None
    return out


@pytest.mark.parametrize("ends", [pd.date_range("2019-03-31", "2024-12-31", freq="QE"), ["2020-02-29", "2020-08-31", "2021-02-28", "2021-08-31", "2022-02-28", "2024-02-29"], ["2020-03-31", "2020-12-31", "2021-03-31", "2022-12-31", "2023-12-31"]])
def test_growth_on_calendar_dates(spark, ends):
    f = reports(ends)
    f.loc[1, "revenue"], f.loc[2, "profit"] = 0.0, None
    got = fundamentals.growth(spark.createDataFrame(f)).toPandas()
    want = {c: growth(f, c) for c in ("revenue", "profit")}
    known = 0
    for r in got.itertuples():
        for c, x in (("revenue", r.rev_yoy), ("profit", r.profit_yoy)):
            w = want[c][(r.symbol, r.report_date)]
            known += w is not None
            assert (pd.isna(x) and w is None) or x == pytest.approx(w, abs=1e-6)
    assert known > len(f) / 2 and len(got) == len(f)


def test_factors_of_the_latest_report(spark):
    f = reports(pd.date_range("2020-03-31", "2022-12-31", freq="QE"), 3, [f"s{i}" for i in range(9)])
    got = {(r.symbol, r.factor): r.value for r in fundamentals.factors(spark.createDataFrame(f)).collect()}
    last = f.sort_values("report_date").groupby("symbol").tail(1).set_index("symbol")
    g = {c: growth(f, c) for c in ("revenue", "profit")}
    made = {
        "ep": last["pe"].where(last["pe"] > 0).rdiv(1), "bp": last["pb"].where(last["pb"] > 0).rdiv(1), "roe": last["roe"], "gross": last["gross_margin"], "debt": last["debt_ratio"],
        **{n: pd.Series({s: g[c][(s, r.report_date)] for s, r in last.iterrows()}, dtype=float) for n, c in (("rev_yoy", "revenue"), ("profit_yoy", "profit"))},
    }
    n = 0
    for name, x in made.items():
        x = x.dropna()
        mad = (x - x.median()).abs().median() * 1.4826 + 1e-9
        for s, v in ((x - x.median()) / (3 * mad)).clip(-3, 3).items():
            assert got[(s, name)] == pytest.approx(v, abs=1e-6)
            n += 1
    assert n == len(got) > 50


def test_as_of(spark):
    day = 86400
    bars = [("a", i * day, 10.0 + i, None, None) for i in range(0, 200, 10)]
    reps = [("a", None, None, d * day, v) for d, v in ((5, 0.1), (50, 0.2), (100, 0.3))]
    got = fundamentals.as_of(spark.createDataFrame(bars + reps, "symbol string, ts long, close double, report_date long, roe double")).toPandas().sort_values("ts")
    want = [max(((d, v) for d, v in ((5, 0.1), (50, 0.2), (100, 0.3)) if d + 30 <= t // day), default=(0, None))[1] for t in got["ts"]]
    assert [None if pd.isna(x) else x for x in got["roe"]] == want
