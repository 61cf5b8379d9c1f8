"""The reward against numpy, written from its definition over a matrix of symbols and bars."""

import math

import numpy as np
import pandas as pd
import pytest

from barloom.operators import reward

DAY = 86400


def sortino(x, ppy):
    neg = x[x < 0]
    return float(np.clip(x.mean() / max(neg.std() if neg.size else 0.0, max(max(x.std(), 1e-8) * 0.2, 1e-8)) * math.sqrt(ppy), -20, 20))


def ics(f, y):
    out = [float(np.mean((a - a.mean()) * (b - b.mean())) / (a.std() * b.std() + 1e-8)) for a, b in zip(f, y, strict=True) if a.std() >= 1e-6 and b.std() >= 1e-6]
    return out


def score(f, y, pos, turn, mode, ppy, cost):
    n, t = f.shape
    pnl = pos * y - turn * cost
    flat = pnl.ravel()
    cum = flat.cumsum()
    c = {"ret": flat.mean() * ppy, "sortino": sortino(flat, ppy), "calmar": float(np.clip(flat.mean() * ppy / max((np.maximum.accumulate(cum) - cum).max(), 1e-8), -10, 10))}
    ic = ics(f, y) if t >= 10 else []
    c["ic"] = float(np.clip(np.mean(ic) / (np.std(ic) + 1e-6), -3, 3)) if ic else 0.0
    runs = []
    for row in pos:
        last = 0
        for p in row:
            if p and p == last:
                runs[-1] += 1
            elif p:
                runs.append(1)
            last = p
    q = len(runs) / max(n * t / 12, 1)
    c["freq"] = -2 if q <= 0 else -2 + q / 0.05 if q < 0.05 else -1 + (q - 0.05) / 0.45 if q < 0.5 else math.exp(-0.5 * math.log2(q) ** 2) if q <= 2 else 0.5 - (q - 2) / 6 * 1.5 if q <= 8 else -2
    c["freq"] += min(0.3, math.log(max(np.mean(runs), 1)) / math.log(30) * 0.3) if runs else 0
    held = np.abs(pos).mean()
    more = (held / 0.1 - 1) * 2 if held < 0.1 else 0
    side = max((pos > 0.05).mean(), (pos < -0.05).mean())
    more += -2 * (side - 0.85) / 0.15 if side > 0.85 else -0.5 * (side - 0.7) / 0.15 if side > 0.7 else 0
    if t >= 20:
        a, b = sortino(pnl[:, : t // 2].ravel(), ppy), sortino(pnl[:, t // 2 :].ravel(), ppy)
        more += 0.5 if a > 0 and b > 0 else -1 if a * b < 0 else 0
    c["stress"] = float(np.clip(sortino((pos * y - 2 * turn * cost).ravel(), ppy), -5, 5))
    own = [sortino(x, ppy) for x in pnl]
    trades = [(np.abs(np.diff(np.abs(x))) > 0.1).sum() for x in pos]
    least = max(5, t // 100)
    on = [s for s, k in zip(own, trades, strict=True) if k >= least]
    share = sum(s > 0 for s in on) / len(on) if on else 0
    c["agree"] = -3 if (n - len(on)) / n > 0.4 else -2 if min(own) < -2 else -3 if not on else (share - 0.6) / (0.6 if share < 0.6 else 0.4) + (share == 1) * 0.5
    rev = []
    for x in f:
        a, b = x[:-1], x[1:]
        k = float(np.mean((a - a.mean()) * (b - b.mean())) / (a.std() * b.std() + 1e-8)) if a.std() > 1e-6 and b.std() > 1e-6 else 0.0
        rev.append(float(np.clip(1 - abs(k) + (0.5 if k < 0 else 0), -1, 2)))
    c["reversal"] = np.mean(rev)
    c["symmetry"] = float(np.clip(1 - 2 * (abs((pos > 0).mean() - 0.5) + abs((pos < 0).mean() - 0.5)), -1, 1))
    if n == 1:
        w = {"ftmo": [0.8, 0.05, 0.1, 0.03, 0.02], "forex": [0.25, 0.05, 0.05, 0.25, 0.05], "plain": [0.6, 0.15, 0.1, 0.1, 0.05]}[mode]
        extra = 0.2 * c["reversal"] + 0.15 * c["symmetry"] if mode == "forex" else 0
    else:
        w = [0.75, 0.05, 0.1, 0.02, 0.03] if mode == "ftmo" else [0.6, 0.1, 0.05, 0.1, 0.05]
        extra = 0.03 * c["agree"] + 0.02 * c["stress"] if mode == "ftmo" else 0.05 * (c["agree"] + c["stress"])
    return sum(a * c[k] for a, k in zip(w, ("ret", "sortino", "calmar", "ic", "freq"), strict=True)) + extra + more, c["sortino"]


def gate(x, ic):
    return x * (1.15 if ic > 0.01 else 0.75 if ic < -0.01 else 1)


def plain(f, y, mode, ppy, cost=0.0003, k=5, gap=20):
    f, y = np.nan_to_num(f), np.nan_to_num(y)
    t, size = f.shape[1], f.shape[1] // k
    folds = []
    if size * k + gap * (k - 1) > t:
        gap = max(0, (t - size * k) // k)
    for i in range(1, k):
        folds.append((slice((i - 1) * size, i * size), slice(i * size + gap, min((i + 1) * size + gap, t))))
    if size < 2:
        folds = [(slice(0, t), slice(0, t))]
    pos = np.sign(f)
    turn = np.abs(np.diff(pos, axis=1, prepend=0))
    out = []
    for a, b in folds:
        ic = [float(np.mean(ics(f[:, s], y[:, s]) or [0])) for s in (a, b)]
        train = score(f[:, a], y[:, a], pos[:, a], turn[:, a], mode, ppy, cost)[0] - np.clip((turn[:, a].mean() - 0.2) * 3, 0, 3)
        test, s = score(f[:, b], y[:, b], pos[:, b], turn[:, b], mode, ppy, cost)
        test *= max(0.1, 0.5 + s * 0.4) if s <= 0 else min(1.2, 1 + s * 0.1)
        out.append((gate(train, ic[0]), gate(test, ic[1]), ic[0]))
    return out


def population(seed, n, t, kinds=5):
    draw = np.random.default_rng(seed)
    y = draw.normal(0, 0.01, (n, t))
    noise = lambda: draw.normal(size=(n, t))
    made = {
        "good": y * 60 + noise(),
        "slow": noise().cumsum(1) / 5,
        "rare": np.where(draw.random((n, t)) < 0.04, noise(), 0.0),
        "up": np.abs(noise()) + (draw.random((n, t)) < 0.1) * -2.0,
        "gaps": np.where(draw.random((n, t)) < 0.1, np.nan, -y * 30 + noise()),
    }
    return dict(list(made.items())[:kinds]), y


def frame(spark, made, y, step=DAY):
    rows = [(name, f"s{i:02d}", int(j * step), float(v), float(y[i, j])) for name, f in made.items() for (i, j), v in np.ndenumerate(f)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["formula", "symbol", "ts", "f", "ret"])).selectExpr("formula", "symbol", "ts", "CASE WHEN isnan(f) THEN null ELSE f END AS f", "ret")


@pytest.mark.parametrize(("n", "t", "mode"), [(7, 230, "ftmo"), (7, 333, "plain"), (3, 90, "forex"), (1, 260, "ftmo"), (1, 300, "forex"), (1, 131, "plain"), (2, 9, "ftmo"), (2, 47, "plain")])
def test_against_numpy(spark, n, t, mode):
    made, y = population(n * t, n, t)
    panel = frame(spark, made, y)
    got = {(r.formula, r.fold): r for r in reward.fold_scores(panel, mode=mode).collect()}
    ppy = reward.annualisation(panel).collect()[0].per_year
    assert ppy == max(10, round(t / ((t - 1) / 365.25))) and len(got) == len(made) * (4 if t >= 10 else 1)
    for name, f in made.items():
        for k, want in enumerate(plain(f, y, mode, ppy)):
            r = got[(name, k + 1)]
            assert (r.train_score, r.valid_score, r.mean_ic) == pytest.approx(want, rel=1e-7, abs=1e-7), (name, k)
    whole = {r.formula: r for r in reward.rewards(panel, mode=mode).collect()}
    assert whole["good"].reward == pytest.approx(np.mean([x[0] for x in plain(made["good"], y, mode, ppy)]))
    if n == 7:
        assert whole["good"].reward > max(whole[k].reward for k in made if k != "good")


def test_flat_and_missing_factors(spark):
    made, y = population(1, 2, 60, 1)
    made |= {"flat": np.full((2, 60), 3.0), "none": np.full((2, 60), np.nan)}
    got = {r.formula: (r.reward, r.valid_reward) for r in reward.rewards(frame(spark, made, y)).collect()}
    assert got["flat"] == (-2.0, -2.0) and got["none"] == (-5.0, -5.0) and got["good"] != (-2.0, -2.0)
    with pytest.raises(ValueError, match="no such mode"):
        reward.fold_scores(frame(spark, made, y), mode="other")


def test_annualisation(spark):
    rows = [("a", i * 3600) for i in range(100)] + [("b", i * 7200) for i in range(50)] + [("c", 5)]
    df = spark.createDataFrame(rows, "symbol string, ts long")
    own = sorted([round(100 / (99 * 3600 / (365.25 * 86400))), round(50 / (49 * 7200 / (365.25 * 86400)))])
    assert reward.annualisation(df).collect()[0].per_year == own[1]
    assert reward.annualisation(df.where("symbol = 'c'")).collect()[0].per_year == 6240
    assert reward.annualisation(spark.createDataFrame([("a", 0), ("a", 1)], "symbol string, ts long")).collect()[0].per_year == 600_000
