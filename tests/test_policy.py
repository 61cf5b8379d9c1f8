"""The policy search: valid formulas only, better than chance, resumed as if never cut off, and its pool."""

import numpy as np
import pytest

from barloom.operators import policy
from barloom.plans.formula_a import Vocabulary, depth_after
from barloom.sources import bars
from barloom.sources.log import Log

VOCAB = Vocabulary(("RET", "RET5", "RSI14", "VOL_Z", "HL_RANGE"), ("ADD", "SUB", "MUL", "NEG", "ABS", "SIGN", "TS_ZSCORE_20", "DELTA", "EMA_5"))
GOOD = {VOCAB.names.index("RSI14"), VOCAB.names.index("DELTA")}


def liking(batch):
    """Likes two tokens, most of all next to each other."""
    return [sum(t in GOOD for t in f) + 2.0 * any((a, b) == tuple(sorted(GOOD)) for a, b in zip(f, f[1:], strict=False)) for f in batch]


def test_better_than_chance():
    blind = policy.PolicySearch(liking, VOCAB, policy.Settings(length=6, rate=0.0, seed=1))
    seen = policy.PolicySearch(liking, VOCAB, policy.Settings(length=6, seed=1))
    for s in (blind, seen):
        s.run(60)
    assert np.mean(seen.state.history[-10:]) > np.mean(blind.state.history) + 1.0
    assert all(depth_after(list(t), VOCAB) == 1 and len(t) == 6 for _, t in seen.pool.best()) and len(seen.pool.heap) == 20


def test_entropy_keeps_the_policy_open():
    sure = policy.PolicySearch(liking, VOCAB, policy.Settings(length=4, rate=2.0, entropy=0.0, replay=0))
    wide = policy.PolicySearch(liking, VOCAB, policy.Settings(length=4, rate=2.0, entropy=0.5, replay=0))
    for s in (sure, wide):
        s.run(80)
    entropy = lambda s: np.mean([-(p * np.log(p + 1e-12)).sum() for p in (s.chances(list(t[:k]))[2] for _, t in s.pool.best()[:5] for k in range(3))])
    assert entropy(wide) > entropy(sure)


def test_restart_keeps_the_pool():
    s = policy.PolicySearch(lambda b: [1.0] * len(b), VOCAB, policy.Settings(length=4, patience=3, restarts=2))
    s.run(12)
    assert s.state.restarts == 2 and s.state.best == 1.0 and len(s.pool.heap) == 20


def test_resumed_is_the_same(spark, tmp_path):
    c = policy.Settings(length=5, batch=6, patience=2, seed=3)
    whole = policy.PolicySearch(liking, VOCAB, c).run(9)
    calls = []

    def dies(batch):
        calls.append(1)
        if len(calls) == 5:
            raise KeyboardInterrupt
        return liking(batch)

    log = lambda: Log(spark, f"file://{tmp_path}/log")
    with pytest.raises(KeyboardInterrupt):
        policy.PolicySearch(dies, VOCAB, c, log()).run(9)
    again = policy.PolicySearch(liking, VOCAB, c, log())
    assert again.state.step == 4 and again.run(9) == whole
    with pytest.raises(ValueError, match="other settings"):
        policy.PolicySearch(liking, VOCAB, policy.Settings(length=6), log())


def test_pool():
    p = policy.Pool(2)
    assert [p.add(*x) for x in ((1.0, [1]), (2.0, [2]), (0.5, [3]), (1.5, [1]), (1.2, [1]), (3.0, [4]))] == [True, True, False, True, False, True]
    assert p.best() == [(3.0, (4,)), (2.0, (2,))]


def test_scores_of_bars(spark):
    b = bars.bars_brand(spark, "/root/testdata/sf0.01")
    enc = Vocabulary.default().encode
    got = policy.spark_score(b, per_year=52)([enc(["RET5"]), enc(["RET5", "NEG"]), enc(["RET", "ADD"])])
    assert got[2] == -5.0 and got[0] != got[1] and all(np.isfinite(got))
