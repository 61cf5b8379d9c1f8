"""The odd-sketch screen of near-duplicates must not lose links between long documents."""

import numpy as np
import pytest

from barloom.llm import neardup


def pairs(rng, union: int, j: float, trials: int):
    """n, samples and differing bits of pairs of equal size and similarity j."""
    docs = []
    for _ in range(trials):
        h = rng.integers(0, 1 << 64, union, np.uint64)
        own = int(union * (1 - j) / 2)
        docs += [np.sort(h[own:]), np.sort(np.concatenate([h[:own], h[2 * own :]]))]
    s = neardup.signatures(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    n = np.array([len(d) for d in docs]).reshape(-1, 2).T
    return n, s["samples"].reshape(-1, 2).T, s["sketch"].reshape(trials, 2, -1)


@pytest.mark.parametrize(("union", "trials"), [(300, 300), (5_000, 300), (20_000, 200), (50_000, 200), (100_000, 120), (200_000, 40)])
def test_screen_keeps_links(monkeypatch, union, trials):
    monkeypatch.setattr(neardup, "SAMPLES", neardup.ROWS)
    for j in (0.8, 0.82):
        n, samples, sketch = pairs(np.random.default_rng(union), union, j, trials)
        u = np.bitwise_count(sketch[:, 0] ^ sketch[:, 1]).sum(1)
        assert neardup.room(n, samples, u.astype(float), 80).all()


def test_screen_still_tells_and_both_forms_agree(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLES", neardup.ROWS)
    for union, j in ((3_000, 0.5), (3_000, 0.75), (50_000, 0.5)):
        n, samples, sketch = pairs(np.random.default_rng(9), union, j, 40)
        want = neardup.room(n, samples, np.bitwise_count(sketch[:, 0] ^ sketch[:, 1]).sum(1).astype(float), 80)
        assert want.any() == (union > 8_192 or j == 0.75)
        rows = [(i, *((int(n[x, i]), int(samples[x, i]), sketch[i, x].view(np.int64).tolist()) for x in (0, 1))) for i in range(40)]
        fact = "struct<n:bigint,samples:bigint,sketch:array<bigint>>"
        df = spark.createDataFrame(rows, f"i long, a {fact}, b {fact}")
        got = {r.i for r in df.where(neardup.likely("a", "b", 80)).select("i").collect()}
        assert got == set(np.flatnonzero(want).tolist())
