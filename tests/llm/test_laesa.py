"""Product codes against a plain version without bounds."""

import hashlib
import math

import numpy as np
import pytest
from duck import compare, connect

from barloom.llm import laesa, queries

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


def plain(rows, parts=16, entries=64, rounds=2):
    """rows of (id, vector, label) -> {id: (code, error, label_error)}, sha256."""
    kept = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // parts
    books = [[r[1][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(parts)]

    def find(v, p):
        part = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(find(v, p)[1], []).append(v[p * width : (p + 1) * width])
            for j, g in groups.items():
                books[p][j] = [sum(c) // len(c) for c in zip(*g, strict=True)]
    out, by = {}, {}
    for i, v, c in kept:
        found = [find(v, p) for p in range(parts)]
        out[i] = ("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), c)
        by[c] = by.get(c, 0) + out[i][1]
    flat = ",".join(str(x) for p in books for e in p for x in e)
    return {i: (a, b, by[c]) for i, (a, b, c) in out.items()}, hashlib.sha256(flat.encode()).hexdigest()


def test_nearest_is_exact():
    draw = np.random.default_rng(4)
    for scale in (3, 1000, laesa.LIMIT):
        for width in (1, 4, 9):
            e = draw.integers(-scale, scale, (64, width))
            x = np.concatenate([draw.integers(-scale, scale, (500, width)), np.repeat(e[:9], 3, 0), (e[:40] + e[1:41]) // 2])
            pivots = laesa.far_apart(e, 4)
            e2 = draw.integers(-scale, scale, (64, width))
            e2[40:44] = e2[:4]  # ties
            index, best, done = laesa.nearest(x, laesa.distances(x, pivots).astype(np.float32), e2, pivots)
            d = ((x[:, None] - e2[None]) ** 2).sum(2)
            assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
            assert done < 0.8 * d.size


def test_whole_query(spark):
    got = queries.QUERIES["op12_laesa_codes"](spark, SF).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, sha = plain(rows)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and {r.codebooks_sha256 for r in got} == {sha}
    compare(spark, connect(SF), queries.QUERIES["op12_laesa_codes"], queries.ORACLES["op12_laesa_codes"], SF)
    found = laesa.product_codes(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert found.groupBy().max("evaluated").collect()[0][0] < 0.5 * 16 * 64


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, label int, x int, near double")


def test_odd_rows(spark, monkeypatch):
    draw = np.random.default_rng(7)
    good = [(int(i), draw.normal(size=32).tolist(), int(i) % 3 or None) for i in range(90)]
    bad = [(200, None, 1), (201, [], 1), (202, [None] + [0.0] * 31, 1), (203, [NAN] * 32, 1), (204, [-INF] * 32, 1), (205, [1.0] * 31, 1)]
    want, sha = plain(good)
    df = frame(spark, bad + good)
    for labels in (laesa.BROADCAST_LABELS, 1):
        monkeypatch.setattr(laesa.with_label_error, "__defaults__", (labels,))
        got = laesa.product_codes(df).collect()
        assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and {r.codebooks_sha256 for r in got} == {sha}
    assert laesa.product_codes(df.limit(0)).count() == 0 and laesa.product_codes(frame(spark, bad[:5])).count() == 0
    few = laesa.product_codes(frame(spark, [*good[:3], good[0], (None, [1e30] * 32, 5)])).collect()
    assert len(few) == 5 and all(r.error == 0 for r in few) and {len(r.code) for r in few} == {32}
    odd = laesa.product_codes(frame(spark, [(i, v[:5], c) for i, v, c in good])).collect()  # 5 components in 16 parts
    assert len(odd) == 90 and all(r.code[10:] == "00" * 11 for r in odd)
    dotted = df.withColumnRenamed("vec_id", "a.b").withColumnRenamed("embedding", "v.x").withColumnRenamed("label", "l.x")
    assert laesa.product_codes(dotted, "a.b", "v.x", "l.x").count() == 90


def test_too_many_entries(spark):
    with pytest.raises(ValueError, match="hex digits"):
        laesa.product_codes(frame(spark, [(1, [1.0] * 16, 1)]), entries=300)
