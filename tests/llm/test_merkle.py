"""The manifest against a plain Merkle tree and proof."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from duck import compare, connect

from barloom.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def fold(d, steps):
    for odd, s in steps:
        d = h(d) if s is None else h(s, d) if odd else h(d, s)
    return d


def plain(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> one result row each, sorted."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in by[k]])
    top = levels([trees[k][-1][0] for k in order]) if order else []
    out = []
    for t, k in enumerate(order):
        for i, r in enumerate(by[k]):
            steps = siblings(trees[k], i) + siblings(top, t)
            changed = r if r[0] is None or r[3] is None or zlib.crc32(str(r[0]).encode()) % 7 else (*r[:3], r[3] + 1, r[4])
            folded = fold(leaf(changed), steps)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[k][-1][0], root, h(*(s for _, s in steps if s)), folded, folded == root))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=repr)


def test_addresses():
    for n in range(1, 12):
        at = np.concatenate([merkle.address(n, d, np.arange(1 << d)) for d in range(n)])
        assert sorted(at.tolist()) == list(range((1 << n) - 1))
    # a tree of four levels: the top two first, then each bottom tree of two in one run
    assert merkle.address(4, 0, [0]).tolist() == [0] and merkle.address(4, 1, [0, 1]).tolist() == [1, 2]
    assert merkle.address(4, 2, [0, 1, 2, 3]).tolist() == [3, 6, 9, 12] and merkle.address(4, 3, range(8)).tolist() == [4, 5, 7, 8, 10, 11, 13, 14]
    assert merkle.layers(37) == (10, 9, 9, 9) and merkle.layers(0) == (0,) and all(sum(merkle.layers(x, m)) == x and max(merkle.layers(x, m)) <= m for x in range(60) for m in (1, 3, 10))


def test_whole_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = queries.QUERIES["op13_merkle_manifest"](spark, SF)
    assert result(got) == plain([tuple(r) for r in docs.collect()])
    compare(spark, connect(SF), queries.QUERIES["op13_merkle_manifest"], queries.ORACLES["op13_merkle_manifest"], SF)


@pytest.mark.parametrize("block", [1, 2, 3, 10])
def test_sizes_of_trees(spark, block):
    draw = random.Random(block)
    rows = [(i, f"s{i % 3}" if i % 5 else None, lang, draw.choice([None, i]), draw.choice([None, "", "é" * i, "x"])) for lang, n in ((None, 1), ("", 2), ("Z", 3), ("a", 17), ("é", 31), ("b", 8)) for i in range(n)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, idx int")
    got = merkle.Manifest(df, claimed=merkle.tampered(), block=block).proofs(paths=True)
    assert result(got) == plain(rows)
    assert all(h(*r.siblings) == r.proof_sha256 for r in got.collect())


def test_odd_rows(spark):
    rows = [(1, None, None, None, None)] * 3 + [(None, "s", None, 5, "x" * 300_000), (None, "s", None, 5, "y"), (7, "s", None, 2, "")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string")
    assert result(merkle.Manifest(df, claimed=merkle.tampered()).proofs()) == plain(rows)
    assert merkle.Manifest(df.limit(0)).proofs().count() == 0 and merkle.Manifest(df.limit(0)).root() is None
    one = merkle.Manifest(df.limit(1)).proofs().collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h()
    named = df.select(*[df[c].alias(f"{c}.x") for c in df.columns])
    other = merkle.Manifest(named, "doc_id.x", "lang.x", tuple(f"{c}.x" for c in merkle.COLUMNS))
    assert other.root() == merkle.Manifest(df).root()
    text_ids = merkle.Manifest(df.selectExpr("cast(doc_id as string) doc_id", "source", "lang", "n_chars", "text"))
    assert text_ids.root() == merkle.Manifest(df).root()


def test_any_change_is_seen(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(40)]
    root = lambda r: merkle.Manifest(spark.createDataFrame(r, "doc_id long, source string, lang string, n_chars long, text string")).root()
    base = root(rows)
    assert root(rows[::-1]) == base
    assert base not in {root([*rows[:9], (9, "s", "en", 9, "other"), *rows[10:]]), root(rows[:-1]), root([*rows, rows[3]])}
