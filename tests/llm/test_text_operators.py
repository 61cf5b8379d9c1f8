"""Text operators against their plain versions, on real rows and on awkward ones."""

import functools
import hashlib
import itertools
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from duck import compare, connect

from barloom.llm import decontaminate, kernel, licenses, linededup, neardup, packing, pii, quality, queries, rules, tokens
from barloom.llm.groups import components
from barloom.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"w{i % 997}" for i in range(600))
TEXTS = [None, "", "   \n\t ", "word", "One two THREE", BASE, BASE, BASE.upper(), BASE + " extra", BASE.replace("ten", "zehn"), "a " * 500, LONG, LONG + " tail", "é ü ñ " * 30,
         "mail a.b@c.example.com ip 10.0.0.300 1.2.3.4.5 +1 (705) 555-0953 4111111111111111 4111111111111112", "x" * 70_000, "line one here is long enough\nline one here is long enough\n\nline one here is long enough"]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns whose names the operators use too, and one row twice."""
    rows = [(i, t, "en", "s", 0, i, True, "k", 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, bucket string, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)


def test_near_duplicates(spark, odd):
    want = brute.near_duplicates(dict(enumerate(TEXTS)), 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(odd).collect()}
    assert got == want and len(set(c for _, c in want.values())) < len(TEXTS)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_of_real_rows(spark, docs):
    want = brute.near_duplicates({r.doc_id: r.text for r in docs.collect()}, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_near_duplicates"](spark, SF).collect()} == want


def test_near_duplicate_families(spark):
    """Chains and a family of variants at about the threshold: components need every link."""
    rng = np.random.default_rng(1)
    seed = [f"s{i}" for i in range(60)]
    texts = {}
    for i in range(80):
        w = list(seed)
        for k in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            w[k] = f"x{rng.integers(30)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, k=4).collect()}
    assert got == brute.near_duplicates(texts, 4)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 450)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and {n for e in edges for n in e if e[0] != e[1]} == set(got)


def test_line_dedup(spark, odd):
    out = linededup.dedup_lines(odd, removed_col="gone").collect()
    want = brute.removed_lines(dict(enumerate(TEXTS)))
    assert {r.doc_id: r.gone or [] for r in out} == want and want[16] == [1, 3]
    for r in out:
        assert r.text == (TEXTS[r.doc_id] if not r.gone else "\n".join(x for k, x in enumerate(TEXTS[r.doc_id].split("\n")) if k not in r.gone))


def test_line_dedup_of_real_rows(spark, docs):
    got = {r.doc_id: [int(x) for x in r.removed_lines.split(",") if x] for r in queries.QUERIES["op9_line_dedup"](spark, SF).collect()}
    assert got == brute.removed_lines({r.doc_id: r.text for r in docs.collect()})


def test_fuzzy_lines(spark):
    long = " ".join(f"word{i}" for i in range(120))
    texts = {0: long, 1: long.replace("word7 ", "word7x "), 2: long.upper() + "!!", 3: " ".join(f"other{i}" for i in range(120))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.gone or [] for r in linededup.dedup_lines(df, removed_col="gone").collect()} == brute.removed_lines(texts)


def test_decontamination(spark, odd):
    items = {1: BASE, 2: "seven eight", 3: None, 4: "", 5: "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {i: brute.contamination(t, items) for i, t in enumerate(TEXTS)}
    for part in (8 << 20, 60):
        for r in decontaminate.decontaminate(odd, bench, part_bytes=part).collect():
            w = want[r.doc_id]
            assert (r.n_words, r.n_hit, len(r.item_ids), decontaminate.digest_of(r.item_ids), r.contaminated) == tuple(w.values()), r.doc_id
        clean = decontaminate.keep_clean(odd, bench, part_bytes=part)
        assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w["contaminated"]}
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_rule_counts(spark, odd):
    model = rules.fit(["good words " * 30, "bad ### " * 30] * 20, [1, 0] * 20)
    for r in rules.judge(odd, model).collect():
        want = brute.rule_counts(TEXTS[r.doc_id])
        assert {c: r[c] for c in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed and r.kept == (not failed and r.score >= 0.5)
    assert rules.fit([], []).bias == 0


def test_rules_tell_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.1").collect()}
    rest = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([got[r.doc_id].kept for r in rest if r.quality == 0]) < 0.02
    assert np.mean([got[r.doc_id].kept or got[r.doc_id].base_failed for r in rest if r.quality == 1]) > 0.97


def test_quality(spark, odd):
    got = queries.QUERIES["op6_quality"](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id")
    both = labels.join(got)
    rest = both[both["held_out"]]
    assert (rest["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rest.index]).all()
    assert (rest["predicted"] == rest["quality"]).mean() > 0.98 and got["score"].between(0, 1).all()
    model = quality.fit(["Good line here.\nAnother one.", "BAD!! | | |\nBAD!!"] * 10, [1, 0] * 10)
    scores = quality.score(odd, model)
    assert scores.count() == len(TEXTS) + 1 and scores.where("score between 0 and 1").count() == len(TEXTS) + 1
    assert quality.keep_good(odd, model).columns == odd.columns
    assert all(len(r.good) == (TEXTS[r.doc_id] or "").count("\n") + 1 for r in quality.line_labels(odd, model).collect())
    assert quality.score(odd.limit(0), quality.fit([], [])).count() == 0


def test_forward_backward_against_all_paths():
    u, a = np.array([0.3, -1.0, 2.0, 0.5]), np.array([[0.2, -0.4], [0.1, 0.7]])
    good, trans, log_z = quality.chains(u, np.array([0, 4]), a)
    paths = [(b >> 3 & 1, b >> 2 & 1, b >> 1 & 1, b & 1) for b in range(16)]
    w = np.array([np.exp(sum(u[i] * y for i, y in enumerate(p)) + sum(a[x, y] for x, y in zip(p, p[1:], strict=False))) for p in paths])
    np.testing.assert_allclose(good, [sum(w[i] for i, p in enumerate(paths) if p[k]) / w.sum() for k in range(4)])
    assert abs(np.log(w.sum()) - log_z) < 1e-9 and abs(trans.sum() - 3) < 1e-9


def test_pii(spark, odd, docs):
    crf = pii.fit(pii.labelled_rows())
    for t in [*TEXTS, *(r.text for r in docs.collect())]:
        assert pii.base_spans(t or "") == brute.base_spans(t)
    held = pii.labelled_rows(200, seed=77)
    found = [x for t in kernel.slices(pa.array([t for t, _ in held])) for x in pii.added_spans(crf, t)]
    assert np.mean([set(a) == set(b) for (_, a), b in zip(held, found, strict=True)]) > 0.95
    for r in pii.scan(odd, crf).collect():
        base, spans = brute.base_spans(TEXTS[r.doc_id]), r.spans.split(",") if r.spans else []
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in base) and set(r.base.split(",")) - {""} <= set(spans) and r.n_spans == len(spans)
        assert [r[c] for c in pii.COUNTS] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE]
    assert pii.scan(odd.limit(0), crf).count() == 0


def test_pii_query(spark, docs):
    """The contract's columns of all rows, and what the field adds: spans on base ones or beside them, never over them."""
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.QUERIES["op3_pii"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute.base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [r[c] for c in pii.COUNTS] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE]
        added = [s.split(":") for s in r.spans.split(",") if s and s not in joined.split(",")]
        assert all(int(b) <= x or y <= int(a) for _, a, b in added for _, x, y in base)


@pytest.mark.parametrize(("text", "kind", "span"), [("my password = correcthorsebatterystaple ok", "secret", "correcthorsebatterystaple"), ("use AKIAIOSFODNNEXAMPLE now", "secret", "AKIAIOSFODNNEXAMPLE"), ("mail jane at example dot com please", "email", "jane at example dot com"), ("Éa token=" + "0af9" * 10, "secret", "0af9" * 10)])
def test_pii_without_digits(text, kind, span):
    (_, spans), = pii.spans_of(_field(), [text])
    assert (kind, text.index(span), text.index(span) + len(span)) in spans


@functools.cache
def _field():
    return pii.fit(pii.labelled_rows())


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for bias in (0.0, 2.0):  # with a bias to O, chains fall apart
        u, a = rng.normal(0, 1, (14, 3)), rng.normal(0, 1, (3, 3))
        u[:, 0] += bias
        crf, wo = pii.Crf(np.empty(0, np.uint64), np.zeros((1, 3)), a, ["O", "a", "b"]), np.array([0, 5, 5, 6, 14])
        want = []
        for lo, hi in zip(wo[:-1], wo[1:], strict=True):
            paths = itertools.product(range(3), repeat=hi - lo)
            want += max(paths, key=lambda p, lo=lo: sum(u[lo + i, y] for i, y in enumerate(p)) + sum(a[x, y] for x, y in zip((0, *p), (*p, 0), strict=True))) if hi > lo else ()
        assert crf.decode(u, wo).tolist() == want


def test_licenses(spark):
    texts = ["Licensed under CC BY-NC 4.0.", None, "", "x. ALL RIGHTS  RESERVED! y", "\n".join(["Permission is hereby granted, free", "no"]),
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Text. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert got == {0: ["CC-BY-NC-4.0"], 1: [], 2: [], 3: ["LicenseRef-All-Rights-Reserved"], 4: [], 5: ["BSD-2-Clause"]}


def test_packing(spark, odd):
    got = packing.pack(odd, context=256, batch_tokens=2048, part_rows=7).toPandas()
    n = {i: tokens.count(t) for i, t in enumerate(TEXTS)}
    sizes = got.groupby("doc_id")["n_tokens"].sum()
    assert all(sizes.get(i, 0) == c * (2 if i == 5 else 1) for i, c in n.items())
    assert (got["padding"] == got["bucket_len"] - got["n_tokens"]).all() and (got["padding"] >= 0).all()
    assert not got.duplicated(["bucket_len", "batch", "slot"]).any()
    for length, g in got.groupby("bucket_len"):
        per, rows = 2048 // length, g.groupby("batch").size().sort_index()
        assert (rows.iloc[:-1] == per).all() and rows.index.tolist() == list(range(len(rows)))
    assert packing.pack(odd.limit(0)).count() == 0


def test_buckets_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(4)
    for _ in range(20):
        h = {int(x): int(rng.integers(1, 9)) for x in rng.choice(60, 9, replace=False) + 1}
        pad = lambda tops, h=h: sum(c * (min(t for t in tops if t >= n) - n) for n, c in h.items())
        best = min(pad([*c, max(h)]) for k in range(3) for c in combinations(h, k))
        assert pad(packing.bounds(h, 3)) == best
    assert packing.bounds({}) == []


