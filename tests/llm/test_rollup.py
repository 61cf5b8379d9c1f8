"""Token rollups: ids of any type, folds of the log, and totals against a plain ledger."""

import random

import pytest

from barloom.llm import tokens
from barloom.llm.tokenrollup import TokenRollup


def rows(spark, id_type, *x):
    return spark.createDataFrame(list(x), f"doc_id {id_type}, op string, source string, lang string, tokenizer string, n_tokens long")


@pytest.mark.parametrize("id_type", ["string", "long"])
def test_folded_log(spark, tmp_path, id_type):
    draw = random.Random(1)
    held, r = {}, TokenRollup(spark, f"file://{tmp_path}/r", 3, fold=2)
    name = (lambda i: f"doc-{i}") if id_type == "string" else (lambda i: i)
    for k in range(6):
        batch = []
        for i in draw.sample(range(8), 4):
            op = draw.choice(["insert", "delete", "revise"])
            source, n = draw.choice(["a", "b", None]), draw.randint(0, 9)
            batch.append((name(i) if i else None, op, source, "en", "v", n))
            if op != "insert":
                held.pop(i, None)
            if op != "delete":
                held.setdefault(i, []).append((source, n))
        assert r.commit(f"b{k}", rows(spark, id_type, *batch)) and not r.commit(f"b{k}", rows(spark, id_type, *batch))
        want = {}
        for docs in held.values():
            for source, n in docs:
                c, t = want.get(source, (0, 0))
                want[source] = (c + 1, t + n)
        fresh = TokenRollup(spark, f"file://{tmp_path}/r", 3, fold=2)
        assert {x.source: (x.n_docs, x.n_tokens) for x in fresh.totals().collect()} == want
        assert len(fresh._folders()) <= 3 and list(fresh.batches()) == [f"b{j}" for j in range(k + 1)]
    assert len(r.log.entries()) > 6


def test_fold_that_loses_the_race_leaves_nothing(spark, tmp_path):
    a = TokenRollup(spark, f"file://{tmp_path}/r", 2)
    a.commit("one", rows(spark, "long", (1, "insert", "s", "en", "v", 5)))
    real = a.log.append
    a.log.append = lambda number, entry: False if "batch" not in entry else real(number, entry)
    assert not a.fold() and a.commit("two", rows(spark, "long", (2, "insert", "s", "en", "v", 6)))
    assert [tuple(x) for x in a.totals().collect()] == [("s", "en", "v", 2, 11)]


def test_counted_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two", 7)], "`a.b` long, `t.x` string, n_tokens long")
    got = tokens.with_tokens(df, ["a.b", "n_tokens"], "t.x", name="count")
    assert got.columns == ["a.b", "n_tokens", "count"] and tuple(got.collect()[0]) == (1, 7, tokens.count("one two"))
    both = tokens.with_tokens(df, ["n_tokens"], "t.x")
    assert both.columns == ["n_tokens", "n_tokens"] and tuple(both.collect()[0]) == (7, tokens.count("one two"))
