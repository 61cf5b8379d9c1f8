"""Clashing names, ids of other types, null ids, repeated rows, empty tables and long texts, for every operator."""

import pytest

from barloom.llm import decontaminate, licenses, linededup, neardup, packing, pii, quality, rules, tokens, warc
from barloom.llm.tokenrollup import TokenRollup

LINE = "this line of seven words is here"
CLASHES = ["_line_id", "_line_gone", "line_id", "line_gone", "_gone", "gone_id", "place", "_removed_lines", "id", "text_", "kept", "bucket", "comp", "_quality", "n_words", "_clean_n_words", "_n", "key", "count"]


@pytest.fixture(scope="module")
def crf():
    return pii.fit(pii.labelled_rows(), rounds=5)


def frame(spark, rows, id_type="long"):
    """(id, text) with columns of every name that an operator uses inside."""
    full = [(i, t, *([7] * len(CLASHES))) for i, t in rows]
    return spark.createDataFrame(full, f"doc_id {id_type}, text string, " + ", ".join(f"`{c}` int" for c in CLASHES))


ROWS = [(3, f"{LINE} one\nb"), (1, f"{LINE} one"), (2, None), (4, ""), (None, f"{LINE} one"), (1, f"{LINE} one"), (5, "x" * 300_000 + " " + LINE), (6, f"{LINE} one\nc")]


def test_line_dedup_keeps_other_columns(spark):
    df = frame(spark, ROWS)
    out = linededup.dedup_lines(df, removed_col="removed")
    assert out.columns == [*df.columns, "removed"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r[c] == 7 for r in rows for c in CLASHES)
    assert sorted((r.doc_id or 0, r.text) for r in rows if r.doc_id in (1, 3, 6, None)) == [(0, f"{LINE} one"), (1, f"{LINE} one"), (1, f"{LINE} one"), (3, "b"), (6, "c")]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_ids_of_text(spark):
    rows = [(f"d{i}" if i is not None else None, t) for i, t in ROWS]
    df = frame(spark, rows, "string")
    lines = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect() if r.doc_id in ("d3", "d6")}
    assert lines == {"d3": "b", "d6": "c"}
    body = " ".join(f"w{i}" for i in range(60))
    copies = [(f"d{i}", body + f" tail{i % 7}") for i in range(40)] + [("z", "other words here " * 9)]
    df = frame(spark, copies, "string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert set(got.values()) == {"d0", "z"}
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == ["d0", "z"] and neardup.keep_one(df).columns == df.columns


def test_repeated_ids_with_different_texts(spark):
    """An id's least set counts, in the groups as in the result, and of its rows one stays."""
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(60))
    df = frame(spark, [(1, one), (1, two), (2, two), (4, two + " end"), (3, one + " end"), (9, one), (9, one), (None, one)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == {1: (46, 1), 3: (47, 1), 9: (46, 1), 2: (56, 2), 4: (57, 2)}
    kept = neardup.keep_one(df).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2] and neardup.near_duplicates(df.limit(0)).count() == 0


def test_operators_of_one_pass(spark, crf):
    df = frame(spark, ROWS)
    bench = spark.createDataFrame([(1, LINE, "x"), (None, "q", "x"), (2, None, "x")], "item_id long, text string, id string")
    lines, words = quality.fit(["Good line.", "BAD!!"] * 10, [1, 0] * 10), rules.fit(["good words " * 30, "bad ### " * 30] * 10, [1, 0] * 10)
    for make in (lambda d: pii.scan(d, crf), licenses.scan, lambda d: quality.score(d, lines), lambda d: rules.judge(d, words), lambda d: decontaminate.decontaminate(d, bench), lambda d: tokens.with_tokens(d, ["doc_id"])):
        assert make(df).count() == len(ROWS)
        assert make(df.limit(0)).count() == 0
    assert quality.score(df, lines).where("doc_id is null").collect()[0].held_out is None
    for keep in (lambda d: quality.keep_good(d, lines), lambda d: decontaminate.keep_clean(d, bench)):
        out = keep(df)
        assert out.columns == df.columns and keep(df.limit(0)).count() == 0
    packed = packing.pack(df)
    assert packed.where("doc_id = 5").count() > 1 and packed.where("doc_id is null").count() == 1


def test_pages_without_ids(spark):
    big = "<p>x</p>" * 300
    rows = [(None, "http://a.org/", big, 1), (None, "http://a.org/", "s", 1), (4, "http://a.org/", big, 1), (2, "http://b.org/", big, 1), (2, "http://b.org/", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    index, _ = warc.archive(pages)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in index.lookup(warc.keys_of(pages.select("url"))).collect())
    assert got == [(0, "response", 0), (0, "revisit", 4), (2, "revisit", 4), (2, "revisit", 4), (4, "response", 0)]


def test_rollup_log(spark, tmp_path):
    """A crash before the log entry leaves nothing; of two writers of one number the second works on the first's ledger."""
    at = f"file://{tmp_path}/r"
    a, b = TokenRollup(spark, at, 4), TokenRollup(spark, at, 4)
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, op string, source string, lang string, tokenizer string, n_tokens long, extra string")
    assert a.commit("first", rows((1, "insert", "s", "en", "v", 5, "x"), (1, "insert", "s", "en", "v", 5, "x"), (None, "insert", "s", None, "v", 2, "x")))
    real, lost = b.log.append, []

    def late(number, entry):
        if not lost:  # another writer comes first
            lost.append(a.commit("second", rows((1, "delete", None, None, "v", None, "x"))))
        return real(number, entry)

    b.log.append = late
    assert b.commit("third", rows((1, "delete", None, None, "v", None, "x"), (None, "delete", None, None, "v", None, "x"))) and lost == [True]
    assert list(a.batches()) == ["first", "second", "third"] and a.totals().count() == 0
    (tmp_path / "r" / "data" / "half").mkdir()
    assert a.commit("empty", rows()) and not b.commit("empty", rows()) and a.totals().count() == 0
    with pytest.raises(Exception, match="no such operation"):
        a.commit("odd", rows((1, "upsert", "s", "en", "v", 1, "x")))


def test_token_query(spark):
    from barloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first, want = {}, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id) if r.text is not None else None
    for r in docs:
        if r.text is None or first[r.text] == r.doc_id:
            bare = (r.text or "").strip(" \t\n\x0b\f\r")
            n, k = want.get((r.source, r.lang), (0, 0))
            want[(r.source, r.lang)] = (n + 1, k + tokens.count(bare))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.QUERIES["op4_token_counts"](spark, sf).collect()}
    assert got == want
