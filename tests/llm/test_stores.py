"""Archives, rollups and the pipeline."""

import hashlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import quality, stages, tokens, warc
from barloom.llm.tokenrollup import TokenRollup


def test_keys():
    assert warc.reversed_host("http://user@WWW.Example.com:80/a?b#c") == "com,example)/a?b"
    assert warc.reversed_host("https://m.example.org:8443") == "org,example,m:8443)/"
    assert warc.reversed_host(None) == ")" and warc.reversed_host("http://[bad") == ")http://[bad"


def test_archive_round_trip(spark):
    big = "<p>é</p>" * 400
    rows = [(i, u, h, "extra") for i, (u, h) in enumerate([("http://a.example.com/x", big), ("http://a.example.com/x", big), ("http://b.example.com/", None), (None, ""), ("http://c.example.com/\r\nX: y", "s"), ("http://a.example.com/x", "WARC/1.1\r\n\r\n" * 3), *[("http://hot.example.com/", f"{k}") for k in range(50)], ("http://z.example.com/", big)])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    index, manifest = warc.archive(pages, file_bytes=4000)
    index = warc.CaptureIndex.build(manifest, index.folder, block_lines=5, shard_rows=20)
    assert len(index.shards) > 1
    got = {r.page_id: r for r in index.lookup(warc.keys_of(pages.select("url"))).collect()}
    assert len(got) == len(rows)
    last = rows[-1][0]
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        same = h == big and i != last
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", last) if same else ("response", None))
        assert got[i].payload is None if same else bytes(got[i].payload) == raw
    one = index.lookup(spark.createDataFrame([("com,example,hot)/",), ("none",)], "key string"))
    assert one.count() == 50
    empty, _ = warc.archive(pages.limit(0))
    assert empty.lookup(warc.keys_of(pages.select("url"))).count() == 0


def test_damaged_record():
    raw = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, None)
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"payload", b"PAYLOAD"))


def test_rollup(spark, tmp_path):
    r = TokenRollup(spark, f"file://{tmp_path}/rollup")
    schema = "doc_id long, op string, source string, lang string, tokenizer string, n_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    totals = lambda: {(t.source, t.lang, t.tokenizer): (t.n_docs, t.n_tokens) for t in r.totals().collect()}
    assert totals() == {}
    first = batch((1, "insert", "a", "en", "v1", 10), (2, "insert", "a", "en", "v1", 5), (3, "insert", None, "de", "v1", None), (1, "insert", "a", "en", "v2", 8))
    assert r.commit("one", first) and not r.commit("one", first)
    assert totals() == {("a", "en", "v1"): (2, 15), (None, "de", "v1"): (1, 0), ("a", "en", "v2"): (1, 8)}
    assert r.commit("two", batch((1, "revise", "b", "en", "v1", 7), (2, "delete", None, None, "v1", None), (9, "delete", "a", "en", "v1", 3)))
    assert totals() == {("b", "en", "v1"): (1, 7), (None, "de", "v1"): (1, 0), ("a", "en", "v2"): (1, 8)}
    assert r.commit("three", batch((1, "delete", None, None, "v1", None), (3, "delete", None, None, "v1", None)))
    assert totals() == {("a", "en", "v2"): (1, 8)}


def test_token_counts():
    assert tokens.count(None) == tokens.count("") == 0
    assert tokens.count("Hello world") == 2 and tokens.count("a" * 50_000) > 0


def test_pipeline(spark):
    """Every stage's decision, with the model's own verdicts, made again in plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(frame, model).where("predicted = 1").collect()}
    docs = {i: t for i, t in docs.items() if i in good}
    gone = brute.removed_lines(docs)
    docs = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if t or not gone[i]}
    docs = {i: docs[i] for i, (_, c) in brute.near_duplicates(docs, 5).items() if i == c}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {i: t for i, t in docs.items() if not brute.contamination(t, items)["contaminated"]}
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()
    want = {i: tokens.count(t) for i, t in docs.items()}
    assert {r.doc_id: (r.n, r.k) for r in got} == {i: (n, int(np.ceil(n / 2048))) for i, n in want.items() if n}


def test_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"id": F.lit(1), "kept": F.lit("x"), "score": F.lit(2)}).limit(60)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert stages.pack(spark, docs.limit(0), sf).count() == 0
