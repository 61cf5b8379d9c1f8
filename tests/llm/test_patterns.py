"""Pattern packing: ids against the whole tokenizer, the plan against its bounds, the query against a brute-force count."""

import random
import zlib

import numpy as np
import pytest

from barloom.llm import patterns, queries, wordtokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordtokens.vocabulary_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, patterns.END_ID]


def test_ids_of_odd_texts(tokenizer):
    draw = random.Random(5)
    letters = [chr(c) for c in [*range(1, 127), *range(0xA0, 0x250)]] + list(" 　–‘’…ΣσςKé中文日本🙂​ﬁ̧́") + ["'s", "'LL", "DON'T", "<|endoftext|>", "<|", "word ", " The "]
    texts = ["", " ", "\n\n", "a" * 5000, "ab" * 3000 + " x", *("".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(1500))]
    got = wordtokens.ids_bytes([t.encode() for t in texts], wordtokens.vocabulary_path())
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(tokenizer, t)[:-1] for t in texts]


def test_full_memory_starts_again(tokenizer, monkeypatch):
    monkeypatch.setattr(wordtokens, "KEPT_RUNS", 5)
    words = wordtokens.Words(wordtokens.vocabulary_path())
    for text in ("one two three", "three four five six", "one two seven eight nine ten eleven", "one"):
        assert np.frombuffer(words.text(text.encode()), "<u4").tolist() == ids_of(tokenizer, text)[:-1]


def test_every_token_is_whole_by_itself(tokenizer):
    """What lets merges go by known tokens instead of named pairs: nearly all tokens come out as they are, or are left out."""
    held = wordtokens.words(wordtokens.vocabulary_path()).merger._mergeable_ranks
    all_ids = set(tokenizer.get_vocab(with_added_tokens=False).values())
    assert set(held.values()) <= all_ids and len(all_ids - set(held.values())) < 300


def test_patterns_and_least_squares():
    assert patterns.patterns(5, 3) == [(5,), (4, 1), (3, 2), (3, 1, 1), (2, 2, 1)]
    assert all(sum(p) == 40 and list(p) == sorted(p, reverse=True) for p in patterns.patterns(40, 4))
    draw = np.random.default_rng(2)
    for _ in range(20):
        a, b = draw.normal(size=(12, 30)), draw.normal(size=12)
        x = patterns.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6  # Kuhn and Tucker




@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    draw = random.Random(seed)
    context = draw.choice([4096, 128, 100, 7])
    h = {}
    for _ in range(draw.randint(1, 3000)):
        n = draw.choice([context, draw.randint(1, context), draw.randint(1, max(1, context // 3))])
        h[n] = h.get(n, 0) + draw.choice([1, 1, 30])
    entries, sequences = patterns.plan(h, context)
    used = {}
    for at, (length, first, per, sequence, offset) in enumerate(entries.tolist()):
        last = entries[at + 1, 1] if at + 1 < len(entries) and entries[at + 1, 0] == length else h[length]
        assert (last - first) % per == 0 and last > first
        for k in range(last - first):
            used.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
    assert sorted(used) == list(range(sequences)) and sum(map(len, used.values())) == sum(h.values())
    for held in used.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(held[-1]) <= context
    assert sequences <= patterns.least_sequences(h, context) * 1.01 + 1


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (None, "one two"), (2, "word " * 9000), (2, "word " * 9000), (7, "x" * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, id int, piece int, n int")
    out = patterns.pack(df)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    assert sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 2) == sorted([(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)] * 2)
    assert [(r.length, r.ids_crc32) for r in got if r.doc_id in (1, 3)] == [(1, zlib.crc32(b"\1\0\0\0"))] * 2
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert patterns.pack(df.limit(0)).count() == 0
    dotted = df.withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "t.x")
    assert patterns.pack(dotted, "a.b", "t.x").count() == len(got)


@pytest.mark.parametrize("part_rows", [patterns.PART_ROWS, 3])
def test_whole_query(spark, tokenizer, part_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = queries.QUERIES["op11_pattern_packing"](spark, SF) if part_rows == patterns.PART_ROWS else patterns.pack(docs, part_rows=part_rows)
    assert [f.dataType.simpleString() for f in run.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    got = run.collect()
    want, h = set(), {}
    for d in docs.collect():
        ids = ids_of(tokenizer, d.text)
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], "<u4")
            want.add((d.doc_id, at // 4096, at, len(part), zlib.crc32(part.tobytes())))
            h[len(part)] = h.get(len(part), 0) + 1
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1].tolist()] and sum(x[-1]) <= 4096
    assert len(held) <= patterns.least_sequences(h) * 1.01 + 1
