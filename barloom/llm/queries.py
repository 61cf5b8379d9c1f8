"""One query per operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, laesa, licenses, linededup, merkle, neardup, packing, patterns, pii, quality, rules, tokens, warc
from barloom.llm.shared import Scratch
from barloom.llm.tokenrollup import TokenRollup
from barloom.session import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index, _ = warc.archive(pages)
    found = index.lookup(warc.keys_of(pages.select("url")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"), pii.fit(pii.labelled_rows()))
    return found.select("doc_id", *pii.COUNTS, F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; those with white space at an end revised to the count without it; and of equal texts all
    but the least id deleted.  Each batch is sent twice and counts once."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "tokens")
    tokenizer = {"tokenizer": F.lit("byte_bpe_50k")}
    keyed = docs.withColumns({"digest": F.sha2("text", 256), "bare": F.regexp_replace("text", r"^\s+|\s+$", "")})
    loose = keyed.where("bare <> text").select("doc_id", "source", "lang", F.col("bare").alias("text"))
    counted = scratch.put("counts", tokens.with_tokens(keyed, ["doc_id", "source", "lang", "digest"]))
    first = scratch.put("first", counted.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    batches = {
        "documents": counted.withColumns({"op": F.lit("insert")} | tokenizer),
        "trimmed": scratch.put("trimmed", tokens.with_tokens(loose, ["doc_id", "source", "lang"])).withColumns({"op": F.lit("revise")} | tokenizer),
        "repeats": counted.join(first, "digest").where("doc_id <> first").withColumns({"op": F.lit("delete")} | tokenizer),
    }
    rollup = TokenRollup(spark, f"{scratch.path}/rollup")
    for name in [*batches, *batches]:
        rollup.commit(name, batches[name])
    return rollup.totals()


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = linededup.dedup_lines(docs, removed_col="removed")
    n = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", n.alias("n_removed"), F.array_join(F.coalesce("removed", F.array().cast("array<int>")), ",").alias("removed_lines"), F.sha2("text", 256).alias("text_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pack(table(spark, sf_dir, "documents"))


def op12_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.product_codes(table(spark, sf_dir, "embeddings")).drop("evaluated")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.Manifest(table(spark, sf_dir, "documents"), claimed=merkle.tampered()).proofs()


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m ON m.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""

_SENTENCE_MAP = "MAP {" + ", ".join(f"'{s}': '{i}'" for i, s in licenses.SENTENCES.items()) + "}"
_LICENSE_LIST = ", ".join(f"CASE WHEN regexp_matches(line, '{licenses.rule_pattern(ids)}') THEN '{name}' END" for name, ids in licenses.RULES)
OP2_SQL = f"""
WITH n AS (SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '{licenses.BREAK}', chr(92) || '1' || chr(10), 'g'), chr(10)),
                  lambda s: trim(regexp_replace(lower(s), '{licenses.GAP}', ' ', 'g'))) AS s FROM documents),
i AS (SELECT doc_id, list_filter(list_transform(s, lambda x: {_SENTENCE_MAP}[x]), lambda x: x IS NOT NULL) AS ids FROM n),
l AS (SELECT doc_id, ids, ',' || coalesce(array_to_string(ids, ','), '') || ',' AS line FROM i)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{_LICENSE_LIST}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM l
"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dn AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT doc_id, i, dn.n, item_id FROM dn JOIN bw ON bw.n = dn.n AND bw.win = array_to_string(w[i:i + dn.n - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

def _op12_sql() -> str:
    width, sections = "(SELECT len(any_value(x)) // 16 FROM k)", []
    near = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(3):
        sections.append(f"a{i} AS (SELECT vec_id, p.part, min({{'d': CAST({near} AS BIGINT), 'e': entry}}) AS m FROM p JOIN e{i} ON e{i}.part = p.part GROUP BY vec_id, p.part)")
        if i < 2:
            sections.append(
                f"s{i} AS (SELECT part, e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p.part, m.e AS e, v, unnest(range(1, len(v) + 1)) AS i FROM p JOIN a{i} USING (vec_id, part)) GROUP BY part, e, i), "
                f"e{i + 1} AS (SELECT o.part, o.entry, coalesce(w.v, o.c) AS c FROM e{i} o LEFT JOIN (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY part, e) w ON w.part = o.part AND w.e = o.entry)"
            )
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT vec_id, t.part, x[t.part * {width} + 1:(t.part + 1) * {width}] AS v FROM k, range(16) t(part)),
e0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{", ".join(sections)},
r AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e2)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), b
"""


def _op13_sql() -> str:
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    whole = lambda n: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    bits = "list_reduce(list_prepend({0}, CAST(range(8) AS BIGINT[])), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, x: {bits.format('xor(s, x)')}), 4294967295)"
    run = "sha256(string_agg(d, '' ORDER BY i))"
    up = "{0} AS (SELECT {2}, i, d, CAST(0 AS BIGINT) AS up FROM {1} UNION ALL SELECT {2}, i // 2, " + run + ", any_value(up) + 1 FROM (SELECT *, max(i) OVER (PARTITION BY {2}) AS most FROM {0}) WHERE most > 0 GROUP BY {2}, i // 2)"
    walk = "{0} AS (SELECT {2}, i AS leaf, i AS j, CAST(0 AS BIGINT) AS up, '' AS proof, {3} AS folded FROM {1} UNION ALL SELECT w.{2}, w.leaf, w.j // 2, w.up + 1, w.proof || coalesce(s.d, ''), sha256(CASE WHEN w.j % 2 = 1 THEN s.d || w.folded ELSE w.folded || coalesce(s.d, '') END) FROM {0} w JOIN {4} p ON p.k = w.k AND p.up = w.up + 1 AND p.i = w.j // 2 LEFT JOIN {4} s ON s.k = w.k AND s.up = w.up AND s.i = xor(w.j, 1))"
    last = lambda t: f"(SELECT k, max(up) AS up FROM {t} GROUP BY k)"
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, {whole("n_chars")} AS d, CASE WHEN {crc} % 7 = 0 THEN {whole("(n_chars + 1)")} ELSE {whole("n_chars")} END AS c FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM r),
{up.format("t", "n", "k")},
g AS (SELECT 0 AS k, t.k AS i, d FROM t JOIN {last("t")} m ON m.k = t.k AND m.up = t.up),
{up.format("u", "g", "k")},
{walk.format("w", "n", "k", "c", "t")},
e AS (SELECT w.* FROM w JOIN {last("t")} m ON m.k = w.k AND m.up = w.up),
f AS (SELECT 0 AS k, row_number() OVER () - 1 AS i, e.k AS lang, e.leaf, e.proof, e.folded FROM e),
x AS (SELECT i, lang, leaf, lang AS j, CAST(0 AS BIGINT) AS up, proof, folded FROM f UNION ALL
      SELECT x.i, lang, leaf, j // 2, x.up + 1, proof || coalesce(s.d, ''), sha256(CASE WHEN j % 2 = 1 THEN s.d || folded ELSE folded || coalesce(s.d, '') END)
      FROM x JOIN u p ON p.up = x.up + 1 AND p.i = j // 2 LEFT JOIN u s ON s.up = x.up AND s.i = xor(j, 1)),
z AS (SELECT max(up) AS up FROM u)
SELECT doc_id, n.d AS leaf, g.d AS subroot, u.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.d AS verified
FROM x JOIN z ON x.up = z.up JOIN u ON u.up = z.up JOIN n ON n.k = x.lang AND n.i = x.leaf JOIN g ON g.i = x.lang
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_licenses": op2_licenses,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_pattern_packing": op11_pattern_packing,
    "op12_laesa_codes": op12_laesa_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {"op1_warc": OP1_SQL, "op2_licenses": OP2_SQL, "op7_decontaminate": OP7_SQL, "op12_laesa_codes": _op12_sql(), "op13_merkle_manifest": _op13_sql()}
