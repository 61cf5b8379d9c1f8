"""Benchmark decontamination by winnowing.

Of each K consecutive word hashes one fingerprint is made; in each window of W fingerprints the least is
kept, in test items and documents alike.  A span of K + W - 1 = WINDOW words that both share has the same W
fingerprints in both, so the same least one: each such span is met in the join.  A hit is then extended word
by word in both directions along its alignment, and counts where WINDOW words or more agree.  An item of
fewer than WINDOW words is one window, and is looked up whole by a fingerprint of its own length.

Defined results: null or wordless texts have no words and are clean; a null item id marks hits but is not
named; repeated rows are judged each for itself; item ids that occur twice count once; an empty benchmark
leaves all documents clean; overlapping hits count each word once, so ties don't matter; texts of any length count
whole; an empty table gives an empty one; columns of docs keep their names and values.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import kernel
from barloom.llm.arrow import free_name, map_batches

WINDOW = 13
K = 6
#: Bytes of benchmark text that are sent to the executors at once; a larger benchmark goes in several parts.
PART_BYTES = 8 << 20


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of at least one window of w; all, if there are fewer than w."""
    if len(h) <= w:
        return np.arange(len(h))
    least = h[: len(h) - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, h[j : len(h) - w + 1 + j], out=least)
    best = np.zeros(len(h), h.dtype)
    for j in range(w):
        np.maximum(best[j : j + len(least)], least, out=best[j : j + len(least)])
    return np.flatnonzero(best == h)


@dataclass
class Index:
    """Fingerprints of test items.  tables: by n-gram length, the sorted hashes and where each occurs."""

    ids: list[str | None]
    words: np.ndarray
    bounds: np.ndarray
    window: int
    k: int
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def build(ids: list[str | None], texts: list[str | None], window: int = WINDOW, k: int = K) -> Index:
        parts, bounds = [], [0]
        for t in kernel.slices(pa.array(texts, pa.large_string())):
            s, e, wo = t.words(kernel.ALNUM)
            parts.append(kernel.word_hashes(t.b, s, e))
            bounds += list(bounds[-1] + wo[1:])
        words, bounds = np.concatenate(parts or [np.empty(0, np.uint64)]), np.array(bounds)
        out = Index(ids, words, bounds, window, k)
        size = np.diff(bounds)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i in np.flatnonzero(size > 0):
            w = words[bounds[i] : bounds[i + 1]]
            n = k if len(w) >= window else len(w)
            if len(w) < window:
                key = -n  # the whole item
            else:
                key = n
            g, at, _ = kernel.ngrams(w, np.array([0, len(w)]), n)
            keep = winnow(g, window - k + 1) if key > 0 else np.arange(len(g))
            found.setdefault(key, []).append((g[keep], at[keep] + bounds[i]))
        for key, pairs in found.items():
            h, at = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            u, first = np.unique(h, return_index=True)
            out.tables[key] = (u, np.append(first, len(h)), at)
        return out

    def scan(self, t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
        """Of each text: the bounds of its words, whether each word is hit, and the items that occur."""
        s, e, wo = t.words(kernel.ALNUM)
        h = kernel.word_hashes(t.b, s, e)
        hit, items = np.zeros(len(h), bool), [set() for _ in range(t.n)]
        for key, (hashes, first, at) in self.tables.items():
            n = abs(key)
            g, pos, _ = kernel.ngrams(h, wo, n)
            if key > 0:
                keep = winnow(g, self.window - self.k + 1)
                g, pos = g[keep], pos[keep]
            if not len(g):
                continue
            j = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
            for x in np.flatnonzero(hashes[j] == g):
                p = int(pos[x])
                d = int(np.searchsorted(wo, p, "right")) - 1
                for q in at[first[j[x]] : first[j[x] + 1]]:
                    self._extend(h, wo, hit, items, d, p, int(q), n if key < 0 else self.window)
        return wo, hit, h, items

    def _extend(self, h, wo, hit, items, d, p, q, least) -> None:
        i = int(np.searchsorted(self.bounds, q, "right")) - 1
        back = min(p - wo[d], q - self.bounds[i])
        ahead = min(wo[d + 1] - p, self.bounds[i + 1] - q)
        same = h[p - back : p + ahead] == self.words[q - back : q + ahead]
        off = np.flatnonzero(~same)
        k = np.searchsorted(off, back)
        lo = off[k - 1] + 1 if k else 0
        hi = off[k] if k < len(off) else len(same)
        if hi - lo >= least:
            hit[p - back + lo : p - back + hi] = True
            items[d].add(i)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]


def _runs(x: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, k: int, part_bytes: int) -> list[Index]:
    """The benchmark as indexes of about part_bytes of text each; its size is measured first."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    out = []
    for j in range(n):
        rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == j)).collect()
        out.append(Index.build([r.i for r in rows], [r.t for r in rows], window, k))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, part_bytes: int = PART_BYTES, prefix: str = "") -> tuple[DataFrame, list[str]]:
    """docs with three more columns (their names are returned): the number of words, the hit spans [start, end) in words, and the items met.

    A benchmark above part_bytes is taken in parts, one pass of the documents each, and the spans joined.
    """
    spark, names = docs.sparkSession, None
    fields = FIELDS
    for n, index in enumerate(parts(benchmark, item_col, item_text_col, window, min(k, window), part_bytes)):
        sent = spark.sparkContext.broadcast(index)
        names_n = [free_name(docs, f"{prefix}{f.name}") for f in fields]
        at = docs.columns.index(text_col)

        def judge(batch: pa.RecordBatch, sent=sent, names_n=names_n, at=at) -> dict:
            index, words, spans, ids = sent.value, [], [], []
            for t in kernel.slices(batch.column(at)):
                wo, hit, _, items = index.scan(t)
                words += np.diff(wo).tolist()
                spans += [_runs(hit[a:b]) if its else [] for a, b, its in zip(wo[:-1], wo[1:], items, strict=True)]
                ids += [sorted({index.ids[i] for i in its} - {None}) for its in items]
            return dict(zip(names_n, (words, spans, ids), strict=True))

        docs = map_batches(docs, judge, [T.StructField(a, f.dataType) for a, f in zip(names_n, fields, strict=True)], keep=True)
        if names is None:
            names = names_n
        else:
            merged = {
                names[1]: F.concat(names[1], names_n[1]),
                names[2]: F.array_sort(F.array_union(names[2], names_n[2])),
            }
            docs = docs.withColumns(merged).drop(*names_n)
    return docs, names


def hit_words(spans: str) -> Column:
    """Words that at least one span of the column covers."""
    return F.aggregate(
        F.array_sort(F.col(spans)),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s[1] - F.greatest(s[0], a["end"]))).alias("n"),
            F.greatest(a["end"], s[1]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, hits (word spans), item_ids, contaminated (5 % of its words or more are hit)."""
    out, (n, spans, ids) = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, **options)
    out = out.withColumn("n_hit", hit_words(spans))
    return out.select(F.col("id").alias(id_col), n, "n_hit", spans, ids, ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col(n))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with the same columns."""
    out, (n, spans, _) = scan(docs, benchmark, text_col, prefix="_clean_", **options)
    n_hit = hit_words(spans)
    return out.where(~((n_hit > 0) & (20 * n_hit >= F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
