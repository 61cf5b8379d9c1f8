"""Quality rules: counts of each text, and a hashed n-gram logistic regression with a calibrated threshold.

The model is a logistic regression on hashed words and hashed byte 5-grams (both lower-cased), each family a
vector of shares of a text's n-grams.  It is fitted on the driver on a bounded sample of labelled rows, its
score is calibrated on rows of that sample which it wasn't fitted on (a logistic curve on the raw score), and
it is applied in Arrow batches against a fixed threshold.

Defined results: null texts count as empty; empty and wordless texts have zero counts and fail the base rules;
without labelled rows of both classes the model's verdict is the labelled share (1 if there is none), so that
only the base rules decide; a score equal to the threshold keeps; repeated rows are judged each; texts of any length
count whole; an empty table gives an empty one; other columns are not looked at; ids may be of any type or null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import kernel
from barloom.llm.arrow import map_batches
from barloom.llm.sample import labelled_sample

BITS = 16
CHARS = 5
SCALE = np.float32(20.0)
MIN_WORDS = 50
THRESHOLD = 0.5
SAMPLE_ROWS = 2000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def counts(t: kernel.Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base counts of each text; its words' hashes (lower-cased) and bounds."""
    s, e, wo = t.words(kernel.SPACED)
    exact = kernel.word_hashes(t.b, s, e, fold=False)
    g, at, go = kernel.ngrams(exact, wo, 3)
    twice = at[kernel.repeated(g, go)]
    cover = np.zeros(len(exact), bool)
    for j in range(3):
        cover[twice + j] = True
    dup = np.zeros(t.n, np.int64)
    raw = t.b.tobytes()
    for i, (a, b) in enumerate(zip(t.off[:-1].tolist(), t.off[1:].tolist(), strict=True)):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1:
            seen = set(lines)
            if len(seen) < len(lines):
                had = set()
                for x in lines:
                    if x not in had:
                        had.add(x)
                    elif x.strip(b" \t\n\v\f\r"):
                        dup[i] += 1
    out = {
        "n_words": np.diff(wo),
        "word_chars": t.per_text(kernel.SPACED[t.b] & ((t.b & 0xC0) != 0x80)),
        "n_symbols": t.per_text(_SYMBOL[t.b]),
        "n_dup_lines": dup,
        "n_repeat_words": kernel.span_sums(cover, wo),
    }
    return out, s, wo


def hashed(t: kernel.Texts) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Both families' feature numbers, with each text's bounds in them."""
    s, e, wo = t.words(kernel.SPACED)
    words = (kernel.word_hashes(t.b, s, e) >> np.uint64(64 - BITS)).astype(np.int32)
    low = _LOWER[t.b].astype(np.uint32)
    n = max(0, len(low) - CHARS + 1)
    h = np.zeros(n, np.uint32)
    for j in range(CHARS):
        h = h * np.uint32(0x01000193) + low[j : n + j] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - BITS)
    ends = np.maximum(t.off[:-1], t.off[1:] - CHARS + 1)
    co = np.stack([np.minimum(t.off[:-1], n), np.minimum(ends, n)])
    return (words, np.stack([wo[:-1], wo[1:]])), (h, co)


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1)
    np.cumsum(values, out=c[1:])
    return (c[bounds[1]] - c[bounds[0]]) / np.maximum(bounds[1] - bounds[0], 1)


@dataclass
class Model:
    weights: np.ndarray  # two families
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, t: kernel.Texts) -> np.ndarray:
        return self.bias + SCALE * sum(_means(w[f], o) for w, (f, o) in zip(self.weights, hashed(t), strict=True))

    def score(self, t: kernel.Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(t) + self.shift, -35, 35)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (x, y), by damped Newton steps; classes weigh as they are."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        grad = np.array([np.sum((p - y) * x) + 1e-2 * (a - 1), np.sum(p - y)])
        hess = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        step = np.linalg.solve(hess, grad)
        size = min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = max(a - size * step[0], 1e-3), b - size * step[1]
    return float(a), float(b)


def fit(texts: list[str], labels: list[int], rounds: int = 60, seed: int = 5) -> Model:
    """Full-batch Adam on four fifths of the rows, calibration on the rest."""
    y = np.array(labels, float)
    zero = np.zeros((2, 1 << BITS), np.float32)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return Model(zero, 0.0, 1.0, 35.0 if share >= THRESHOLD else -35.0)
    rows, cols, vals = [[], []], [[], []], [[], []]
    for t in kernel.slices(pa.array(texts, pa.large_string())):
        for k, (f, o) in enumerate(hashed(t)):
            for i in range(t.n):
                u, c = np.unique(f[o[0, i] : o[1, i]], return_counts=True)
                rows[k].append(np.full(len(u), t.first + i))
                cols[k].append(u)
                vals[k].append((c / max(c.sum(), 1)).astype(np.float32) * SCALE)
    r = [np.concatenate(x) for x in rows]
    c = [np.concatenate(x) for x in cols]
    v = [np.concatenate(x) for x in vals]
    rng = np.random.default_rng(seed)
    fitted = rng.random(len(y)) < 0.8
    if len(set(y[fitted])) < 2 or len(set(y[~fitted])) < 2:
        fitted[:] = True
    weight = np.where(y > 0, 0.5 / max(y[fitted].mean(), 1e-6), 0.5 / max(1 - y[fitted].mean(), 1e-6)) * fitted / fitted.sum()
    w, bias = zero.astype(float), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = bias + sum(np.bincount(r[j], v[j] * w[j, c[j]], len(y)) for j in (0, 1))
        g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * weight
        grad = np.stack([np.bincount(c[j], v[j] * g[r[j]], 1 << BITS) for j in (0, 1)]) + 1e-6 * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        mb, sb = 0.9 * mb + 0.1 * g.sum(), 0.99 * sb + 0.01 * g.sum() ** 2
        w -= 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        bias -= 0.08 * (mb / (1 - 0.9**k)) / (np.sqrt(sb / (1 - 0.99**k)) + 1e-8)
    z = bias + sum(np.bincount(r[j], v[j] * w[j, c[j]], len(y)) for j in (0, 1))
    rest = ~fitted if (~fitted).any() else fitted
    a, b = _curve(z[rest], y[rest])
    return Model(w.astype(np.float32), float(bias), a, b)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: id, the counts, score, base_failed and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        got, scores = {c: [] for c in COUNTS}, []
        for t in kernel.slices(batch.column(1)):
            found, _, _ = counts(t)
            for c in COUNTS:
                got[c].append(found[c])
            scores.append(sent.value.score(t))
        made = {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in got.items()}
        score = np.concatenate(scores) if scores else np.empty(0)
        failed = (made["n_words"] < min_words) | (100 * made["n_repeat_words"] > 50 * made["n_words"])
        return {"id": batch.column(0)} | made | {"score": score, "base_failed": failed, "kept": ~failed & (score >= threshold)}

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [source.schema["id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return map_batches(source, run, fields).withColumnRenamed("id", id_col)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    texts, y = labelled_sample(docs, labels, label_col, id_col, text_col, sample_rows)
    return fit(texts, y)
