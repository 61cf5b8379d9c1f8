"""Document quality from a linear-chain conditional random field over lines.

Each line is good (1) or bad (0).  Its features are those of itself and of the lines before and after it; a
2 x 2 transition table joins neighbours.  Training labels are of documents, so each line of a training document
carries that document's label.  Forward-backward gives each line's probability of being good, and a document's
score is their mean, weighted by line length in code points.

Defined results: null texts count as empty; an empty text is one empty line and gets that line's probability;
without labelled rows of both classes all scores are the labelled share (1 if there are no labels); a score equal to
the threshold is good; repeated rows are judged each; texts of any length count whole; a null id has a null held_out;
an empty table gives an empty one; columns of docs keep their names and values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import kernel
from barloom.llm.arrow import free_name, map_batches
from barloom.llm.sample import held_out, labelled_sample

SAMPLE_ROWS = 2000
THRESHOLD = 0.5


def _class(*parts: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for p in parts for c in p]] = True
    return out


_CLASSES = [
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _class("0123456789"),
    _class("#*$%&<>"),
    _class("|"),
    _class("!?"),
    _class(".,;:"),
]
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_END = _class(".!?")
N_LINE = 17


def line_features(t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [lines x N_LINE], the lines' lengths in code points, and each text's bounds in lines."""
    s, e, lo = t.lines()
    n_lines = len(s)

    def per(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return (c[e] - c[s]).astype(np.float64)

    size = per((t.b & 0xC0) != 0x80)
    ws, we, _ = t.words(kernel.SPACED)
    h = kernel.word_hashes(t.b, ws, we)
    wo = np.searchsorted(ws, np.append(s, len(t.b)))
    words = np.diff(wo).astype(float)
    one = np.maximum(size, 1)
    some = np.maximum(words, 1)
    x = np.empty((n_lines, N_LINE))
    x[:, 0] = np.log1p(size)
    x[:, 1] = np.log1p(words)
    for k, table in enumerate(_CLASSES):
        x[:, 2 + k] = per(table[t.b]) / one
    x[:, 8] = per(_HIGH[t.b]) / one
    x[:, 9] = kernel.span_sums(kernel.firsts(h, wo), wo) / some
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    at = wo[:-1][words > 0]
    same[at] = False
    x[:, 10] = kernel.span_sums(same, wo) / some
    x[:, 11] = per(kernel.SPACED[t.b]) / some / 10
    x[:, 12] = size == 0
    filled = words > 0
    last = np.zeros(n_lines, np.int64)
    last[filled] = we[wo[1:][filled] - 1] - 1
    first = np.zeros(n_lines, np.int64)
    first[filled] = ws[wo[:-1][filled]]
    x[:, 13] = filled & (_END[t.b[last]] if len(t.b) else False)
    x[:, 14] = filled & (_CLASSES[0][t.b[first]] if len(t.b) else False)
    g, _, go = kernel.ngrams(h, wo, 3)
    x[:, 15] = kernel.span_sums(kernel.repeated(g, go), go) / some
    x[:, 16] = x[:, 9] * x[:, 1]
    return x, size, lo


def with_neighbours(x: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """x, its line before and its line after (0 and a flag at a text's ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    head, tail = np.zeros(len(x)), np.zeros(len(x))
    some = np.diff(lo) > 0
    head[lo[:-1][some]] = 1
    tail[lo[1:][some] - 1] = 1
    before[head > 0] = 0
    after[tail > 0] = 0
    return np.column_stack([x, before, after, head, tail, np.ones(len(x))])


def chains(u: np.ndarray, lo: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once.

    u: score of good less bad of each line; a: 2 x 2 transition scores.  Gives each line's probability of good,
    the expected transition counts, and the log partition sum.  Longer chains go on alone as shorter ones end.
    """
    size = np.diff(lo)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], lo[:-1][order]
    steps = int(size.max(initial=0))
    e = np.exp(np.clip(u, -30, 30))
    m = np.exp(a)
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # chains longer than k
    f0, f1 = np.empty(len(u)), np.empty(len(u))
    log_z = 0.0
    for k in range(steps):
        at = start[: alive[k]] + k
        if k == 0:
            p0, p1 = np.ones(len(at)), e[at]
        else:
            q0, q1 = f0[at - 1], f1[at - 1]
            p0, p1 = q0 * m[0, 0] + q1 * m[1, 0], (q0 * m[0, 1] + q1 * m[1, 1]) * e[at]
        z = p0 + p1
        f0[at], f1[at] = p0 / z, p1 / z
        log_z += float(np.log(z).sum())
    good = np.empty(len(u))
    trans = np.zeros((2, 2))
    b0, b1 = np.ones(len(size)), np.ones(len(size))
    for k in range(steps - 1, -1, -1):
        n = alive[k]
        at = start[:n] + k
        g0, g1 = f0[at] * b0[:n], f1[at] * b1[:n]
        good[at] = g1 / (g0 + g1)
        if k:
            q0, q1 = f0[at - 1], f1[at - 1]
            w0, w1 = b0[:n], e[at] * b1[:n]
            joint = q0 * (m[0, 0] * w0 + m[0, 1] * w1) + q1 * (m[1, 0] * w0 + m[1, 1] * w1)
            for i, q in enumerate((q0, q1)):
                for j, w in enumerate((w0, w1)):
                    trans[i, j] += float(np.sum(q * m[i, j] * w / joint))
            n0, n1 = m[0, 0] * w0 + m[0, 1] * w1, m[1, 0] * w0 + m[1, 1] * w1
            top = np.maximum(n0, n1)
            b0[:n], b1[:n] = n0 / top, n1 / top
    return good, trans, log_z


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    a: np.ndarray
    share: float | None = None  # of good documents, where no model could be fitted

    def marginals(self, t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's probability of good, its length, and each text's bounds in lines."""
        x, size, lo = line_features(t)
        if self.share is not None:
            return np.full(len(x), self.share), size, lo
        x = with_neighbours((x - self.mean) / self.scale, lo)
        return chains(x @ self.w, lo, self.a)[0], size, lo

    def score(self, t: kernel.Texts) -> np.ndarray:
        p, size, lo = self.marginals(t)
        total = np.add.reduceat(size, lo[:-1])
        weight = np.where(np.repeat(total, np.diff(lo)) > 0, size, 1.0)
        return np.clip(np.add.reduceat(p * weight, lo[:-1]) / np.add.reduceat(weight, lo[:-1]), 0, 1)


def fit(texts: list[str], labels: list[int], rounds: int = 80, ridge: float = 1e-3) -> Crf:
    """Largest likelihood by Adam; both classes of documents weigh by their lines as they are."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Crf(np.zeros(N_LINE), np.ones(N_LINE), np.zeros(0), np.zeros((2, 2)), float(y.mean()) if len(y) else 1.0)
    xs, los = [], [np.zeros(1, np.int64)]
    for t in kernel.slices(pa.array(texts, pa.large_string())):
        x, _, lo = line_features(t)
        xs.append(x)
        los.append(lo[1:] + los[-1][-1])
    raw, lo = np.concatenate(xs), np.concatenate(los)
    mean, scale = raw.mean(0), raw.std(0) + 1e-6
    x = with_neighbours((raw - mean) / scale, lo)
    line_y = np.repeat(y, np.diff(lo))
    kept = np.zeros((2, 2))
    inner = np.maximum(np.diff(lo) - 1, 0)
    kept[1, 1], kept[0, 0] = inner[y > 0].sum(), inner[y == 0].sum()
    theta = np.zeros(x.shape[1] + 4)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, a = theta[:-4], theta[-4:].reshape(2, 2)
        good, trans, _ = chains(x @ w, lo, a)
        grad = np.concatenate([x.T @ (good - line_y), (trans - kept).ravel()]) / len(x) + ridge * theta
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return Crf(mean, scale, theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Crf:
    return fit(*labelled_sample(docs, labels, label_col, id_col, text_col, sample_rows))


def with_score(docs: DataFrame, model: Crf, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of scores, whose name is returned."""
    name, at = free_name(docs, "_quality"), docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        scores = [sent.value.score(t) for t in kernel.slices(batch.column(at))]
        return {name: np.concatenate(scores) if scores else np.empty(0)}

    return map_batches(docs, run, [T.StructField(name, T.DoubleType())], keep=True), name


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    out, s = with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col(s).alias("score"), F.when(F.col(s) >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def line_labels(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and, for each line, the probability that it is good."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for t in kernel.slices(batch.column(1)):
            p, _, lo = sent.value.marginals(t)
            out += [p[a:b].tolist() for a, b in zip(lo[:-1], lo[1:], strict=True)]
        return {"id": batch.column(0), "good": out}

    return map_batches(source, run, [source.schema["id"], T.StructField("good", T.ArrayType(T.DoubleType()))]).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model calls good, with the same columns."""
    out, s = with_score(docs, model, text_col)
    return out.where(F.col(s) >= THRESHOLD).drop(s)
