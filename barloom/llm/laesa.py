"""Product codes of vectors: integer codebooks in rounds, nearest entries found through fixed pivots (LAESA).

A component x becomes floor(256 x), and a vector PARTS equal consecutive parts.  At each part position a codebook of
ENTRIES starts as that part of the vectors with the least ids; each of ROUNDS rounds assigns every part to its nearest
entry (squared distance, ties to the lower index) and replaces each entry by its parts' floored means.  Then parts
are assigned once more.

Each part's distances to a few pivots (entries of the first codebook that lie far apart) are computed once and kept in
a table.  A round computes the distances between pivots and entries; by the triangle inequality their difference
bounds a part's distance to an entry from below.  A part meets the entries in the order of that bound and stops at the
first that is above the best exact distance; distances that count are integers throughout, bounds have a margin for their own rounding.

What goes to the driver is the codebooks and one sum for each of their components, whatever the rows.

Defined results: rows whose vector is null, is empty, or holds null or non-finite components are left out; so are
vectors of another length than that of the first kept row (by id).  A length that PARTS doesn't divide is filled up with zeros.
Components saturate at 2^26 after the factor (|x| of 262,144), so that sums of squares are exact in 64 bits.  Repeated
rows count each; a null id comes last in the order of ids; ties of ids go by the vector.  With fewer rows than
ENTRIES the codebooks have as many entries as rows.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.arrow import map_batches
from barloom.llm.shared import Scratch

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
SCALE, LIMIT = 256, 1 << 26
CHUNK_ROWS = 8192
#: Rows of a table of label totals that may be broadcast; larger ones are joined in SALTS shares of each label.
BROADCAST_LABELS = 200_000
SALTS = 64
#: Relative margin of a bound made of distances kept as 32-bit floats.
MARGIN = 2.0**-22


def integers(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, x) of the rows that count, x as saturated integers."""
    v = F.col("v")
    whole = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), whole.alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    )
    bound = LIMIT / SCALE
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)) * SCALE).cast("int")).alias("x"))


def split(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of components as (part, row, component of the part), filled up with zeros."""
    n, d = x.shape
    width = -(-d // parts)
    full = np.zeros((n, parts * width), np.int64)
    full[:, :d] = x
    return np.ascontiguousarray(full.reshape(n, parts, width).transpose(1, 0, 2))


def far_apart(entries: np.ndarray, pivots: int) -> np.ndarray:
    """So many of the entries, each the one farthest from those before it (the first: from the mean)."""
    e = entries.astype(float)
    away = ((e - e.mean(0)) ** 2).sum(1)
    out = [int(np.argmax(away))]
    near = np.full(len(e), np.inf)
    for _ in range(min(pivots, len(e)) - 1):
        near = np.minimum(near, ((e - e[out[-1]]) ** 2).sum(1))
        out.append(int(np.argmax(near)))
    return entries[out]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2).astype(float))


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and exact squared distance to each row's nearest entry, and how many distances were computed."""
    n = len(x)
    entry_pivots = distances(entries, pivots)
    low = np.zeros((n, len(entries)))
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None].astype(float), entry_pivots[None, :, p]
        np.maximum(low, np.abs(a - b) - (a + b) * MARGIN, out=low)
    order = np.argsort(low, axis=1, kind="stable")
    low = np.take_along_axis(low, order, 1) ** 2
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    rows, done = np.arange(n), 0
    for r in range(len(entries)):
        rows = rows[low[rows, r] <= best[rows]]
        if not len(rows):
            break
        e = order[rows, r]
        d = ((x[rows] - entries[e]) ** 2).sum(1)
        done += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], e[better]
    return index, best, done


def _matrix(column: pa.ListArray, d: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d).astype(kind, copy=False)


class Coder:
    """Codebooks (part, entry, component), and the pivots that stay as they were first chosen."""

    def __init__(self, first: np.ndarray, parts: int, pivots: int):
        self.length = first.shape[1]
        self.books = split(first, parts)
        self.pivots = [far_apart(b, pivots) for b in self.books]

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([distances(part, p) for part, p in zip(split(x, len(self.books)), self.pivots, strict=True)], axis=1).astype(np.float32)

    def assign(self, x: np.ndarray, pivot_distances: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(part, parts, index, squared distance, distances computed) of each position."""
        parts = split(x, len(self.books))
        per = self.pivots[0].shape[0]
        for p, part in enumerate(parts):
            yield p, part, *nearest(part, pivot_distances[:, p * per : (p + 1) * per], self.books[p], self.pivots[p])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _chunks(batch: pa.RecordBatch, at: int, coder: Coder):
    per = sum(len(p) for p in coder.pivots)
    for i in range(0, batch.num_rows, CHUNK_ROWS):
        part = batch.slice(i, CHUNK_ROWS)
        yield _matrix(part.column(at), coder.length, np.int64), _matrix(part.column(at + 1), per, np.float32)


def round_sums(kept: DataFrame, coder: Coder) -> DataFrame:
    """(part, entry, place, n, total): counts and component sums of the parts assigned to each entry; a few rows a task."""
    fields = T._parse_datatype_string("part int, entry int, place int, n long, total long")
    held = kept.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        parts, entries, width = c.books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for x, near in _chunks(batch, 0, c):
                for p, part, index, _, _ in c.assign(x, near):
                    n[p] += np.bincount(index, minlength=entries)
                    order = np.argsort(index, kind="stable")
                    cut = np.flatnonzero(np.diff(index[order], prepend=-1))
                    total[p, index[order][cut]] += np.add.reduceat(part[order], cut, axis=0)
        part, entry, place = np.nonzero(np.broadcast_to(n[:, :, None] > 0, total.shape))
        cols = [part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), n[part, entry], total[part, entry, place]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=fields.names)

    return kept.select("x", "near").mapInArrow(run, fields).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(kept: DataFrame, coder: Coder, rounds: int = ROUNDS) -> Coder:
    for _ in range(rounds):
        for r in round_sums(kept, coder).collect():  # one row a component of the codebooks at most
            coder.books[r.part, r.entry, r.place] = r.total // r.n
    return coder


def encode(kept: DataFrame, coder: Coder) -> DataFrame:
    """(id, label, code, error, evaluated): indexes in part order as hex, exact squared error, and how many distances it took."""
    held = kept.sparkSession.sparkContext.broadcast(coder)

    def run(batch: pa.RecordBatch) -> dict:
        c = held.value
        codes, errors, counts = [], [], []
        for x, near in _chunks(batch, 2, c):
            code, error, n = np.empty((len(x), len(c.books)), np.uint8), np.zeros(len(x), np.int64), 0
            for p, _, index, best, done in c.assign(x, near):
                code[:, p] = index
                error += best
                n += done
            codes += [r.tobytes().hex() for r in code]
            errors.append(error)
            counts += [n / max(1, len(x))] * len(x)
        return {"id": batch.column(0), "label": batch.column(1), "code": codes, "error": np.concatenate(errors) if errors else [], "evaluated": counts}

    fields = [kept.schema["id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("evaluated", T.DoubleType())]
    return map_batches(kept.select("id", "label", "x", "near"), run, fields)


def with_label_error(coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """coded with the sum of error over equal labels (nulls together) as label_error."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.withColumnRenamed("label", "of")
    if totals.limit(broadcast_labels + 1).count() <= broadcast_labels:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    spread = totals.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of"))).drop("of", "salt", "salt_of")


def product_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """Per kept row: id, code, error, label_error, codebooks_sha256, evaluated (mean number of distances, of parts * entries)."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    scratch = Scratch(df.sparkSession, "laesa")
    whole = integers(df, id_col, vec_col, label_col)
    first = whole.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    length = len(first[0].x) if first else parts
    rows = whole.where(F.size("x") == length)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    coder = Coder(np.array([r.x for r in start], np.int64).reshape(-1, length), parts, pivots) if start else None
    if coder is None:
        made = rows.select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), F.lit(0.0).alias("evaluated"))
        return made.withColumnRenamed("id", id_col)
    held = df.sparkSession.sparkContext.broadcast(coder)

    def measure(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        made = [held.value.to_pivots(_matrix(batch.column(2).slice(i, CHUNK_ROWS), length, np.int64)) for i in range(0, n, CHUNK_ROWS)]
        flat = np.concatenate(made) if made else np.empty((0, 1), np.float32)
        near = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
        return dict(zip(("id", "label", "x"), batch.columns, strict=True)) | {"near": near}

    fields = [*(rows.schema[c] for c in ("id", "label", "x")), T.StructField("near", T.ArrayType(T.FloatType()))]
    kept = scratch.put("near", map_batches(rows, measure, fields))
    train(kept, coder, rounds)
    coded = scratch.put("codes", encode(kept, coder))
    out = with_label_error(coded).withColumn("codebooks_sha256", F.lit(coder.sha256()))
    return out.select("id", "code", "error", "label_error", "codebooks_sha256", "evaluated").withColumnRenamed("id", id_col)
