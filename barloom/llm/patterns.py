"""Best-fit packing by patterns: few documents that fill a sequence, with repeat counts by non-negative least squares.

Documents become token ids and an end id; those above the context are cut into pieces of it.  The histogram of piece
lengths has at most `context` rows, whatever the input's size, and goes to the driver.  There lengths are put in BINS
classes, all patterns of up to FEW classes whose sizes add up to the context are listed, and Lawson and Hanson's method
finds the repeat counts whose lengths fit the histogram best (errors counted in tokens).  The counts are rounded down,
and to what is left, largest first; each repeat takes exact lengths, longest first in its class, and for its last class the
longest that fits.  What remains, and the space that patterns leave, is packed best fit, longest first, on counts: a run
of equal lengths goes into a run of equal spaces.

The plan is a table of entries (length, first number, copies, ...); a space that takes a length is left with less than
half of itself, so there are at most log2(context) entries for each run of spaces.  Pieces are numbered within their
length (in parts of bounded size, see ``packing``), and a binary search among the entries gives each its place.

Defined results: null and empty texts are one piece, the end id; repeated rows and null ids are packed like others; texts of
any length are cut; an empty input gives no rows; other columns are not looked at.  Which of equally long pieces
gets which of their places is open in no way but for repeated rows, which are the same.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.arrow import map_batches
from barloom.llm.shared import Scratch
from barloom.llm.wordtokens import ids_bytes, vocabulary_path

CONTEXT = 4096
END_ID = 1
BINS = 128
FEW = 4
PART_ROWS = 100_000


def patterns(total: int, few: int = FEW) -> list[tuple[int, ...]]:
    """All falling sequences of one to `few` positive classes that add up to total."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left <= most:
            out.append((*head, left))
        if len(head) + 1 < few:
            for x in range(min(most, left - 1), 0, -1):
                if x * (few - len(head)) < left:
                    break
                grow((*head, x), left - x, x)

    grow((), total, total)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x with the least |a x - b| (Lawson and Hanson 1974, active sets)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a).max(initial=0.0))) * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(6 * len(b)):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tolerance:
            break
        passive[j] = True
        while True:
            which = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, which], b, rcond=None)[0]
            low = s <= 0
            if not low.any():
                break
            step = np.min(x[which][low] / np.maximum(x[which][low] - s[low], 1e-300))
            x[which] += step * (s - x[which])
            out = which[(x[which] <= 1e-12) & low]
            if not len(out):
                out = which[low][:1]
            x[out], passive[out] = 0.0, False
        x[:] = 0.0
        x[which] = s
    return x


class _Plan:
    """Entries of the plan, and per length how many pieces are left and the next number."""

    def __init__(self, histogram: dict[int, int], context: int):
        self.context = context
        self.left = [0] * (context + 1)
        for n, c in histogram.items():
            self.left[n] += c
        self.next = [0] * (context + 1)
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.spaces: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space -> (first sequence, copies)
        self.sizes: list[int] = []

    def place(self, length: int, copies: int, per: int, sequence: int, offset: int) -> None:
        """`per` pieces of a length side by side, from offset on, in each of `copies` sequences."""
        self.entries.append((length, self.next[length], per, sequence, offset))
        self.next[length] += copies * per
        self.left[length] -= copies * per

    def open(self, copies: int) -> int:
        self.sequences += copies
        return self.sequences - copies

    def leave(self, space: int, sequence: int, copies: int) -> None:
        if space and copies:
            if not self.spaces[space]:
                bisect.insort(self.sizes, space)
            self.spaces[space].append((sequence, copies))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The smallest space of at least so much, off the list."""
        at = bisect.bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        space = self.sizes[at]
        sequence, copies = self.spaces[space].pop()
        if not self.spaces[space]:
            del self.sizes[at]
        return space, sequence, copies

    def repeat(self, pattern: tuple[int, ...], copies: int, width: int) -> None:
        """`copies` sequences with one piece of each class, longest first; the last is the longest that fits."""
        groups = [(self.open(copies), copies, 0)]
        for i, c in enumerate(pattern):
            last, grown = 0 < i == len(pattern) - 1, []
            for sequence, n, offset in groups:
                length = self.context - offset if last else min(c * width, self.context - offset)
                while n:
                    while length and not self.left[length]:
                        length -= 1
                    if not length:
                        grown.append((sequence, n, offset))
                        break
                    t = min(n, self.left[length])
                    self.place(length, t, 1, sequence, offset)
                    grown.append((sequence, t, offset + length))
                    sequence, n = sequence + t, n - t
            groups = grown
        for sequence, n, offset in groups:
            self.leave(self.context - offset, sequence, n)

    def residue(self) -> None:
        for length in range(self.context, 0, -1):
            while self.left[length]:
                c, found = self.left[length], self.take(length)
                if found is None:
                    m = self.context // length
                    for copies, per in ((c // m, m), (1, c % m)):
                        if copies and per:
                            first = self.open(copies)
                            self.place(length, copies, per, first, 0)
                            self.leave(self.context - per * length, first, copies)
                    continue
                space, first, copies = found
                m = space // length
                t, per = (min(copies, c // m), m) if c >= m else (1, c)
                self.place(length, t, per, first, self.context - space)
                self.leave(space - per * length, first, t)
                self.leave(space, first + t, copies - t)


def plan(histogram: dict[int, int], context: int = CONTEXT, bins: int = BINS, few: int = FEW) -> tuple[np.ndarray, int]:
    """Rows (length, first number, pieces a sequence, first sequence, offset) by length and number, and the number of sequences."""
    made = _Plan(histogram, context)
    width = -(-context // bins)
    classes = context // width
    counted = [0] * (classes + 1)  # lengths above classes * width are left to the residue
    for n, c in histogram.items():
        if -(-n // width) <= classes:
            counted[-(-n // width)] += c
    listed = [p for p in patterns(classes, few) if all(counted[c] for c in p)]
    if listed:
        a = np.zeros((classes, len(listed)))
        for j, p in enumerate(listed):
            for c in p:
                a[c - 1, j] += c
        scale = max(counted)
        x = nnls(a, np.array([c * counted[c] / scale for c in range(1, classes + 1)]))
        for j in np.argsort(-x, kind="stable").tolist():
            need = {c: listed[j].count(c) for c in listed[j]}
            copies = min(int(x[j] * scale + 1e-6), *(counted[c] // m for c, m in need.items()))
            if copies <= 0:
                continue
            for c, m in need.items():
                counted[c] -= copies * m
            made.repeat(listed[j], copies, width)
    made.residue()
    return np.array(sorted(made.entries), np.int64).reshape(-1, 5), made.sequences


def pieces(docs: DataFrame, id_col: str, text_col: str, context: int, path: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of whole texts."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    end = int(END_ID).to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> dict:
        n, crcs = [], []
        for ids in ids_bytes(batch.column(1).to_pylist(), path):
            ids += end
            n.append(len(ids) // 4)
            crcs.append([zlib.crc32(ids[i : i + 4 * context]) for i in range(0, len(ids), 4 * context)])
        return {"id": batch.column(0), "n": n, "crcs": crcs}

    fields = [source.schema["id"], T.StructField("n", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))]
    cut = map_batches(source, run, fields).select("id", "n", F.posexplode("crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * context
    return cut.select("id", "piece", start.alias("start"), F.least(F.lit(context).cast("long"), F.col("n") - start).alias("length"), "ids_crc32")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, path: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = Scratch(spark, "patterns").put("pieces", pieces(docs, id_col, text_col, context, path or vocabulary_path()))
    counted = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries, _ = plan(counted, context)
    parts = F.element_at(F.lit([max(1, -(-counted.get(n, 0) // part_rows)) for n in range(1, context + 1)]), F.col("length").cast("int"))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("id", "piece"), parts))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    numbered = dealt.withColumn("rn", F.row_number().over(inside)).join(starts, ["length", "part"])
    numbered = numbered.select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rn") - 1).alias("number"))
    held = spark.sparkContext.broadcast(entries)  # bounded by the context, see above

    def run(batch: pa.RecordBatch) -> dict:
        e = held.value
        length, number = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
        key = lambda n, k: (n.astype(np.uint64) << np.uint64(48)) | k.astype(np.uint64)
        at = np.searchsorted(key(e[:, 0], e[:, 1]), key(length, number), "right") - 1
        copy, slot = np.divmod(number - e[at, 1], e[at, 2])
        return dict(zip(names[:5], batch.columns, strict=False)) | {"sequence_id": e[at, 3] + copy, "offset": e[at, 4] + slot * length}

    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    fields = [*(numbered.schema[c] for c in names[:5]), *(T.StructField(c, T.LongType()) for c in names[5:])]
    return map_batches(numbered, run, fields).withColumnRenamed("id", id_col)


def least_sequences(histogram: dict[int, int], context: int = CONTEXT) -> int:
    """A lower bound: tokens, or for any t the pieces above context - t, each alone, and the tokens of those from t up that can't join them (Martello and Toth's L2)."""
    if not histogram:
        return 0
    size = np.array(sorted(histogram), np.int64)
    n = np.array([histogram[x] for x in size.tolist()], np.int64)
    best = 0
    for t in itertools.chain([0], size[size <= context // 2].tolist()):
        big, mid, small = size > context - t, (size > context // 2) & (size <= context - t), (size >= t) & (size <= context // 2)
        free = int(n[mid].sum()) * context - int((size * n)[mid].sum())
        need = max(0, int((size * n)[small].sum()) - free)
        best = max(best, int(n[big].sum() + n[mid].sum()) + -(-need // context))
    return best
