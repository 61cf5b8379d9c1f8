"""Packing into optimal length buckets.

Documents are cut into pieces of at most CONTEXT tokens.  The histogram of piece lengths has at most CONTEXT rows,
whatever the input's size, so it goes to the driver, where dynamic programming finds the bucket bounds with the
least padding.  Pieces get consecutive places in their bucket, and places form batches of as many rows as the token
budget holds.  Places are numbered in parts of bounded size: within a part by row number, and before it by the sum
of the earlier parts' counts, so a bucket may hold any share of the rows.

Defined results: texts without tokens have no piece; repeated rows are packed each (which of them comes first is open,
as they are the same); a null id is packed like others; texts of any length are cut into pieces; an empty input gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import Scratch
from barloom.llm.tokens import VOCABULARY, with_tokens

CONTEXT = 2048
BUCKETS = 8
BATCH_TOKENS = 65_536
PART_ROWS = 100_000


def bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """At most `buckets` upper bounds, the largest length among them, with the least total padding; of equal ones the first found with fewer buckets."""
    size = np.array(sorted(histogram), np.int64)
    n = len(size)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum([histogram[x] for x in size.tolist()])]).astype(float)
    tokens = np.concatenate([[0], np.cumsum([histogram[x] * x for x in size.tolist()])]).astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    from_: list[np.ndarray] = []
    found = (np.inf, 0)
    for k in range(1, min(buckets, n) + 1):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            now[j] = cost[cut[j]]
        best = now
        from_.append(cut)
        if best[n] < found[0]:
            found = (best[n], k)
    out, j = [], n
    for k in range(found[1] - 1, -1, -1):
        out.append(int(size[j - 1]))
        j = int(from_[k][j])
    return out[::-1]


def pieces(docs: DataFrame, id_col: str, text_col: str, context: int, vocabulary: str) -> DataFrame:
    """(id, piece, start, n_tokens): consecutive cuts of context tokens."""
    counted = with_tokens(docs, [id_col], text_col, vocabulary, "_n").where("_n > 0")
    cut = counted.select(id_col, "_n", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1), F.lit(context).cast("long"))).alias("start"))
    return cut.select(id_col, (F.col("start") / context).cast("long").alias("piece"), "start", F.least(F.lit(context).cast("long"), F.col("_n") - F.col("start")).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, part_rows: int = PART_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece: id, piece, start, n_tokens, bucket_len, batch (number in its bucket), slot, padding."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.put("pieces", pieces(docs.select(id_col, text_col), id_col, text_col, context, vocabulary))
    counted = {r.n_tokens: r.n for r in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    tops = bounds(counted, buckets)
    if not tops:
        empty = F.lit(None).cast("long")
        return cut.select("*", *[empty.alias(c) for c in ("bucket_len", "batch", "slot", "padding")])
    rows = {t: 0 for t in tops}
    for n, c in counted.items():
        rows[next(t for t in tops if t >= n)] += c
    bucket, parts, per = (F.coalesce(*[F.when(F.col("n_tokens") <= t, F.lit(f(t)).cast("long")) for t in tops]) for f in (lambda t: t, lambda t: max(1, -(-rows[t] // part_rows)), lambda t: max(1, batch_tokens // t)))
    dealt = cut.withColumns({"bucket_len": bucket, "part": F.pmod(F.xxhash64(id_col, "piece"), parts), "per": per})
    before = Window.partitionBy("bucket_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket_len", "part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("bucket_len", "part").orderBy(id_col, "piece")
    placed = dealt.withColumn("rn", F.row_number().over(inside)).join(starts, ["bucket_len", "part"]).withColumn("place", F.col("first") + F.col("rn") - 1)
    batch = F.floor(F.col("place") / F.col("per")).cast("long")
    return placed.select(id_col, "piece", "start", "n_tokens", "bucket_len", batch.alias("batch"), (F.col("place") - batch * F.col("per")).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
