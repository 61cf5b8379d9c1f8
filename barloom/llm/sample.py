"""A bounded sample of labelled rows, for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str | Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int) -> tuple[list[str], list[int]]:
    """Whole texts and labels (0 or 1) of about `rows` labelled documents that are not held out.

    Ids are chosen by a hash threshold, in the share that makes `rows` of those there are.  The bound keeps
    the driver's memory the same at any size of the tables; only the fit sees the sample.  Rows with a null id
    or label don't count; an id with several labels takes the least.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("id"))
    total = named.count()
    share = min(1.0, rows / total) if total else 1.0
    chosen = named.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * share)).groupBy("id").agg(F.min("y").alias("y"))
    got = F.broadcast(chosen).join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").select("id", "y", F.coalesce("text", F.lit("")).alias("text")).collect()
    got.sort(key=lambda r: (r.id, r.text))
    return [r.text for r in got], [r.y for r in got]
