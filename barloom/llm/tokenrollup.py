"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes becomes signed facts: an insert adds a document's count, a delete takes back all that the
document has in the ledger, a revision does both.  The facts' totals by key are the batch's delta.  Both are written
to a folder of their own, and the batch counts from the moment its log entry appears.  Log entries are numbered; an
entry is written beside the log and renamed to the next free number, which fails if another batch took it, so entries
are whole, batches are one after the other, and one that lost the race is worked out again on the new ledger.  A batch
id that the log has already changes nothing, and a half-written batch is never read.

The ledger is stored in BUCKETS parts by a hash of doc_id; a batch reads only the parts that its documents fall in.
After FOLD batches what the log has is folded: the ledger's facts are summed, the totals too, and an entry of its own names
the result, so that a reader opens one folder and those of the batches since, however long the log is.

Defined results: null source, lang or tokenizer are keys like others; a null count is 0; a delete of an unknown
document takes nothing; several inserts of one document all count (repeated rows too); in one batch taking back comes
before adding; an empty batch is logged and changes nothing; a null doc_id is a document like others; other columns
of the changes are not looked at; other operations than the three are an error.  Ids of any type are kept as text (1
and '1' are the same document).  Texts are not part of it, so their
length doesn't matter.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.log import Log

KEYS = ["source", "lang", "tokenizer"]
FACTS = "doc_id string, source string, lang string, tokenizer string, n_tokens long, sign long, bucket int"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
BUCKETS = 32
FOLD = 32


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fold: int = FOLD):
        self.spark, self.path, self.buckets, self.every = spark, path.rstrip("/"), buckets, fold
        self.log = Log(spark, self.path)

    def batches(self) -> dict[str, str]:
        """Committed batch ids and their folders, in the order of the log."""
        return {e["batch"]: e["folder"] for e in self.log.entries() if "batch" in e}

    def _folders(self) -> list[str]:
        """The last fold, if there is one, and the batches since."""
        entries = self.log.entries()
        last = max((i for i, e in enumerate(entries) if "batch" not in e), default=0)
        return [e["folder"] for e in entries[last:]]

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/data/{f}/{kind}" for f in self._folders()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f) for f in folders])

    def fold(self) -> bool:
        """Sums all facts and totals so far into one entry; False if a batch came in between."""
        number, folder = len(self.log.entries()), uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        summed = self.ledger().groupBy("doc_id", *KEYS, "n_tokens", "bucket").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        summed.repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/facts")
        self.totals().write.parquet(f"{at}/delta")
        done = self.log.append(number, {"folder": folder})
        if not done:
            self.log.delete(f"data/{folder}")
        return done

    def ledger(self) -> DataFrame:
        return self._read("facts", FACTS)

    def _facts(self, changes: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        added = changes.where(F.col("op").isin("insert", "revise")).select("doc_id", *KEYS, "n_tokens", F.lit(1).cast("long").alias("sign"))
        if not self.batches():
            return added.withColumn("bucket", bucket)
        taken = changes.where(F.col("op").isin("delete", "revise")).select(F.col("doc_id").alias("of"), F.col("tokenizer").alias("version"), bucket.alias("b")).distinct()
        parts = [r.b for r in taken.select("b").distinct().collect()]  # at most BUCKETS
        held = self.ledger().where(F.col("bucket").isin(parts)).join(taken, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("tokenizer").eqNullSafe(F.col("version")), "left_semi")
        back = held.groupBy("doc_id", *KEYS, "n_tokens").agg((-F.sum("sign")).alias("sign")).where("sign <> 0")
        return added.unionByName(back.select(*added.columns)).withColumn("bucket", bucket)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: doc_id, op (insert, delete or revise), source, lang, tokenizer, n_tokens.  False: the batch was there."""
        op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no such operation: "), F.coalesce("op", F.lit("null")))))
        changes = changes.select(F.col("doc_id").cast("string").alias("doc_id"), op.alias("op"), *KEYS, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        while batch_id not in self.batches():
            number = len(self.log.entries())
            folder = uuid.uuid4().hex
            at = f"{self.path}/data/{folder}"
            self._facts(changes).repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/facts")
            totals = self.spark.read.schema(FACTS).parquet(f"{at}/facts").groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
            totals.write.parquet(f"{at}/delta")
            if self.log.append(number, {"batch": batch_id, "folder": folder}):
                if len(self._folders()) > self.every:
                    self.fold()
                return True
            self.log.delete(f"data/{folder}")
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys whose documents are all gone have no row."""
        deltas = self._read("delta", TOTALS)
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
