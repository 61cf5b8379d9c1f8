"""Bars as streams: closed daily bars from finer ones, an upsert sink, and a running EMA per symbol.  All extensions of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.store import BarStore


def events(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """A Parquet folder of events as a stream; NTZ times become times, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily bars of event types; in append mode a day is emitted once it is closed, later events than the watermark are dropped."""
    order = F.struct("at", "event_id")
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 day"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    ).select("symbol", F.unix_timestamp(F.col("window.start")).alias("ts"), "open", "high", "low", "close", "volume", (F.col("close") * F.col("volume")).alias("amount"))


BARS = "symbol string, ts long, open double, high double, low double, close double, volume double, amount double"


def revisions_into(folder: str):
    """For writeStream.foreachBatch in update mode: each batch's bars, whole or still open, in a folder of its own, which
    a batch that is sent again writes anew."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return write


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Of each bar that ``revisions_into`` wrote, the last revision."""
    found = spark.read.schema(f"{BARS}, epoch int").parquet(folder)
    values = ["open", "high", "low", "close", "volume", "amount"]
    return found.groupBy("symbol", "ts").agg(F.max_by(F.struct(*values), "epoch").alias("x")).select("symbol", "ts", *(f"x.{c}" for c in values))


def upsert_into(store: BarStore):
    """For writeStream.foreachBatch; a batch that is sent again writes the same bars."""

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch)

    return write


def running_ema(stream: DataFrame, span: int = 5) -> DataFrame:
    """Exponential mean of values in order of arrival, one number of state per symbol."""
    a = 2.0 / (span + 1.0)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values(["at", "event_id"], kind="stable")
            out = []
            for x in f["value"]:
                last = x if last is None else a * x + (1 - a) * last
                out.append(last)
            yield pd.DataFrame({"symbol": key[0], "event_id": f["event_id"], "ema": out})
        if last is not None:
            state.update((float(last),))

    return stream.groupBy("event_type").applyInPandasWithState(step, "symbol string, event_id long, ema double", "last double", "append", GroupStateTimeout.NoTimeout)
