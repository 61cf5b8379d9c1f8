"""State in event time: an exponential mean in the order of events, whatever order they arrive in.

Rows wait in state until the watermark has passed their time; a timer then puts them in order and moves the mean on.
Rows later than the watermark are dropped by Spark before they get here.  State and timers are in the checkpoint, so a
stream that is stopped and started again gives what it would have given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol string, event_id long, at timestamp, ema double"


class OrderedEma(StatefulProcessor):
    """Rows wait by step of time, so that a timer reads and drops what it is due for and nothing else."""

    def __init__(self, span: int, step_ms: int):
        self.share, self.step = 2.0 / (span + 1.0), step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ema double")
        self.waiting = handle.getMapState("waiting", "due long", "at array<bigint>, event array<bigint>, value array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        for f in rows:
            micros = f["at"].astype("datetime64[us]").astype("int64")
            for due, g in f.assign(micros=micros).groupby(-(-micros // (1000 * self.step)) * self.step):
                at, event, value = g["micros"].tolist(), g["event_id"].astype(int).tolist(), g["value"].astype(float).tolist()
                if self.waiting.containsKey((int(due),)):
                    held = self.waiting.getValue((int(due),))
                    at, event, value = [*held[0], *at], [*held[1], *event], [*held[2], *value]
                else:
                    self.handle.registerTimer(int(due))
                self.waiting.updateValue((int(due),), (at, event, value))
        yield pd.DataFrame({"symbol": pd.Series(dtype=object), "event_id": pd.Series(dtype="int64"), "at": pd.Series(dtype="datetime64[us]"), "ema": pd.Series(dtype=float)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for due in sorted(k[0] for k in self.waiting.keys() if k[0] <= until):
            for at, event, value in sorted(zip(*self.waiting.getValue((due,)), strict=True)):
                last = value if last is None else self.share * value + (1 - self.share) * last
                out.append((key[0], event, pd.Timestamp(at, unit="us"), last))
            self.waiting.removeKey((due,))
        if out:
            self.last.update((float(last),))
        yield pd.DataFrame(out, columns=["symbol", "event_id", "at", "ema"])

    def close(self) -> None:
        pass


def ordered_ema(stream: DataFrame, span: int = 5, late: str = "2 days", step: int = 3600) -> DataFrame:
    """(symbol, event_id, at, ema) of a stream of events (event_type, event_id, at, value), each once the watermark has passed
    the end of its step of so many seconds."""
    use_rocks(stream.sparkSession)
    events = stream.select("event_type", "event_id", "at", "value").withWatermark("at", late)
    return events.groupBy("event_type").transformWithStateInPandas(OrderedEma(span, 1000 * step), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def use_rocks(spark: SparkSession) -> None:
    """Named states and timers need this store; it also keeps state out of the JVM's heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
