"""State in event time over a restart, with late and shuffled rows; closed bars put into a store once."""

import numpy as np
import pandas as pd

from barloom.sources.store import BarStore
from barloom.streaming import bars as stream
from barloom.streaming import ordered

DAY = pd.Timedelta(days=1)


def batches():
    """Five files of events: out of order within two days, then one event three days late, then one that moves the watermark past all."""
    draw = np.random.default_rng(2)
    start = pd.Timestamp("2024-01-01")
    f = pd.DataFrame({"event_id": np.arange(200), "event_type": draw.choice(["x", "y"], 200), "value": draw.normal(size=200).round(3), "ts": [start + pd.Timedelta(hours=h) for h in range(200)]})
    f["shown"] = f["ts"] + pd.to_timedelta(draw.uniform(0, 40, 200), unit="h")
    f = f.sort_values("shown").drop(columns="shown")
    parts = [f.iloc[i : i + 50] for i in range(0, 200, 50)]
    late = pd.DataFrame({"event_id": [900], "event_type": ["x"], "value": [1e6], "ts": [start + pd.Timedelta(hours=3)]})
    parts[3] = pd.concat([parts[3], late])
    return [*parts, pd.DataFrame({"event_id": [999, 998], "event_type": ["x", "y"], "value": [0.0, 0.0], "ts": [start + 60 * DAY] * 2})], f


def put(spark, folder, i, part):
    spark.createDataFrame(part).selectExpr("event_id", "cast(ts as timestamp_ntz) AS ts", "event_type", "value").coalesce(1).write.mode("append").parquet(f"file://{folder}/events.parquet/part={i}")


def read(spark, folder):
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/events.parquet/part=*").selectExpr("*", "cast(ts as timestamp) AS at")


def test_restart_and_late_rows(spark, tmp_path):
    parts, whole = batches()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for i, part in enumerate(parts):
        put(spark, tmp_path, i, part)
        if i in (1, 2, 4):  # stopped and started again between them; the second time three files wait
            out = ordered.ordered_ema(read(spark, tmp_path), 5)
            out.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    want = whole.sort_values(["ts", "event_id"])
    want["ema"] = want.groupby("event_type")["value"].transform(lambda x: x.ewm(span=5, adjust=False).mean())
    assert sorted(got["event_id"]) == sorted(whole["event_id"])  # each once; the late row and those not yet past are not there
    np.testing.assert_allclose(got.set_index("event_id")["ema"].sort_index(), want.set_index("event_id")["ema"].sort_index())


def test_closed_bars_go_into_the_store_once(spark, tmp_path):
    parts, whole = batches()
    store = BarStore(spark, f"file://{tmp_path}/store", 2)
    for i, part in enumerate(parts):
        put(spark, tmp_path, i, part)
        if i in (2, 4):
            stream.daily(read(spark, tmp_path)).writeStream.outputMode("append").foreachBatch(stream.upsert_into(store)).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = store.load().toPandas().set_index(["symbol", "ts"])
    whole["day"] = whole["ts"].dt.floor("D").astype("datetime64[s]").astype("int64")
    ordered_rows = whole.sort_values(["ts", "event_id"])
    want = ordered_rows.groupby(["event_type", "day"])["value"].agg(["first", "max", "min", "last", "count"])
    assert len(got) == len(want)  # the forming days of the last events are not there
    for (s, d), r in want.iterrows():
        b = got.loc[(s, d)]
        assert [b["open"], b["high"], b["low"], b["close"], b["volume"]] == r.tolist()
    before = store.log.last()[0]
    stream.upsert_into(store)(store.load(), 7)  # a batch that is sent again
    assert store.load().count() == len(got) and store.log.last()[0] == before + 1
