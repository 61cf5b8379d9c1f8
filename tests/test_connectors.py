"""Sources of bars: pruning, units, forming bars, fallback by symbol and by gap, listing and the universe."""

import pytest
from pyspark.sql import functions as F

from barloom.sources import connectors as c
from barloom.sources.store import BAR_COLUMNS

DAY = 86400


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, d * DAY, 1.0 + d, 2.0 + d, 0.5 + d, 1.5 + d, 100.0 * (d + 1), 10.0 * d) for s in ("sh600000", "sz000001", "sz300002", "bj430001") for d in range(800)]
    return spark.createDataFrame(rows, c.SCHEMA)


@pytest.fixture(scope="module")
def places(spark, bars, tmp_path_factory):
    at = tmp_path_factory.mktemp("sources")
    c.write_files(bars.where("symbol <> 'sz300002' AND ts % 10 = 0 AND ts / 86400 % 5 <> 0"), f"file://{at}/a")
    c.write_files(bars.withColumn("volume", F.col("volume") / 100).drop("amount"), f"file://{at}/b", "period")
    return c.FileConnector("a", f"file://{at}/a"), c.FileConnector("b", f"file://{at}/b", "period", "Second", volume_unit=100.0)


def rows(df):
    return sorted(tuple(r) for r in df.select(*BAR_COLUMNS).collect())


def test_round_trip_and_pruning(spark, bars, places):
    a, b = places
    assert b.read(spark).count() == bars.count() and a.read(spark).select("symbol").distinct().count() == 3
    assert a.read(spark).rdd.getNumPartitions() == 3 and b.read(spark).rdd.getNumPartitions() == 3  # 800 days lie in three years
    assert a.bars(spark, symbols=["sh600000"]).rdd.getNumPartitions() == 1
    assert b.bars(spark, since=0, until=100 * DAY).rdd.getNumPartitions() == 1
    assert b.bars(spark, since=360 * DAY, until=370 * DAY).rdd.getNumPartitions() == 2
    got = b.bars(spark, symbols=["sz000001", "none"], since=365 * DAY, until=368 * DAY)
    want = bars.where("symbol = 'sz000001' AND ts BETWEEN 365 * 86400 AND 368 * 86400").withColumn("amount", F.col("close") * F.col("volume"))
    assert rows(got) == rows(want)
    assert a.read(spark).where("symbol = 'sh600000' AND ts > 86400 AND ts < 345600 AND close > 3").select("ts").collect() == [(2 * DAY,), (3 * DAY,)]
    assert a.bars(spark, symbols=["none"]).count() == 0


def test_last_and_forming_bars(spark, places):
    _, b = places
    got = b.bars(spark, symbols=["sh600000"], last=3, closed_by=101 * DAY - 1)
    assert sorted(r.ts // DAY for r in got.collect()) == [97, 98, 99]
    assert sorted(r.ts // DAY for r in b.bars(spark, symbols=["sh600000"], last=1, closed_by=101 * DAY).collect()) == [100]


def test_fallback(spark, bars, places):
    reg = c.Registry(*places)
    got = {(r.symbol, r.ts // DAY): r.source for r in reg.bars(spark).collect()}
    assert {s for (k, _), s in got.items() if k == "sh600000"} == {"a"} and {s for (k, _), s in got.items() if k == "sz300002"} == {"b"}
    assert ("sh600000", 5) not in got and len([k for k in got if k[0] == "sz300002"]) == 800
    full = reg.bars(spark, fill_gaps=True)
    assert full.count() == bars.count()
    source = {(r.symbol, r.ts // DAY): r.source for r in full.collect()}
    assert source[("sh600000", 5)] == "b" and source[("sh600000", 6)] == "a"
    assert {r.source for r in c.with_priority(reg, "b").bars(spark).collect()} == {"b"}
    assert reg.bars(spark, kinds=["a"]).select("source").distinct().collect() == [("a",)]


def test_registry(spark, bars, places):
    gone = c.FileConnector("gone", "file:///nowhere/at/all")
    reg = c.Registry(*places, gone)
    listed = reg.listing(spark)
    assert [(x["id"], x["label"], x["available"]) for x in listed] == [("a", "a", True), ("b", "Second", True), ("gone", "gone", False)] and "nowhere" in listed[2]["hint"]
    assert reg.bars(spark).where("source = 'gone'").count() == 0
    for bad in (lambda: reg.get("x"), lambda: reg.add(places[0]), lambda: c.Registry(gone).bars(spark), lambda: c.FileBarsReader({"path": "/", "layout": "x"})):
        with pytest.raises(ValueError):
            bad()


def test_universe(spark, bars, places):
    extra = c.FrameConnector("extra", bars.withColumn("symbol", F.lit("600519.SH")))
    reg = c.Registry(*places, extra)
    got = {r.symbol: (r.market, r.sources) for r in c.universe(spark, reg, least=3).collect()}
    assert got == {"sh600000": ("sh", ["a", "b"]), "sz000001": ("sz", ["a", "b"]), "sz300002": ("sz", ["b"]), "sh600519": ("sh", ["extra"])}
    with pytest.raises(RuntimeError, match="only 4 instruments"):
        c.universe(spark, reg)
