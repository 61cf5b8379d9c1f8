"""Audits that have to catch a look ahead, data sets under fingerprints, stores through their log, reports, and the small steps."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import audit, gates
from barloom.sources import cache, reports, store

P = "over (partition by symbol order by ts)"


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, t * 86400, *[10.0 + (t * k + len(s)) % 17 for k in (3, 5, 7, 11)], 100.0 + t % 13, 1e3 + t) for s in ("a", "bb", "ccc") for t in range(260)]
    return spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double, amount double")


def verdicts(df):
    return {(r.column, r.symbol): r for r in df.collect()}


def test_look_ahead_is_caught(spark, bars):
    made = lambda b: b.selectExpr("symbol", "ts", f"avg(close) over (partition by symbol order by ts rows 9 preceding) AS honest", f"lead(close, 3) {P} AS ahead", "close / max(close) over (partition by symbol) AS scaled")  # noqa: E731, F541
    got = verdicts(audit.causality(made, bars))
    assert all(got[("honest", s)].passed and got[("honest", s)].max_rewrite == 0 and got[("honest", s)].n_compared == 160 for s in ("a", "bb", "ccc"))
    assert not any(r.passed for (c, _), r in got.items() if c != "honest")
    assert got[("ahead", "a")].first_rewrite == 157 * 86400 and got[("scaled", "a")].first_rewrite == 0
    lost = audit.causality(lambda b: b.selectExpr("symbol", "ts", "CASE WHEN max(close) over (partition by symbol) > 30 THEN null ELSE close END AS gone"), bars)
    assert verdicts(lost)[("gone", "a")].max_rewrite == float("inf")


def test_pulse_tells_which_bar_earns(spark, bars):
    panel = bars.selectExpr("symbol", "ts", "close", "CASE WHEN ts / 86400 % 3 = 0 THEN 1e0 ELSE -0.5e0 END AS f")
    step = f"close / lag(close) {P} - 1e0"
    late = lambda p: p.selectExpr("symbol", "ts", "f AS want", f"coalesce(lag(f) {P}, 0e0) AS held", f"coalesce(lag(f) {P} * ({step}), 0e0) AS pnl")
    same = lambda p: p.selectExpr("symbol", "ts", "f AS want", "f AS held", f"coalesce(f * ({step}), 0e0) AS pnl")
    good, bad = audit.pulse(late, panel, (0.4, 0.8)).collect(), audit.pulse(same, panel, (0.4, 0.8)).collect()
    assert len(good) == 6 and all(r.passed and r.earned == pytest.approx(r.before) for r in good)
    assert not any(r.passed for r in bad if r.before != r.same) and any(r.before != r.same for r in bad)


def test_content_doesnt_depend_on_order(spark, bars):
    base = cache.content(bars)
    assert base == cache.content(bars.orderBy(F.desc("close")).repartition(7)) == cache.content(bars.select(*reversed(bars.columns)))
    changed = bars.withColumn("close", F.when((F.col("ts") == 0) & (F.col("symbol") == "a"), 0.0).otherwise(F.col("close")))
    assert len({base, cache.content(changed), cache.content(bars.limit(700)), cache.content(bars.union(bars)), cache.content(bars.withColumnRenamed("close", "x")), cache.content(bars.limit(0))}) == 6


def test_cached_set(spark, bars, tmp_path, monkeypatch):
    held = store.BarStore(spark, f"file://{tmp_path}/bars", 4)
    held.upsert(bars)
    sets, built = cache.DatasetCache(spark, f"file://{tmp_path}/sets"), []

    def build():
        built.append(1)
        return held.load().groupBy("symbol").agg(F.sum("close").alias("x"))

    first = sets.get({"horizon": 5}, [held.fingerprint()], build).collect()
    with monkeypatch.context() as m:
        m.setattr(store.BarStore, "load", lambda *a: pytest.fail("the source was read"))
        again = cache.DatasetCache(spark, f"file://{tmp_path}/sets").get({"horizon": 5}, [store.BarStore(spark, f"file://{tmp_path}/bars", 4).fingerprint()], build).collect()
    assert sorted(again) == sorted(first) and len(built) == 1
    sets.get({"horizon": 10}, [held.fingerprint()], build)
    before = held.fingerprint()
    held.upsert(bars.limit(0))
    held.upsert(bars.where("symbol = 'a'"))  # the same bars again: other files, the same content
    assert held.fingerprint() == before and len(built) == 2
    held.upsert(bars.where("symbol = 'bb' AND ts = 86400").withColumn("close", F.lit(99.0)))
    assert held.fingerprint() != before
    sets.get({"horizon": 5}, [held.fingerprint()], build)
    assert len(built) == 3
    with pytest.raises(ZeroDivisionError):
        sets.get({"horizon": 7}, ["x"], lambda: 1 / 0)
    assert sets.find(sets.key({"horizon": 7}, "x")) is None


def test_factor_and_label_stores(spark, bars, tmp_path):
    f = store.FactorStore(spark, f"file://{tmp_path}/f")
    assert f.load().count() == 0
    factor = bars.select("symbol", "ts", F.col("close").alias("factor"))
    fid = f.save(factor, [1, 2], "v1", report={"ic": 0.1})
    old = f.load(fid)
    assert f.save(factor.withColumn("factor", F.lit(1.0)), [1, 2], "v1", report={"ic": 0.2}) == fid
    assert old.agg(F.max("factor")).first()[0] > 1 and f.load(fid).agg(F.max("factor")).first()[0] == 1  # an old reader isn't disturbed
    other = f.save(factor.limit(3), [3], "v1", report={"ic": 0.9})
    assert [r.factor_id for r in f.listing().collect()] == [other, fid] and f.index().count() == 2 and f.load().count() == factor.count() + 3
    labels = cache.LabelStore(spark, f"file://{tmp_path}/l")
    assert labels.load(5) is None and labels.horizons() == []
    for h, x in ((5, 1.0), (10, 2.0), (5, 3.0)):
        labels.save(h, bars.select("symbol", "ts").withColumn("label", F.lit(x)))
    assert labels.horizons() == [5, 10] and labels.load(5, "a").select("label").distinct().collect() == [(3.0,)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b|c", 2, 0.5, [1, 2]), ("a", 1, None, None)], "name string, n int, x double, l array<int>")
    out = reports.write_report(df, f"file://{tmp_path}/r", "Factors", order=["n"])
    assert [o.rsplit("/", 1)[1] for o in out] == ["csv", "json", "md"]
    back = spark.read.option("header", True).option("inferSchema", True).csv(out[0])
    assert sorted((r.name, r.n, r.x) for r in back.collect()) == [("a", 1, None), ("b|c", 2, 0.5)]
    assert sorted(spark.read.json(out[1]).select("name", "l").collect(), key=lambda r: r.name) == [("a", None), ("b|c", [1, 2])]
    page = "\n".join(r.value for r in spark.read.text(out[2]).collect())
    assert page.startswith("# Factors") and page.index("| a | 1 |") < page.index("b\\|c | 2 | 0.5000") and "2 rows" in page
    with pytest.raises(ValueError, match="over 2000 rows"):
        reports.markdown(spark.range(2001).toDF("n"), "t")


def test_steps(spark, bars):
    a = spark.createDataFrame([("a", t, float(t)) for t in range(5)] + [("b", 1, 1.0)], "symbol string, ts long, x double")
    b = spark.createDataFrame([("a", t, float(t)) for t in (10, 20, 30)] + [("c", 1, 1.0)], "symbol string, ts long, y double")
    assert sorted((r.ts, r.b_ts) for r in gates.tail_join(a, b).collect()) == [(2, 10), (3, 20), (4, 30)] and gates.tail_join(a, b, least=4).count() == 0
    axis = spark.createDataFrame([(0,), (1,), (7,)], "ts long")
    assert sorted((r.symbol, r.ts, r.x) for r in gates.on_axis(a, axis, {"x": -1.0}).collect()) == [("a", 0, 0.0), ("a", 1, 1.0), ("a", 7, -1.0), ("b", 0, -1.0), ("b", 1, 1.0), ("b", 7, -1.0)]
    assert gates.common(a, b).collect() == [("a",)] and gates.over_threshold(a, 3.0, "x").count() == 2
    panel = bars.selectExpr("symbol", "ts", "close * 2 AS u", "1e0 AS v", f"close AS y")  # noqa: F541
    assert [r.best for r in gates.best_correlation(panel, ["v", "u"]).collect()] == [pytest.approx(1.0)] * 3
    assert {r.best for r in gates.best_correlation(panel, ["v"]).collect()} == {0.0}
    gate = gates.quick_gate(bars)
    assert gate.count() == 3 and gate.where("passed <> (best >= 0.03)").count() == 0
