"""OHLCV bars from trade-like tables.

A bar has symbol, ts (epoch seconds of its bucket), open, high, low, close, volume and amount.  Open and close are
the first and last price by a total order, taken with min_by and max_by, so a bar is one hash aggregation with
partial combination and needs no sort of the trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import table

_PX = "p_retailprice * (1e0 - l_discount) * (1e0 + l_tax)"
_WEEK_SPARK = "cast(datediff(to_date(date_trunc('week', l_shipdate)), date'1970-01-01') as bigint) * 86400"
_WEEK_DUCK = "date_diff('day', DATE '1970-01-01', CAST(date_trunc('week', l_shipdate) AS DATE)) * 86400"


def _ohlcv(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    first = F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", first).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.col("px") * F.col("qty")).alias("amount"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select("l_suppkey", "p_brand", F.expr(_WEEK_SPARK).alias("ts"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.expr(_PX).alias("px"), F.col("l_quantity").alias("qty"))


ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of part brands."""
    return _ohlcv(trades(spark, sf_dir).withColumn("symbol", F.col("p_brand")), ["symbol", "ts"], ORDER)


def bars_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of suppliers, with the supplier's region as industry."""
    bars = _ohlcv(trades(spark, sf_dir).withColumn("symbol", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))), ["symbol", "l_suppkey", "ts"], ORDER)
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    where = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"]).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    where = where.select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("industry"))
    return bars.join(where, "l_suppkey", "left").withColumn("industry", F.coalesce("industry", F.lit("Unknown"))).drop("l_suppkey")


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event types; px is 100 + value, volume the number of events."""
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("event_type").alias("symbol"),
        (F.expr("cast(datediff(to_date(ts), date'1970-01-01') as bigint)") * 86400 + F.hour("ts") * 3600).alias("ts"),
        F.col("ts").alias("at"), "event_id", (F.lit(100.0) + F.col("value")).alias("px"), F.lit(1.0).alias("qty"),
    )
    return _ohlcv(rows, ["symbol", "ts"], ["at", "event_id"])


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rn", F.expr("row_number() over (partition by symbol order by ts)"))


_AGGS = "arg_min(px, ord) AS open, max(px) AS high, min(px) AS low, arg_max(px, ord) AS close, sum(qty) AS volume, sum(px * qty) AS amount"
_TRADES = f"SELECT l_suppkey, p_brand, {_WEEK_DUCK} AS ts, row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS ord, {_PX} AS px, l_quantity AS qty FROM lineitem JOIN part ON l_partkey = p_partkey"
BRAND_SQL = f"SELECT p_brand AS symbol, ts, {_AGGS} FROM ({_TRADES}) GROUP BY p_brand, ts"
SUPP_SQL = f"SELECT 'S' || CAST(b.l_suppkey AS VARCHAR) AS symbol, ts, open, high, low, close, volume, amount, coalesce(r_name, 'Unknown') AS industry FROM (SELECT l_suppkey, ts, {_AGGS} FROM ({_TRADES}) GROUP BY l_suppkey, ts) b LEFT JOIN supplier ON s_suppkey = b.l_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
HOUR_SQL = f"SELECT event_type AS symbol, tsx AS ts, {_AGGS} FROM (SELECT event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 AS tsx, row(ts, event_id) AS ord, 100e0 + value AS px, 1e0 AS qty FROM events) GROUP BY event_type, tsx"


def numbered_sql(sql: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({sql})"
