"""Small steps between a panel and what is decided on it: quick gate, thresholds, tails, axes and common members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import reducers
from barloom.plans.formula_b import ParamFormula
from barloom.plans.staged import SPARK, Plan
from barloom.sources.bars import numbered

# Formulas of the quick gate as (indicator, bars, reducer), the bars that count, and the gate.
QUICK = (("rsi14", 20, "Quantile"), ("macd_hist", 20, "Slope"), ("amt_vol_euclid", 20, "AC1"), ("vol_regime", 60, "Std"), ("ret20", 20, "Momentum"))
QUICK_BARS, QUICK_GATE = 60, 0.03


def quick_panel(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """(symbol, ts, q0 .. q4, y): the quick gate's formulas in one plan; y is the return ahead, 0 where it isn't known."""
    p = Plan(SPARK)
    cols = {f"q{i}": p.let(reducers.evaluate(p, ParamFormula(a, None, w, None, None, None, 1, op, None, 0))) for i, (a, w, op) in enumerate(QUICK)}
    return p.spark(numbered(bars), cols | {"y": p.let(f"coalesce(lead(close, {horizon}) over ({p.k.P}) / close - 1e0, 0e0)")})


def best_correlation(panel: DataFrame, names: list[str], last: int = QUICK_BARS, label: str = "y") -> DataFrame:
    """(symbol, best): largest absolute correlation of the columns with the label over each symbol's last bars; 0 where nothing varies."""
    late = panel.withColumn("_k", F.expr("row_number() over (partition by symbol order by ts desc)")).where(F.col("_k") <= last)
    one = lambda c: F.coalesce(F.when(F.stddev_pop(c) * F.stddev_pop(label) > 1e-9, F.abs(F.covar_pop(c, label) / (F.stddev_pop(c) * F.stddev_pop(label)))), F.lit(0.0))
    made = [one(c) for c in names]
    return late.groupBy("symbol").agg((F.greatest(*made) if len(made) > 1 else made[0]).alias("best"))


def quick_gate(bars: DataFrame, gate: float = QUICK_GATE, horizon: int = 5, last: int = QUICK_BARS) -> DataFrame:
    """(symbol, best, passed): whether any of the fixed formulas says something about a symbol of late, before a search is spent on it."""
    found = best_correlation(quick_panel(bars, horizon), [f"q{i}" for i in range(len(QUICK))], last)
    return found.withColumn("passed", F.col("best") >= gate)


def over_threshold(scores: DataFrame, threshold: float, column: str = "score") -> DataFrame:
    """Rows whose score is at least so far from 0."""
    return scores.where(F.abs(column) >= threshold)


def tail_join(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "ts", least: int = 1) -> DataFrame:
    """a's and b's rows matched from the end, the last with the last: for series whose times are not known to agree.

    b's order column comes as `b_<order>`; symbols with fewer than `least` common rows are left out.  Both sides are
    numbered and joined by the same keys, so that one shuffle of each serves both.
    """
    by = ", ".join(keys)
    count = lambda df: df.withColumn("_end", F.expr(f"row_number() over (partition by {by} order by {order} desc)"))
    right = count(b).withColumnRenamed(order, f"b_{order}")
    met = count(a).join(right, [*keys, "_end"]).drop("_end")
    return met if least <= 1 else met.withColumn("_n", F.expr(f"count(*) over (partition by {by})")).where(F.col("_n") >= least).drop("_n")


def on_axis(panel: DataFrame, axis: DataFrame, fill: dict[str, float] | None = None) -> DataFrame:
    """The panel (symbol, ts, ...) at each time of the axis (ts) for each symbol: missing rows are null, or what fill says."""
    times = axis.select(F.collect_set("ts").alias("ts"))  # one row: an axis has as many times as one symbol has bars
    wanted = panel.select("symbol").distinct().join(times).select("symbol", F.explode("ts").alias("ts"))
    out = wanted.join(panel, ["symbol", "ts"], "left")
    return out.fillna(fill) if fill else out


def common(*panels: DataFrame, key: str = "symbol") -> DataFrame:
    """Keys that all the panels have."""
    out = panels[0].select(key).distinct()
    for p in panels[1:]:
        out = out.intersect(p.select(key))
    return out
