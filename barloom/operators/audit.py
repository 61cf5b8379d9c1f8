"""Audits of causality: does a factor's past change with its future, and which bar does a position earn?

Both take the user's own function of a frame and run it twice on frames that differ in a known way.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Operator = Callable[[DataFrame], DataFrame]
PRICES = ("open", "high", "low", "close")


def with_tail_changed(bars: DataFrame, tail: int, factor: float, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """The last `tail` bars of each symbol with the columns times a factor."""
    late = F.expr("row_number() over (partition by symbol order by ts desc)") <= tail
    return bars.withColumn("_late", late).withColumns({c: F.when(F.col("_late"), F.col(c) * factor).otherwise(F.col(c)) for c in columns}).drop("_late")


def causality(make: Operator, bars: DataFrame, tail: int = 100, factor: float = 1.5, tolerance: float = 1e-9, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """(column, symbol, n_compared, max_rewrite, first_rewrite, passed) of each number column of make(bars), which has symbol and ts.

    make runs on the bars and on the same with their last `tail` prices changed; rows before the tail must be as they were.
    A value that is null in one run only is rewritten by infinity; first_rewrite is the time of the first one.
    """
    a, b = make(bars), make(with_tail_changed(bars, tail, factor, columns))
    names = [f.name for f in a.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "boolean") and f.name not in ("symbol", "ts")]
    early = bars.select("symbol", "ts").withColumn("_k", F.expr("row_number() over (partition by symbol order by ts desc)")).where(F.col("_k") > tail).drop("_k")
    x = a.select("symbol", "ts", F.struct(*names).alias("x"))
    y = b.select("symbol", "ts", F.struct(*names).alias("y"))
    both = early.join(x, ["symbol", "ts"], "left").join(y, ["symbol", "ts"], "left")
    known = lambda c: F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c.cast("double"))

    def rewrite(c: str):
        p, q = known(F.col(f"x.`{c}`")), known(F.col(f"y.`{c}`"))
        return F.when(p.isNull() & q.isNull(), 0.0).when(p.isNull() | q.isNull(), float("inf")).otherwise(F.abs(p - q))

    long = both.select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), rewrite(c).alias("d")) for c in names])).alias("r")).select("symbol", "ts", "r.*")
    out = long.groupBy("column", "symbol").agg(F.count("*").alias("n_compared"), F.max("d").alias("max_rewrite"), F.min(F.when(F.col("d") >= tolerance, F.col("ts"))).alias("first_rewrite"))
    return out.withColumn("passed", F.col("max_rewrite") < tolerance)


def pulse(run: Operator, panel: DataFrame, places: tuple[float, ...] = (0.5, 0.9), size: float = 0.05, tolerance: float = 1e-9) -> DataFrame:
    """(place, symbol, earned, before, same, elsewhere, passed): who earns the one bar that moves.

    run takes a panel (symbol, ts, close and its signals) to rows (symbol, ts, held, pnl) without costs, held being the weight that
    a bar's own return meets.  The close is flat but for one step up, so pnl / size of that bar is the weight that earns it: it has to
    be what the bar before wants (held of that bar's row in ``want``, if run gives such a column, else the held weight
    itself), nothing else may earn, and a bar must not be met by the weight that its own signal asks for.
    """
    numbered = panel.withColumn("_i", F.expr("row_number() over (partition by symbol order by ts) - 1")).withColumn("_n", F.expr("count(*) over (partition by symbol)"))

    def one(place: float) -> DataFrame:
        at = F.floor(F.col("_n") * place)
        flat = numbered.withColumn("close", F.when(F.col("_i") >= at, 100.0 * (1 + size)).otherwise(100.0))
        marks = flat.where(F.col("_i") == at).select("symbol", F.col("ts").alias("at"))
        found = run(flat.drop("_i", "_n"))
        want = "want" if "want" in found.columns else None
        rows = found.join(marks, "symbol").withColumn("last", F.lag(want or "held").over(_by_symbol()))
        hit = F.col("ts") == F.col("at")
        out = rows.groupBy("symbol").agg(
            F.max(F.when(hit, F.col("pnl") / size)).alias("earned"), F.max(F.when(hit, F.col("last") if want else F.col("held"))).alias("before"),
            F.max(F.when(hit, F.col(want) if want else F.lit(None).cast("double"))).alias("same"), F.max(F.when(hit, 0.0).otherwise(F.abs("pnl"))).alias("elsewhere"),
        )
        return out.select(F.lit(float(place)).alias("place"), "*", ((F.abs(F.col("earned") - F.col("before")) < tolerance) & (F.col("elsewhere") < tolerance)).alias("passed"))

    return functools.reduce(DataFrame.unionByName, map(one, places))


def _by_symbol():
    from pyspark.sql import Window

    return Window.partitionBy("symbol").orderBy("ts")
