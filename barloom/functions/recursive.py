"""Recursions per symbol: of maps that can be put together, in windows; else in Arrow batches of one symbol each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.functions.frames import plain


def ema(frame: DataFrame, column: str, span: int, name: str = "ema") -> DataFrame:
    """Exact recursion for series of any length: pandas' unadjusted exponential mean per symbol."""
    schema = T.StructType([*frame.schema.fields, T.StructField(name, T.DoubleType())])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", kind="stable")
        return g.assign(**{name: g[column].ewm(span=span, adjust=False).mean()})

    return frame.groupBy("symbol").applyInPandas(plain(run), schema)


def clamp_ctes(rel: str, want: str, up: str, down: str, part: str = "symbol", bars: int = 1 << 17) -> tuple[str, str]:
    """CTEs that add `held` to the rows of a relation (symbol, ts, ...), and the name of the last: the weight that limits leave.

    A bar makes of the last weight x: min(want, x) at its upper limit, max(want, x) at its lower, else want.  All of these are
    max(lo, min(hi, x)), and so is one after the other; step k puts each bar's map after that of the bar 2^k before, so
    after log2(bars) steps a bar's map reaches back to the last free bar, or to the start, where the weight is 0.
    """
    far = "cast('infinity' as double)"
    over = f"OVER (PARTITION BY {part} ORDER BY ts)"
    out = [f"clamp0 AS (SELECT *, CASE WHEN {up} THEN -{far} ELSE {want} END AS clamp_lo, CASE WHEN {down} THEN {far} ELSE {want} END AS clamp_hi FROM {rel})"]
    for k in range((bars - 1).bit_length()):
        before = [f"coalesce(lag({c}, {1 << k}) {over}, {d}{far})" for c, d in (("clamp_lo", "-"), ("clamp_hi", ""))]
        out.append(f"clamp{k + 1} AS (SELECT * EXCEPT (clamp_lo, clamp_hi), greatest(clamp_lo, least(clamp_hi, {before[0]})) AS clamp_lo, greatest(clamp_lo, least(clamp_hi, {before[1]})) AS clamp_hi FROM clamp{k})")
    out.append(f"clamped AS (SELECT * EXCEPT (clamp_lo, clamp_hi), greatest(clamp_lo, least(clamp_hi, 0e0)) AS held FROM clamp{len(out) - 1})")
    return ", ".join(out), "clamped"


def limit_blocked(weights: DataFrame, limit: float = 0.099, bars: int = 1 << 17) -> DataFrame:
    """Executable weights (ts, symbol, w, ret, held): on a bar at its upper limit no increase, at its lower no decrease.

    Exact while no more than `bars` bars in a row are at a limit.
    """
    ctes, last = clamp_ctes("{weights}", "coalesce(w, 0e0)", f"coalesce(ret, 0e0) >= {limit!r}", f"coalesce(ret, 0e0) <= -{limit!r}", bars=bars)
    return weights.sparkSession.sql(f"WITH {ctes} SELECT * FROM {last}", weights=weights)
