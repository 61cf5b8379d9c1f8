"""Instrument codes: market and number from the forms that users write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalized(frame: DataFrame, column: str) -> DataFrame:
    """frame with market (sh, sz, bj, fut), code, symbol (market and code) and is_index; nulls where no form fits.

    Forms: sh600000, 600000.SH, 600000 (market by its first digits) and futures such as RB2410 or rb0.
    """
    x = F.lower(F.trim(F.col(column)))
    digits = F.regexp_extract(x, r"(\d{6})", 1)
    named = F.coalesce(F.nullif(F.regexp_extract(x, r"^(sh|sz|bj)\.?\d{6}$", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^\d{6}\.(sh|sz|bj)$", 1), F.lit("")))
    bare = F.when(x.rlike(r"^\d{6}$"), F.when(x.rlike("^(6|9|5)"), "sh").when(x.rlike("^(0|1|2|3)"), "sz").when(x.rlike("^(4|8)"), "bj"))
    future = x.rlike(r"^[a-z]{1,2}\d{1,4}$")
    market = F.coalesce(named, bare, F.when(future, F.lit("fut")))
    code = F.when(future, F.upper(x)).when(market.isNotNull(), digits)
    index = (market.eqNullSafe(F.lit("sh")) & code.startswith("000")) | (market.eqNullSafe(F.lit("sz")) & code.startswith("399"))
    return frame.withColumns({"market": market, "code": code, "symbol": F.when(future, code).otherwise(F.concat(market, code)), "is_index": F.coalesce(index, F.lit(False))})
