"""Pandas frames on their way back to Spark."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd


def plain(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """run, with string columns of its result as objects: chunked Arrow strings can't go back in one struct."""

    @functools.wraps(run)
    def out(g: pd.DataFrame) -> pd.DataFrame:
        made = run(g)
        if not len(made):  # untyped empty columns don't convert
            return made.astype({c: object if c == "symbol" else float for c in made.columns})
        return made.astype({c: object for c in made.columns if isinstance(made[c].dtype, pd.StringDtype)})

    out.__annotations__ = {}
    return out
