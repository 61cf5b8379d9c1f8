"""Imports every module that registers queries."""

from barloom.operators import backtest, evaluate, fundamentals, intraday, portfolio, quality  # noqa: F401
from barloom.queries import numeric, panel, rewards, steps  # noqa: F401
from barloom.registry import ORACLES, QUERIES  # noqa: F401
