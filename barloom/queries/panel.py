"""Queries of the panel algebra: every operator, feature, indicator and reducer on brand bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import features, indicators, language_a, reducers
from barloom.plans import formula_a, formula_b
from barloom.plans.staged import DUCK, SPARK, Plan
from barloom.registry import query
from barloom.sources import bars


def panel_query(name: str, build: Callable[[Plan], str | dict[str, str]], digits: int = 6) -> None:
    """Registers a query of one column `value` (or several) per bar, and its DuckDB rendering."""

    def render(kit) -> tuple[Plan, dict[str, str]]:
        p = Plan(kit)
        made = build(p)
        made = made if isinstance(made, dict) else {"value": made}
        return p, {n: kit.rounded(p.let(x), digits) for n, x in made.items()}

    plan, out = render(DUCK)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, cols = render(SPARK)
        return p.spark(bars.numbered(bars.bars_brand(spark, sf_dir)), cols)

    query(name, plan.sql(bars.numbered_sql(bars.BRAND_SQL), out))(run)


def operands(p: Plan) -> list[str]:
    """Three inputs of ordinary size: return, relative volume, candle body."""
    return [p.let(f"coalesce(close / {p.k.lag('close', 1)} - 1e0, 0e0)"), p.let(f"volume / ({p.k.mean('volume', 20)} + 1e0) - 1e0"), p.let("(close - open) / open")]


for _name, _op in language_a.OPERATORS.items():
    panel_query(f"op_{_name}", lambda p, n=_name, o=_op: language_a.apply(p, n, *operands(p)[: o.arity]))
for _name, _f in features.FEATURES.items():
    panel_query(f"feat_{_name}", lambda p, f=_f: f.build(p))

_FORMULA = {"A": "ret", "B": "hl_range", "window": 20, "slice": 1.0, "mask_field": None, "mask_rule": None, "mode": 1, "mode1": "Mean", "mode2": None, "B_shift_lag": 0}


def _formula(**over) -> formula_b.ParamFormula:
    return formula_b.ParamFormula(**(_FORMULA | over))


for _name, _f in indicators.INDICATORS.items():
    panel_query(f"ind_{_name}", lambda p, f=_f: f(p))
for _op in formula_b.UNARY:
    panel_query(f"pvm_{_op}", lambda p, o=_op: reducers.evaluate(p, _formula(mode1=o), post=False))
    if _op not in ("Last", "Momentum", "Volatility"):
        panel_query(f"pvm_masked_{_op}", lambda p, o=_op: reducers.evaluate(p, _formula(mode1=o, mask_field="volume", mask_rule="high_0.7"), post=False))
for _op in formula_b.BINARY:
    panel_query(f"pvm_{_op}", lambda p, o=_op: reducers.evaluate(p, _formula(mode=2, mode2=o, B_shift_lag=-2), post=False))
    panel_query(f"pvm_masked_{_op}", lambda p, o=_op: reducers.evaluate(p, _formula(mode=2, mode2=o, window=10, mask_field="rvol", mask_rule="low_0.5"), post=False))
for _w in ("5", "60", "All"):
    panel_query(f"pvm_window_{_w}", lambda p, w=_w: reducers.evaluate(p, _formula(window=w if w == "All" else int(w), slice=0.7 if w != "All" else None, mode1="Range"), post=False))
panel_query("pvm_postprocess", lambda p: reducers.evaluate(p, _formula(mode1="Std"), post=True))
_VOCAB = formula_a.Vocabulary.default()
for _i, _names in enumerate((["RET5", "TS_ZSCORE_20", "CS_RANK"], ["HL_RANGE", "RET", "TS_CORR_10"], ["RSI14", "DELTA", "VOL_Z", "SIGN", "MUL"], ["PRESSURE", "RET", "BOLL_POS", "IF_GT", "EMA_5", "CS_NEUTRALIZE"])):
    panel_query(f"formula_{_i + 1}", lambda p, n=_names: formula_a.execute(p, _VOCAB.encode(n), _VOCAB))
