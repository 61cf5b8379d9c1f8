"""Language A: 62 operators on panels of bars, in token order.

An operator takes a plan and the columns of its operands and gives an expression or column of its result.  Windows
are zero-padded: a frame at row t < d counts as if d - t zeros came before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from barloom.plans.staged import Plan

Build = Callable[..., str]


@dataclass(frozen=True)
class Operator:
    name: str
    arity: int
    build: Build


OPERATORS: dict[str, Operator] = {}


def operator(name: str, arity: int):
    def keep(f: Build) -> Build:
        OPERATORS[name] = Operator(name, arity, f)
        return f

    return keep


# building blocks -----------------------------------------------------------------------------------------------
def var(p: Plan, x: str, d: int) -> str:
    """Population variance of the zero-padded window, from centred sums: n real values and d - n zeros."""
    v, m, n = p.let(f"var_pop({x}) {p.k.over(d)}"), p.let(f"avg({x}) {p.k.over(d)}"), f"least(rn, {d})"
    return f"({n} * {v} / {d}e0 + {n} * ({d} - {n}) * {m} * {m} / {d * d}e0)"


def std(p: Plan, x: str, d: int) -> str:
    return p.let(f"sqrt({var(p, p.let(x), d)})")


def cov(p: Plan, x: str, y: str, d: int) -> str:
    x, y, n = p.let(x), p.let(y), f"least(rn, {d})"
    c, mx, my = p.let(f"covar_pop({x}, {y}) {p.k.over(d)}"), p.let(f"avg({x}) {p.k.over(d)}"), p.let(f"avg({y}) {p.k.over(d)}")
    return p.let(f"({n} * {c} / {d}e0 + {n} * ({d} - {n}) * {mx} * {my} / {d * d}e0)")


def corr(p: Plan, x: str, y: str, d: int) -> str:
    """0 where either side is constant."""
    sx, sy, c = std(p, x, d), std(p, y, d), cov(p, x, y, d)
    return p.let(f"case when {sx} < 1e-6 or {sy} < 1e-6 then 0e0 else {c} / ({sx} * {sy} + 1e-8) end")


def ema(p: Plan, x: str, span: int) -> str:
    """Exact recursion a x[t] + (1 - a) y[t-1] from y[0] = x[0], at any length.

    Rows are cut into blocks in which (1 - a)^-i grows to about e^600.  Inside a block the recursion is one running sum
    of x[i] (1 - a)^-i; of earlier rows the last block's end is carried on, whose own past weighs e^-600.
    """
    a = 2.0 / (span + 1.0)
    q, size = repr(1 - a), int(600 / -math.log(1 - a))
    x, block, i = p.let(x), p.let(f"floor((rn - 1) / {size}e0)"), p.let(f"cast((rn - 1) % {size} as double)")
    own = p.let(f"sum((case when rn = 1 then 1e0 else {a!r} end) * {x} * pow({q}, -{i})) over (partition by symbol, {block} order by ts rows between unbounded preceding and current row) * pow({q}, {i})")
    ends = p.let(f"case when rn % {size} = 0 then {own} end")
    return p.let(f"{own} + pow({q}, {i} + 1e0) * coalesce({p.k.last(ends)} over ({p.k.P} rows between unbounded preceding and 1 preceding), 0e0)")


def fmax(p: Plan, x: str, d: int) -> str:
    return f"(case when rn < {d} then greatest(max({x}) {p.k.over(d)}, 0e0) else max({x}) {p.k.over(d)} end)"


def fmin(p: Plan, x: str, d: int) -> str:
    return f"(case when rn < {d} then least(min({x}) {p.k.over(d)}, 0e0) else min({x}) {p.k.over(d)} end)"


def rank_share(p: Plan, x: str, d: int) -> str:
    """Share of the window strictly below its last value."""
    below = " + ".join(f"(case when {p.k.lag(x, k, '0e0')} < {x} then 1 else 0 end)" for k in range(1, d))
    return f"({below}) / {d}e0"


def zscore(p: Plan, x: str, d: int) -> str:
    s = std(p, x, d)
    return f"case when {s} < 1e-9 then 0e0 else ({x} - {p.k.mean(x, d)}) / ({s} + 1e-9) end"


def delta(p: Plan, x: str, k: int) -> str:
    return f"coalesce({x} - {p.k.lag(x, k)}, 0e0)"


# elementwise ---------------------------------------------------------------------------------------------------
for _name, _sign in (("ADD", "+"), ("SUB", "-"), ("MUL", "*")):
    operator(_name, 2)(lambda p, x, y, s=_sign: f"{x} {s} {y}")


@operator("DIV", 2)
def _(p: Plan, x: str, y: str) -> str:
    return p.k.safe(x, f"{y} + 1e-6", p.k.sign(x))


operator("NEG", 1)(lambda p, x: f"-{x}")
operator("ABS", 1)(lambda p, x: f"abs({x})")
operator("SIGN", 1)(lambda p, x: p.k.sign(x))
operator("GATE", 3)(lambda p, c, x, y: f"case when {c} > 0e0 then {x} else {y} end")


@operator("JUMP", 1)
def _(p: Plan, x: str) -> str:
    mean, square = p.let(f"avg({x}) {p.k.ever}"), p.let(f"var_pop({x}) {p.k.ever}")
    z = p.let(f"({x} - {mean}) / (sqrt(greatest({square}, 1e-12)) + 1e-6)")
    n = p.let("count(*) over (partition by symbol)")
    return f"case when rn <= 5 and {n} > 5 then 0e0 else {p.k.tanh(f'{z} - 1.5e0')} end"


operator("DECAY", 1)(lambda p, x: f"({x} + 0.8e0 * {p.k.lag(x, 1, '0e0')} + 0.6e0 * {p.k.lag(x, 2, '0e0')}) / 2.4e0")
operator("DELAY1", 1)(lambda p, x: p.k.lag(x, 1, "0e0"))
operator("MAX3", 1)(lambda p, x: f"greatest({x}, {p.k.lag(x, 1, '0e0')}, {p.k.lag(x, 2, '0e0')})")
for _d in (5, 10, 20):
    operator(f"TS_MEAN_{_d}", 1)(lambda p, x, d=_d: p.k.mean(x, d))
for _d in (5, 10, 20):
    operator(f"TS_STD_{_d}", 1)(lambda p, x, d=_d: f"{std(p, x, d)} + 1e-6")
for _d in (5, 10, 20):
    operator(f"TS_RANK_{_d}", 1)(lambda p, x, d=_d: rank_share(p, x, d))
operator("TS_CORR_10", 2)(lambda p, x, y: corr(p, x, y, 10))
operator("MOMENTUM_5", 1)(lambda p, x: f"{p.k.mean(x, 5)} - {p.k.mean(x, 20)}")
operator("MOMENTUM_10", 1)(lambda p, x: f"{p.k.mean(x, 10)} - {p.k.mean(x, 20)}")
operator("TS_MAX_10", 1)(lambda p, x: fmax(p, x, 10))
operator("TS_MIN_10", 1)(lambda p, x: fmin(p, x, 10))
operator("WMA", 1)(lambda p, x: f"(3e0 * {x} + 2e0 * {p.k.lag(x, 1, '0e0')} + {p.k.lag(x, 2, '0e0')}) / 6e0")
operator("DELAY4", 1)(lambda p, x: p.k.lag(x, 4, "0e0"))
operator("EMA_5", 1)(lambda p, x: ema(p, x, 5))
operator("EMA_20", 1)(lambda p, x: ema(p, x, 20))
operator("TS_QUANTILE_10", 1)(lambda p, x: rank_share(p, x, 10))


@operator("TS_SKEW_10", 1)
def _(p: Plan, x: str) -> str:
    m, s = p.let(p.k.mean(x, 10)), std(p, x, 10)
    third = p.let(f"{p.k.mean(f'{x} * {x} * {x}', 10)} - 3e0 * {p.k.mean(x, 10)} * {p.k.mean(f'{x} * {x}', 10)}")
    return f"({third} + 2e0 * {m} * {m} * {m}) / (({s} + 1e-6) * ({s} + 1e-6) * ({s} + 1e-6))"


operator("TS_MIN_20", 1)(lambda p, x: fmin(p, x, 20))
operator("TS_MAX_20", 1)(lambda p, x: fmax(p, x, 20))
operator("DELTA", 1)(lambda p, x: delta(p, x, 1))


def arg_at(p: Plan, x: str, d: int, best: Callable[[str], str]) -> str:
    w = p.let(p.k.window_array(x, d))
    return f"cast({p.k.find(w, best(w))} - 1 as double)"


operator("TS_ARG_MAX_5", 1)(lambda p, x: f"{arg_at(p, x, 5, p.k.max_of)} / 4e0")
operator("TS_ARG_MIN_5", 1)(lambda p, x: f"{arg_at(p, x, 5, p.k.min_of)} / 4e0")
operator("DECAY_LINEAR_5", 1)(lambda p, x: "(" + " + ".join([f"5e0 * {x}", *(f"{5 - k}e0 * {p.k.lag(x, k, '0e0')}" for k in range(1, 5))]) + ") / 15e0")
operator("SCALE", 1)(lambda p, x: f"{x} / (sum(abs({x})) {p.k.ever} + 1e-6)")
operator("COVARIANCE_10", 2)(lambda p, x, y: cov(p, x, y, 10))


@operator("PRODUCT_5", 1)
def _(p: Plan, x: str) -> str:
    logs = p.let(f"ln(1e0 + greatest({x}, -0.999e0))")
    return f"exp({p.k.clamp(p.k.sum(logs, 5), '-10e0', '10e0')}) - 1e0"


def signed_square(p: Plan, x: str) -> str:
    return p.k.clamp(f"{p.k.sign(x)} * {x} * {x}", "-1e9", "1e9")


operator("SIGNED_POWER_2", 1)(signed_square)


@operator("TS_DECAY_EXP_5", 1)
def _(p: Plan, x: str) -> str:
    """The oldest bar weighs most: weights halve from the window's first bar to its last."""
    w = [0.5 ** (i + 1) for i in range(5)]
    parts = [f"{w[4 - k] / sum(w)!r} * {p.k.lag(x, k, '0e0') if k else x}" for k in range(5)]
    return "(" + " + ".join(parts) + ")"


operator("DELTA_5", 1)(lambda p, x: delta(p, x, 5))


# cross-section -------------------------------------------------------------------------------------------------
@operator("CS_RANK", 1)
def _(p: Plan, x: str) -> str:
    n = p.let("count(*) over (partition by ts)")
    r = p.let(f"row_number() over (partition by ts order by {x}, symbol)")
    return f"case when {n} = 1 then {x} else ({r} - 1) / cast({n} - 1 as double) end"


@operator("CS_SCALE", 1)
def _(p: Plan, x: str) -> str:
    n, lo, hi = p.let("count(*) over (partition by ts)"), p.let(f"min({x}) over (partition by ts)"), p.let(f"max({x}) over (partition by ts)")
    return f"case when {n} = 1 then {x} when abs({hi} - {lo}) < 1e-9 then 0.5e0 else ({x} - {lo}) / ({hi} - {lo}) end"


@operator("CS_NEUTRALIZE", 1)
def _(p: Plan, x: str) -> str:
    n = p.let("count(*) over (partition by ts)")
    return f"case when {n} = 1 then {x} else {x} - avg({x}) over (partition by ts) end"


for _d in (5, 10, 20):
    operator(f"TS_SUM_{_d}", 1)(lambda p, x, d=_d: p.k.sum(x, d))
operator("MIN", 2)(lambda p, x, y: f"least({x}, {y})")
operator("MAX", 2)(lambda p, x, y: f"greatest({x}, {y})")
operator("POWER", 1)(signed_square)
operator("SIGNED_LOG", 1)(lambda p, x: f"{p.k.sign(x)} * ln(1e0 + abs({x}))")
operator("SQRT", 1)(lambda p, x: f"{p.k.sign(x)} * sqrt(abs({x}))")
operator("TS_ZSCORE_10", 1)(lambda p, x: zscore(p, x, 10))
operator("TS_ZSCORE_20", 1)(lambda p, x: zscore(p, x, 20))


@operator("WINSORIZE", 1)
def _(p: Plan, x: str) -> str:
    """Between the 5 % and 95 % linear quantiles of 20: between sorted values 1 and 2, and 19 and 20, at 0.95 and 0.05."""
    w = p.let(p.k.sort(p.let(p.k.window_array(x, 20))))
    lo = p.let(f"{p.k.at(w, '1')} + 0.95e0 * ({p.k.at(w, '2')} - {p.k.at(w, '1')})")
    hi = p.let(f"{p.k.at(w, '19')} + 0.05e0 * ({p.k.at(w, '20')} - {p.k.at(w, '19')})")
    return f"case when {hi} - {lo} < 1e-9 then {x} else {p.k.clamp(x, lo, hi)} end"


operator("CLIP", 1)(lambda p, x: p.k.clamp(x, "-3e0", "3e0"))
operator("SIGMOID", 1)(lambda p, x: f"2e0 / (1e0 + exp(-greatest(-500e0, least(500e0, {x})))) - 1e0")
operator("TANH_SQUASH", 1)(lambda p, x: p.k.tanh(x))
operator("IF_GT", 3)(lambda p, c, x, y: f"case when {c} > 0e0 then {x} else {y} end")

#: Comparisons without a token: 1 where true, 0 where not.
COMPARE: dict[str, Build] = {
    "GT": lambda p, x, y: f"case when {x} > {y} then 1e0 else 0e0 end",
    "LT": lambda p, x, y: f"case when {x} < {y} then 1e0 else 0e0 end",
    "AND": lambda p, x, y: f"case when {x} > 0e0 and {y} > 0e0 then 1e0 else 0e0 end",
    "OR": lambda p, x, y: f"case when {x} > 0e0 or {y} > 0e0 then 1e0 else 0e0 end",
}


def apply(p: Plan, name: str, *operands: str) -> str:
    """The operator's scrubbed result as a column of the plan."""
    op = OPERATORS[name]
    if len(operands) != op.arity:
        raise ValueError(f"{name} takes {op.arity} operands, not {len(operands)}")
    return p.let(p.k.scrub(p.let(op.build(p, *[p.let(x) for x in operands]))))
