"""Staged window plans.

A window function can't hold another one, so an expression over bars is cut into stages, each a projection that
adds columns.  ``Plan.let`` puts an expression in the open stage unless it reads a column made there, and gives equal
expressions one column; Catalyst then evaluates each stage's windows of one partitioning in one sort.

The same plan renders as Spark projections and as DuckDB SQL, which the checks run against each other.  ``Kit`` holds
what differs between the two dialects.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kit:
    """SQL fragments of one dialect.  Windows run per symbol by time (P), or per time over symbols (X)."""

    P = "partition by symbol order by ts"

    def __init__(self, duck: bool):
        self.duck = duck

    # windows ---------------------------------------------------------------------------------------------
    def over(self, d: int) -> str:
        return f"over ({self.P} rows between {d - 1} preceding and current row)"

    @property
    def ever(self) -> str:
        return f"over ({self.P} rows between unbounded preceding and current row)"

    def lag(self, x: str, k: int = 1, default: str | None = None) -> str:
        got = f"lag({x}, {k}) over ({self.P})"
        return got if default is None else f"coalesce({got}, {default})"

    def sum(self, x: str, d: int) -> str:
        return f"sum({x}) {self.over(d)}"

    def mean(self, x: str, d: int) -> str:
        """Of a window whose missing head counts as zeros."""
        return f"(sum({x}) {self.over(d)} / {d}e0)"

    def last(self, x: str) -> str:
        """The last value that is not null; a window follows."""
        return f"last_value({x} ignore nulls)" if self.duck else f"last_value({x}, true)"

    def list(self, x: str, frame: str) -> str:
        return f"{'list' if self.duck else 'collect_list'}({x}) {frame}"

    # arrays ----------------------------------------------------------------------------------------------
    def array(self, items: Iterable[str]) -> str:
        inner = ", ".join(items)
        return f"[{inner}]" if self.duck else f"array({inner})"

    def window_array(self, x: str, d: int) -> str:
        """The last d values, oldest first, zeros before the first row."""
        return self.array([*(self.lag(x, k, "0e0") for k in range(d - 1, 0, -1)), x])

    def sort(self, a: str) -> str:
        return f"list_sort({a})" if self.duck else f"array_sort({a})"

    def at(self, a: str, i: str) -> str:
        return f"{a}[{i}]" if self.duck else f"element_at({a}, cast({i} as int))"

    def map(self, a: str, var: str, body: str) -> str:
        return f"list_transform({a}, lambda {var}: {body})" if self.duck else f"transform({a}, {var} -> {body})"

    def keep(self, a: str, var: str, body: str) -> str:
        return f"list_filter({a}, lambda {var}: {body})" if self.duck else f"filter({a}, {var} -> {body})"

    def total(self, a: str) -> str:
        return f"coalesce(list_sum({a}), 0e0)" if self.duck else f"aggregate({a}, 0e0, (s, v) -> s + v)"

    def count(self, a: str) -> str:
        return f"len({a})" if self.duck else f"size({a})"

    def max_of(self, a: str) -> str:
        return f"list_max({a})" if self.duck else f"array_max({a})"

    def min_of(self, a: str) -> str:
        return f"list_min({a})" if self.duck else f"array_min({a})"

    def find(self, a: str, x: str) -> str:
        return f"list_position({a}, {x})" if self.duck else f"array_position({a}, {x})"

    def range(self, a: str, b: str) -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1)" if self.duck else f"sequence(cast({a} as int), cast({b} as int))"

    # scalars ---------------------------------------------------------------------------------------------
    def sign(self, x: str) -> str:
        return f"cast(sign({x}) as double)"

    def tanh(self, x: str) -> str:
        return f"(1e0 - 2e0 / (exp(2e0 * least(greatest({x}, -300e0), 300e0)) + 1e0))"

    def log1p(self, x: str) -> str:
        return f"ln(1e0 + ({x}))"

    def clamp(self, x: str, lo: str, hi: str) -> str:
        return f"greatest({lo}, least({hi}, {x}))"

    def safe(self, x: str, y: str, other: str = "0e0") -> str:
        """x / y; other where y is 0 or null."""
        return f"(case when ({y}) = 0e0 or ({y}) is null then {other} else ({x}) / ({y}) end)"

    def scrub(self, x: str) -> str:
        """Null and NaN as 0, infinities as 1 and -1."""
        return f"(case when {x} is null or isnan({x}) then 0e0 when {x} = cast('Infinity' as double) then 1e0 when {x} = cast('-Infinity' as double) then -1e0 else {x} end)"

    def rounded(self, x: str, digits: int = 6) -> str:
        return f"round({x}, {digits}) + 0e0"

    def day(self, ts: str) -> str:
        """Day number of an epoch second in fixed UTC+8."""
        return f"cast(floor(({ts} + 28800) / 86400e0) as bigint)"


SPARK, DUCK = Kit(False), Kit(True)
_NAME = re.compile(r"\b_[a-z0-9_]+\b")
_ANY = re.compile(r"\b[a-z_][a-z0-9_]*\b")
NORM_ROWS = 4096


def rolling_scores(x: np.ndarray, w: int) -> np.ndarray:
    """Robust z-scores of one series in time order; NORM_ROWS windows are in memory at once."""
    out = np.zeros(len(x))
    at = max(w // 2 - 1, 0)
    for lo in range(w - 1, len(x), NORM_ROWS):
        hi = min(len(x), lo + NORM_ROWS)
        win = np.lib.stride_tricks.sliding_window_view(x[lo - w + 1 : hi], w)
        med = np.partition(win, at, axis=1)[:, at]
        mad = np.partition(np.abs(win - med[:, None]), at, axis=1)[:, at] + 1e-6
        out[lo:hi] = np.clip((x[lo:hi] - med) / mad, -5, 5)
    return out


def robust_scores(df: DataFrame, norms: list[tuple[str, str]]) -> DataFrame:
    """df with a column for each (name, "@norm(column, window)"), per symbol in order of ts."""
    todo = [(n, *re.fullmatch(r"@norm\((\w+), (\d+)\)", e).groups()) for n, e in norms]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n, _ in norms)])

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("ts")
        for name, x, w in todo:
            g = g.append_column(name, pa.array(rolling_scores(g[x].to_numpy().astype(float), int(w))))
        return g

    return df.groupBy("symbol").applyInArrow(run, schema)


class Plan:
    """Stages of (name, expression) over a base relation with symbol, ts and rn (row number per symbol)."""

    def __init__(self, kit: Kit):
        self.k = kit
        self.stages: list[list[tuple[str, str]]] = [[]]
        self._made: dict[str, str] = {}
        self._n = 0

    def let(self, expr: str) -> str:
        if re.fullmatch(r"[a-z_][a-z0-9_]*", expr):
            return expr
        if expr in self._made:
            return self._made[expr]
        self._n += 1
        name = f"_c{self._n}"
        level = 0
        reads = set(_NAME.findall(expr))
        for i, stage in enumerate(self.stages):
            if any(n in reads for n, _ in stage):
                level = i + 1
        while level >= len(self.stages):
            self.stages.append([])
        self.stages[level].append((name, expr))
        self._made[expr] = name
        return name

    def norm(self, x: str, w: int) -> str:
        """Rolling robust z-score of a column: lower median of w rows, lower median of the distances from it, clamp 5; 0
        before the window is full.

        In SQL every row holds and sorts its window; on Spark all such columns of a stage are worked out together, in
        Arrow batches of one symbol each.
        """
        x, k = self.let(x), self.k
        if not k.duck:
            return self.let(f"@norm({x}, {w})")
        frame = self.let(k.list(x, k.over(w)))
        med = self.let(f"case when rn >= {w} then {k.at(k.sort(frame), str(w // 2))} end")
        mad = self.let(f"case when rn >= {w} then {k.at(k.sort(k.map(frame, 'v', f'abs(v - {med})')), str(w // 2))} + 1e-6 end")
        return f"case when rn < {w} then 0e0 else {k.clamp(f'({x} - {med}) / {mad}', '-5e0', '5e0')} end"

    def spark(self, base: DataFrame, out: dict[str, str], keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
        df, late = base, []
        for i, stage in enumerate(self.stages):
            plain = [(n, e) for n, e in stage if not e.startswith("@norm")]
            norms = [(n, e) for n, e in stage if e.startswith("@norm")]
            if plain:
                df = df.select("*", *[F.expr(e).alias(n) for n, e in plain])
            read = {x for later in self.stages[i + 1 :] for _, e in later for x in _NAME.findall(e)}
            late += [x for x in norms if x[0] not in read]
            if now := [x for x in norms if x[0] in read]:
                df = robust_scores(df, now)
        if late:
            wanted = {*keys, *(x for e in out.values() for x in _ANY.findall(e)), *(x for _, e in late for x in _ANY.findall(e))}
            df = robust_scores(df.select(*[c for c in df.columns if c in wanted or c in ("symbol", "ts")]), late)
        return df.select(*keys, *[F.expr(e).alias(n) for n, e in out.items()])

    def sql(self, base: str, out: dict[str, str], keys: tuple[str, ...] = ("symbol", "ts")) -> str:
        parts, last = [f"s0 AS ({base})"], "s0"
        for i, stage in enumerate(self.stages, 1):
            if stage:
                parts.append(f"s{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage)} FROM {last})")
                last = f"s{i}"
        cols = ", ".join([*keys, *(f"{e} AS {n}" for n, e in out.items())])
        return f"WITH {', '.join(parts)} SELECT {cols} FROM {last}"
