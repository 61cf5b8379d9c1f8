"""Language B: window reducers (14 of one indicator, 8 of two), masks, lags and post-processing.

Without a mask, means, deviations and covariances are framed aggregates; order statistics and masked forms work on
the window as an array.  Rows before the window is full are 0.
"""

from __future__ import annotations

from barloom.operators.indicators import INDICATORS
from barloom.plans.formula_b import ParamFormula
from barloom.plans.staged import Plan

EPS = "1e-9"


class Window:
    """The last w values of columns, as frames or arrays; w None: the whole series, whose only row is the last."""

    def __init__(self, p: Plan, w: int | None, keep: float | None):
        self.p, self.k = p, p.k
        self.whole = w is None and keep is None
        if w is None:
            n = p.let("count(*) over (partition by symbol)")
            off = "0" if keep is None else f"cast(floor((1e0 - {keep!r}e0) * {n}) as bigint)"
            self.size = p.let(f"least({n}, greatest(2, {n} - {off}))")
            self.fixed = None
        else:
            off = 0 if keep is None else int((1.0 - keep) * w)
            self.fixed = max(2, w - off)
            self.size = str(self.fixed)
        self.full = f"rn >= {self.size}"

    def array(self, x: str) -> str:
        if self.fixed:
            return self.p.let(self.k.list(x, self.k.over(self.fixed)))
        if self.whole:  # made once a symbol, and kept at its last row alone: memory grows with the series, not with its square
            return self.p.let(f"case when rn = {self.size} then {self.k.list(x, f'over ({self.k.P} rows between unbounded preceding and unbounded following)')} end")
        whole = self.p.let(self.k.list(x, self.k.ever))
        return self.p.let(f"{whole}[greatest(1, rn - {self.size} + 1):rn]" if self.k.duck else f"slice({whole}, cast(greatest(1, rn - {self.size} + 1) as int), cast(least({self.size}, rn) as int))")

    def mean(self, x: str) -> str:
        """Mean of an expression over the window."""
        x = self.p.let(x)
        if self.fixed:
            return self.p.let(f"sum({x}) {self.k.over(self.fixed)} / {self.fixed}e0")
        return self.p.let(f"{self.k.total(self.array(x))} / cast({self.size} as double)")

    def each(self, body: str, last: int = 0) -> str:
        """Sum over positions i (1-based, the last `last` left out) of an expression in {i}."""
        k = self.k
        n = f"{self.size} - {last}" if last else self.size
        return self.p.let(f"case when {self.full} then {k.total(k.map(k.range('1', n), 'i', body))} else 0e0 end")


def quantile(p: Plan, a: str, n: str, q: float) -> str:
    """Linear quantile of an array of n values."""
    s = p.let(p.k.sort(a))
    pos = p.let(f"({n} - 1) * {q!r}e0")
    lo = p.let(f"cast(floor({pos} + 1e-12) as bigint)")
    return p.let(f"case when {n} > 0 then {p.k.at(s, f'{lo} + 1')} + ({pos} - {lo}) * ({p.k.at(s, f'least({lo} + 2, {n})')} - {p.k.at(s, f'{lo} + 1')}) end")


def median(p: Plan, a: str) -> str:
    s = p.let(p.k.sort(a))
    n = p.let(p.k.count(s))
    return p.let(f"case when {n} > 0 then ({p.k.at(s, f'cast(floor(({n} + 1) / 2e0) as int)')} + {p.k.at(s, f'cast(floor({n} / 2e0) as int) + 1')}) / 2e0 else 0e0 end")


def mask(p: Plan, w: Window, field: str, rule: str) -> str:
    """Array of 1 and 0: whether each value of the window is on the kept side of its quantile."""
    side, q = rule.split("_")
    a = w.array(field)
    bound = quantile(p, a, p.let(f"least({w.size}, rn)"), 1.0 - float(q) if side == "high" else float(q))
    return p.let(p.k.map(a, "v", f"case when v {'>=' if side == 'high' else '<='} {bound} then 1e0 else 0e0 end"))


def unary(p: Plan, w: Window, op: str, x: str, m: str | None) -> str:
    k, n = p.k, f"cast({w.size} as double)"
    if op == "Last":
        return x
    a = w.array(x)
    ai = k.at(a, "i")
    if op == "Momentum":
        return f"{x} - {k.at(a, '1')}"
    if op == "Volatility":
        r = f"({k.at(a, 'i + 1')} / ({ai} + {EPS}) - 1e0)"
        mu = p.let(f"{w.each(r, 1)} / ({n} - 1e0)")
        return f"case when {w.size} < 3 then 0e0 else sqrt(greatest({w.each(f'({r} - {mu}) * ({r} - {mu})', 1)} / ({n} - 1e0), 0e0)) end"
    if m is None:
        mu = w.mean(x)
        dev2 = lambda: p.let(f"greatest({w.mean(f'{x} * {x}')} - {mu} * {mu}, 0e0)")
        if op == "Mean":
            return mu
        if op == "Std":
            return f"sqrt({dev2()})"
        if op == "Sum":
            return f"{mu} * {n}"
        if op == "Slope":
            mid = f"(({n} + 1e0) / 2e0)"
            return f"{w.each(f'(i - {mid}) * {ai}')} / ({n} * ({n} * {n} - 1e0) / 12e0 + {EPS})"
        if op in ("Skew", "Kurt"):
            s = p.let(f"sqrt({w.each(f'({ai} - {mu}) * ({ai} - {mu})')} / {n}) + {EPS}")
            power = 3 if op == "Skew" else 4
            return f"{w.each(f'pow(({ai} - {mu}) / {s}, {power}e0)')} / {n}{' - 3e0' if op == 'Kurt' else ''}"
        if op == "Quantile":
            return f"{w.each(f'(case when {ai} < {x} then 1e0 else 0e0 end)')} / {n}"
        if op == "AC1":
            b = k.at(a, "i + 1")
            am, bm = p.let(f"{w.each(ai, 1)} / ({n} - 1e0)"), p.let(f"{w.each(b, 1)} / ({n} - 1e0)")
            c, va, vb = w.each(f"({ai} - {am}) * ({b} - {bm})", 1), w.each(f"({ai} - {am}) * ({ai} - {am})", 1), w.each(f"({b} - {bm}) * ({b} - {bm})", 1)
            return f"case when {w.size} < 3 then 0e0 else {c} / (sqrt({va}) * sqrt({vb}) + {EPS}) end"
        if op == "Range":
            return f"{k.max_of(a)} - {k.min_of(a)}"
        if op == "Med":
            return median(p, a)
        if op == "Mad":
            med = median(p, a)
            return median(p, k.map(a, "v", f"abs(v - {med})"))
        raise KeyError(op)
    mi = k.at(m, "i")
    cnt = p.let(f"{w.each(mi)} + {EPS}")
    mu = p.let(f"{w.each(f'{ai} * {mi}')} / {cnt}")
    std = lambda: p.let(f"sqrt({w.each(f'({ai} - {mu}) * ({ai} - {mu}) * {mi}')} / {cnt})")
    kept = p.let(k.map(k.keep(k.range("1", f"least({w.size}, rn)"), "i", f"{mi} > 0e0"), "i", ai))
    if op == "Mean":
        return mu
    if op == "Std":
        return std()
    if op == "Sum":
        return f"{mu} * ({cnt} - {EPS})"
    if op == "Slope":
        mid = f"(({n} + 1e0) / 2e0)"
        tm = p.let(f"{w.each(f'(i - {mid}) * {mi}')} / {cnt}")
        return f"{w.each(f'({ai} - {mu}) * (i - {mid} - {tm}) * {mi}')} / ({w.each(f'(i - {mid} - {tm}) * (i - {mid} - {tm}) * {mi}')} + {EPS})"
    if op in ("Skew", "Kurt"):
        s = p.let(f"{std()} + {EPS}")
        power = 3 if op == "Skew" else 4
        return f"{w.each(f'pow(({ai} - {mu}) / {s}, {power}e0) * {mi}')} / {cnt}{' - 3e0' if op == 'Kurt' else ''}"
    if op == "Quantile":
        return f"{w.each(f'(case when {ai} < {x} then {mi} else 0e0 end)')} / {cnt}"
    if op == "AC1":
        both = f"({mi} * {k.at(m, 'i + 1')})"
        u, v = f"({ai} * {both})", f"({k.at(a, 'i + 1')} * {both})"
        c2 = p.let(f"{w.each(both, 1)} + {EPS}")
        um, vm = p.let(f"{w.each(u, 1)} / {c2}"), p.let(f"{w.each(v, 1)} / {c2}")
        c, va, vb = (w.each(f"({q} - {qm}) * ({r} - {rm}) * {both}", 1) for q, qm, r, rm in ((u, um, v, vm), (u, um, u, um), (v, vm, v, vm)))
        return f"case when {w.size} < 3 then 0e0 else {c} / (sqrt({va}) * sqrt({vb}) + {EPS}) end"
    if op == "Range":
        return f"{k.max_of(kept)} - {k.min_of(kept)}"
    if op == "Med":
        return median(p, kept)
    if op == "Mad":
        med = median(p, kept)
        return median(p, k.map(kept, "v", f"abs(v - {med})"))
    raise KeyError(op)


def binary(p: Plan, w: Window, op: str, x: str, y: str, m: str | None) -> str:
    """Intercept and Slope2 divide by the variance of the first indicator; unmasked RankDiff is 0."""
    k, n = p.k, f"cast({w.size} as double)"
    if op == "RankDiff" and m is None:
        return "0e0"
    if m is None and w.fixed:
        mean = w.mean
    else:
        a, b = w.array(x), w.array(y)
        weight = k.at(m, "i") if m else "1e0"
        cnt = p.let(f"{w.each(weight)} + {EPS}") if m else n

        def mean(e: str) -> str:
            e = {x: k.at(a, "i"), y: k.at(b, "i")}.get(e, e)
            return p.let(f"{w.each(f'({e}) * {weight}')} / {cnt}")

        if op == "RankDiff":
            rank = lambda arr: k.total(k.map(k.range("1", w.size), "j", f"case when {k.at(arr, 'j')} < {k.at(arr, 'i')} or ({k.at(arr, 'j')} = {k.at(arr, 'i')} and j < i) then 1e0 else 0e0 end"))
            return f"{w.each(f'({rank(a)} - {rank(b)}) / greatest({n} - 1e0, 1e0) * {weight}')} / {cnt}"
    mx, my = mean(x), mean(y)
    if m is None and w.fixed:
        c = lambda: p.let(f"{mean(f'{x} * {y}')} - {mx} * {my}")
        vx = lambda: p.let(f"greatest({mean(f'{x} * {x}')} - {mx} * {mx}, 0e0)")
        vy = lambda: p.let(f"greatest({mean(f'{y} * {y}')} - {my} * {my}, 0e0)")
        gap = lambda: mean(f"({x} - {y}) * ({x} - {y})")
    else:
        dx, dy = f"({k.at(a, 'i')} - {mx})", f"({k.at(b, 'i')} - {my})"
        c = lambda: mean(f"{dx} * {dy}")
        vx = lambda: mean(f"{dx} * {dx}")
        vy = lambda: mean(f"{dy} * {dy}")
        gap = lambda: mean(f"({k.at(a, 'i')} - {k.at(b, 'i')}) * ({k.at(a, 'i')} - {k.at(b, 'i')})")
    if op == "Corr":
        return f"{c()} / (sqrt({vx()}) * sqrt({vy()}) + {EPS})"
    if op == "R2":
        r = p.let(f"{c()} / (sqrt({vx()}) * sqrt({vy()}) + {EPS})")
        return f"{r} * {r}"
    if op == "Slope2":
        return f"{c()} / ({vx()} + {EPS})"
    if op == "Intercept":
        return f"{mx} - {c()} / ({vx()} + {EPS}) * {my}"
    if op == "Euclid":
        return f"sqrt({gap()})"
    if op == "DeltaRatio":
        return f"{mx} / ({my} + {EPS}) - 1e0"
    if op == "Cov":
        return c()
    raise KeyError(op)


def shifted(p: Plan, y: str, lag: int) -> str:
    """y of |lag| bars before; the first value at the head."""
    if not lag:
        return y
    return p.let(f"coalesce({p.k.lag(y, abs(lag))}, first_value({y}) {p.k.ever})")


def postprocess(p: Plan, x: str, width: int = 120, bound: float = 5.0) -> str:
    """Clip to a rolling median and MAD (window least of width and rows less 1, unclipped head), then expanding z; the first 20 rows are 0."""
    k, x = p.k, p.let(x)
    n = p.let("count(*) over (partition by symbol)")
    w = p.let(f"least({width}, {n} - 1)")
    a = p.let(k.list(x, k.over(width)))
    if k.duck:
        last = p.let(f"{a}[greatest(1, len({a}) - {w} + 1):]")
    else:
        last = p.let(f"case when {w} > 0 then slice({a}, cast(greatest(1, size({a}) - {w} + 1) as int), cast(least({w}, size({a})) as int)) else {a} end")
    med = median(p, last)
    mad = p.let(f"{median(p, k.map(last, 'v', f'abs(v - {med})'))} + {EPS}")
    clipped = p.let(f"case when {w} >= 5 and rn >= {w} then {k.clamp(x, f'{med} - {bound!r}e0 * {mad}', f'{med} + {bound!r}e0 * {mad}')} else {x} end")
    mean, square = p.let(f"avg({clipped}) {k.ever}"), p.let(f"avg({clipped} * {clipped}) {k.ever}")
    return f"case when rn <= 20 then 0e0 else ({clipped} - {mean}) / (sqrt(greatest({square} - {mean} * {mean}, 1e-9)) + {EPS}) end"


def evaluate(p: Plan, f: ParamFormula, post: bool = True) -> str:
    """A parametric formula on bars."""
    x = p.let(INDICATORS[f.A](p))
    w = Window(p, None if f.window == "All" else int(f.window), f.slice)
    m = mask(p, w, p.let(INDICATORS[f.mask_field](p)), f.mask_rule) if f.mask_rule and f.mask_field else None
    if f.mode == 1:
        out = unary(p, w, f.mode1, x, m)
    else:
        out = binary(p, w, f.mode2, x, shifted(p, p.let(INDICATORS[f.B](p)), f.B_shift_lag), m)
    out = p.let(f"case when {w.full} then {p.let(out)} else 0e0 end")
    return postprocess(p, out) if post else out
