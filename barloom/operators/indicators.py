"""Language B: the 34 named indicators of OHLCV bars.

Windows have a zero warm-up (rows before the window is full are 0).  Where a full-sample mean or extreme would fill
a warm-up, which looks ahead, the indicator itself is 0 there: vol_regime, boll_pos, boll_width and typical_dev in
the first 19 rows, price_pos_50 in the first 49.  willr_14 and cci_14, whose empty windows would divide by the
epsilon alone, are 0 in the first 13.
"""

from __future__ import annotations

from collections.abc import Callable

from barloom.operators.language_a import ema
from barloom.plans.staged import Plan

EPS = "1e-9"
Build = Callable[[Plan], str]


def roll(p: Plan, x: str, w: int, agg: str = "avg") -> str:
    x = p.let(x)
    return p.let(f"case when rn < {w} then 0e0 else {agg}({x}) {p.k.over(w)} end")


def simple_return(p: Plan, k: int = 1) -> str:
    return p.let(f"coalesce(close / ({p.k.lag('close', k)} + {EPS}) - 1e0, 0e0)")


def before(p: Plan, x: str) -> str:
    return p.let(f"coalesce({p.k.lag(x)}, {x})")


def true_range(p: Plan) -> str:
    pc = before(p, "close")
    return p.let(f"greatest(high - low, abs(high - {pc}), abs(low - {pc}))")


def slope(p: Plan, x: str, w: int) -> str:
    """Least-squares slope on 0 .. w-1, zero warm-up."""
    x, mid = p.let(x), (w - 1) / 2
    tvar = sum((i - mid) ** 2 for i in range(w))
    moved = p.let(f"cast(rn as double) * {x}")
    return p.let(f"case when rn < {w} then 0e0 else ({p.k.sum(moved, w)} - (cast(rn as double) - {mid!r}) * {p.k.sum(x, w)}) / ({tvar!r} + {EPS}) end")


def full(p: Plan, w: int, x: str) -> str:
    return f"case when rn < {w} then 0e0 else {x} end"


def rsi(p: Plan) -> str:
    d = p.let(f"close - {before(p, 'close')}")
    up, down = roll(p, f"greatest({d}, 0e0)", 14), roll(p, f"greatest(-{d}, 0e0)", 14)
    return f"(100e0 - 100e0 / (1e0 + ({up} + 1e-9) / ({down} + 1e-9))) / 50e0 - 1e0"


def macd_hist(p: Plan) -> str:
    macd = p.let(f"{ema(p, 'close', 12)} - {ema(p, 'close', 26)}")
    return f"{macd} - {ema(p, macd, 9)}"


def band(p: Plan) -> tuple[str, str]:
    """20-bar mean, and the root mean square of deviations from the mean as it moved; only full windows count."""
    m = p.let(f"case when rn >= 20 then avg(close) {p.k.over(20)} end")
    d = p.let(f"(close - {m}) * (close - {m})")
    return m, p.let(f"sqrt(case when rn < 20 then 0e0 else coalesce(sum({d}) {p.k.over(20)}, 0e0) / 20e0 end + {EPS})")


def boll_pos(p: Plan) -> str:
    m, s = band(p)
    return full(p, 20, p.k.clamp(f"(close - ({m} - 2e0 * {s})) / (4e0 * {s} + {EPS})", "0e0", "1e0"))


def boll_width(p: Plan) -> str:
    m, s = band(p)
    return full(p, 20, f"4e0 * {s} / ({m} + {EPS})")


def mfi(p: Plan) -> str:
    tp = p.let("(high + low + close) / 3e0")
    pc, flow = before(p, tp), p.let(f"{tp} * volume")
    up, down = roll(p, f"case when {tp} > {pc} then {flow} else 0e0 end", 14), roll(p, f"case when {tp} < {pc} then {flow} else 0e0 end", 14)
    return f"(50e0 - 100e0 / (1e0 + {up} * 14e0 / ({down} * 14e0 + {EPS}))) / 50e0"


def willr(p: Plan) -> str:
    hi, lo = roll(p, "high", 14, "max"), roll(p, "low", 14, "min")
    return full(p, 14, f"-100e0 * ({hi} - close) / ({hi} - {lo} + {EPS})")


def cci(p: Plan) -> str:
    m = roll(p, "close", 14)
    s = p.let(f"sqrt({roll(p, f'(close - {m}) * (close - {m})', 14)} + {EPS})")
    return full(p, 14, f"(close - {m}) / (0.015e0 * {s} + {EPS})")


def price_pos(p: Plan) -> str:
    hi, lo = roll(p, "high", 50, "max"), roll(p, "low", 50, "min")
    return full(p, 50, p.k.clamp(f"(close - {lo}) / ({hi} - {lo} + {EPS})", "0e0", "1e0"))


def trix(p: Plan) -> str:
    e = ema(p, ema(p, ema(p, "close", 15), 15), 15)
    return f"({e} - {before(p, e)}) / ({e} + {EPS})"


def ult_osc(p: Plan) -> str:
    pc = before(p, "close")
    lo = p.let(f"least(low, {pc})")
    bp, tr = p.let(f"close - {lo}"), p.let(f"greatest(high, {pc}) - {lo}")
    a7, a14, a28 = (p.let(f"{roll(p, bp, w)} / ({roll(p, tr, w)} + {EPS})") for w in (7, 14, 28))
    return p.k.clamp(f"(4e0 * {a7} + 2e0 * {a14} + {a28}) / 7e0 * 2e0 - 1e0", "-1e0", "1e0")


def amount_per_trade(p: Plan) -> str:
    return p.let(f"amount / (volume / 100e0 + {EPS})")


def pair_corr(p: Plan, x: str, w: int) -> str:
    """Lag-1 autocorrelation of the w - 1 pairs inside a window of w."""
    x = p.let(x)
    y, n = p.let(p.k.lag(x, 1, "0e0")), w - 1
    mean = lambda e: f"(sum({e}) {p.k.over(n)} / {n}e0)"
    c = p.let(f"{mean(f'{x} * {y}')} - {mean(x)} * {mean(y)}")
    sx, sy = (p.let(f"sqrt(greatest({mean(f'{v} * {v}')} - {mean(v)} * {mean(v)}, 0e0))") for v in (x, y))
    return full(p, w, f"{c} / ({sx} * {sy} + {EPS})")


INDICATORS: dict[str, Build] = {
    "close": lambda p: "close",
    "open": lambda p: "open",
    "high": lambda p: "high",
    "low": lambda p: "low",
    "volume": lambda p: "volume",
    "amount": lambda p: "amount",
    "ret": lambda p: simple_return(p, 1),
    "ret5": lambda p: simple_return(p, 5),
    "ret20": lambda p: simple_return(p, 20),
    "atr": lambda p: roll(p, true_range(p), 14),
    "rvol": lambda p: roll(p, simple_return(p), 20, "stddev_pop"),
    "hl_range": lambda p: f"(high - low) / (close + {EPS})",
    "vol_regime": lambda p: full(p, 20, f"volume / (avg(volume) {p.k.over(20)} + {EPS})"),
    "rsi14": rsi,
    "macd_hist": macd_hist,
    "boll_pos": boll_pos,
    "boll_width": boll_width,
    "obv_slope": lambda p: slope(p, f"sum({p.let(p.k.sign(simple_return(p)) + ' * volume')}) {p.k.ever}", 20),
    "mfi14": mfi,
    "willr_14": willr,
    "cci_14": cci,
    "roc_12": lambda p: simple_return(p, 12),
    "typical_dev": lambda p: full(p, 20, f"close / (avg(close) {p.k.over(20)} + {EPS}) - 1e0"),
    "ema_ratio_12_26": lambda p: f"{ema(p, 'close', 12)} / ({ema(p, 'close', 26)} + {EPS}) - 1e0",
    "trend_strength_50": lambda p: simple_return(p, 49),
    "price_pos_50": price_pos,
    "trix_15": trix,
    "ppo": lambda p: f"({ema(p, 'close', 12)} - {ema(p, 'close', 26)}) / ({ema(p, 'close', 26)} + {EPS})",
    "ult_osc": ult_osc,
    "num_trades": lambda p: "volume / 100e0",
    "amt_per_trade": amount_per_trade,
    "trade_size_reg_intercept": lambda p: f"{amount_per_trade(p)} / (amount / (volume + {EPS}) + {EPS})",
    "amt_vol_euclid": lambda p: "abs(ln(1e0 + amount) - ln(1e0 + volume))",
    "num_trades_ac1": lambda p: pair_corr(p, "volume / 100e0", 20),
}
