"""Language A: 65 features of OHLCV bars, in token order.

Each is a function of a plan that gives an expression.  ``norm`` is the rolling robust z-score (window 200, lower
median, clamp 5, zero before the window is full), ``clean`` keeps the value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from barloom.operators.language_a import corr, cov, ema, fmax, fmin, var
from barloom.plans.staged import SPARK, Plan
from barloom.sources.bars import numbered

EPS = "1e-9"
NORM_WINDOW = 200


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    build: Callable[[Plan], str]


FEATURES: dict[str, Feature] = {}


def feature(name: str, category: str):
    def keep(f: Callable[[Plan], str]):
        FEATURES[name] = Feature(name, category, f)
        return f

    return keep


def norm(p: Plan, x: str, w: int = NORM_WINDOW) -> str:
    return p.norm(p.k.scrub(p.let(x)), w)


def clean(p: Plan, x: str) -> str:
    return p.k.scrub(p.let(x))


# building blocks -----------------------------------------------------------------------------------------------
def prev(p: Plan, x: str, k: int = 1) -> str:
    return p.let(p.k.lag(x, k))


def before(p: Plan, x: str) -> str:
    """The value one bar earlier; the first bar's own at the head."""
    return p.let(f"coalesce({p.k.lag(x, 1)}, {x})")


def logret(p: Plan, k: int = 1) -> str:
    return p.let(f"coalesce(ln(close / ({p.k.lag('close', k)} + {EPS})), 0e0)")


def true_range(p: Plan) -> str:
    pc = before(p, "close")
    return p.let(f"greatest(high - low, abs(high - {pc}), abs(low - {pc}))")


def atr(p: Plan, w: int = 14) -> str:
    return p.let(p.k.mean(true_range(p), w))


def typical(p: Plan) -> str:
    return p.let("(high + low + close) / 3e0")


def slope(p: Plan, x: str, w: int) -> str:
    """Least-squares slope of the zero-padded window on 0 .. w-1, not divided by the level."""
    x = p.let(x)
    mid = (w - 1) / 2
    tvar = sum((i - mid) ** 2 for i in range(w))
    # sum over the window of (i - mid) x[i], with i = w - 1 - (rn - row) from the running index
    moved = p.let(f"cast(rn as double) * {x}")
    weighted = f"({p.k.sum(moved, w)} - (cast(rn as double) - {mid!r}) * {p.k.sum(x, w)})"
    return p.let(f"{weighted} / ({tvar!r} + {EPS})")


def level_slope(p: Plan, x: str, w: int) -> str:
    x = p.let(x)
    s, m = slope(p, x, w), p.let(p.k.mean(x, w))
    return p.let(p.k.safe(s, f"{m} + {EPS}"))


def signed_volume(p: Plan) -> str:
    return p.let(f"{p.k.sign(p.let('close - ' + before(p, 'close')))} * volume")


def autocorr(p: Plan, k: int, w: int = 20) -> str:
    """Correlation of w pairs (r[t-k], r[t])."""
    r = logret(p)
    s = p.let(p.k.lag(r, k, "0e0"))
    return p.let(f"{cov(p, s, r, w)} / (sqrt({p.let(var(p, s, w))}) * sqrt({p.let(var(p, r, w))}) + 1e-8)")


def position(p: Plan, lo: str, hi: str, out: str = "0e0, 1e0") -> str:
    a, b = out.split(", ")
    return p.k.clamp(p.k.safe(f"close - ({lo})", f"({hi}) - ({lo}) + {EPS}"), a, b)


def ln_ratio(a: str, b: str) -> str:
    return f"ln(({a} + {EPS}) / ({b} + {EPS}))"


def vol_norm(p: Plan, bar: str) -> str:
    """Root of the 20-bar mean of a variance estimate, log1p, robust z."""
    m = p.let(p.k.mean(p.let(bar), 20))
    return norm(p, f"ln(1e0 + sqrt(greatest({m}, 0e0)))")


def money_flow(p: Plan) -> str:
    return p.let(f"((close - low) - (high - close)) / (high - low + {EPS}) * volume")


# trend ---------------------------------------------------------------------------------------------------------
feature("RET", "trend")(lambda p: norm(p, logret(p, 1)))
feature("RET5", "trend")(lambda p: norm(p, logret(p, 5)))
feature("RET20", "trend")(lambda p: norm(p, logret(p, 20)))
feature("MA_DIFF", "trend")(lambda p: norm(p, f"{p.k.mean('close', 10)} / ({p.k.mean('close', 30)} + {EPS}) - 1e0"))
feature("SLOPE20", "trend")(lambda p: norm(p, level_slope(p, "close", 20)))
# volatility ----------------------------------------------------------------------------------------------------
feature("ATR", "volatility")(lambda p: norm(p, f"ln(1e0 + greatest({atr(p)}, 0e0))"))
feature("RVOL", "volatility")(lambda p: norm(p, f"ln(1e0 + sqrt({p.let(var(p, logret(p), 20))}) + 1e-9)"))
feature("HL_RANGE", "volatility")(lambda p: norm(p, f"(high - low) / (close + {EPS})"))
feature("VOL_REGIME", "volatility")(lambda p: norm(p, f"{atr(p)} / ({p.k.mean(atr(p), 20)} + {EPS}) - 1e0"))
# reversal ------------------------------------------------------------------------------------------------------
feature("DEV", "reversal")(lambda p: norm(p, f"close / ({p.k.mean('close', 20)} + {EPS}) - 1e0"))
feature("DEV60", "reversal")(lambda p: norm(p, f"close / ({p.k.mean('close', 60)} + {EPS}) - 1e0"))


@feature("RSI14", "reversal")
def _(p: Plan) -> str:
    d = p.let(f"close - {before(p, 'close')}")
    up, down = p.let(f"greatest({d}, 0e0)"), p.let(f"greatest(-{d}, 0e0)")
    rs = p.let(f"({p.k.mean(up, 14)} + 1e-9) / ({p.k.mean(down, 14)} + 1e-9)")
    return clean(p, f"(50e0 - 100e0 / (1e0 + {rs})) / 50e0")


feature("PRESSURE", "reversal")(lambda p: clean(p, f"case when abs(high - low) < {EPS} then 0e0 else {p.k.clamp('(close - open) / (high - low)', '-1e0', '1e0')} end"))
feature("AC1", "reversal")(lambda p: clean(p, p.k.clamp(autocorr(p, 1), "-1e0", "1e0")))


# volume --------------------------------------------------------------------------------------------------------
def volume_ratio(p: Plan) -> str:
    return f"volume / ({p.k.mean('volume', 20)} + {EPS})"


feature("VOL_RATIO", "volume")(lambda p: norm(p, volume_ratio(p)))
feature("VOL_Z", "volume")(lambda p: clean(p, p.k.clamp(f"(volume - {p.k.mean('volume', 20)}) / (sqrt({p.let(var(p, 'volume', 20))}) + 2e-9)", "-5e0", "5e0")))


@feature("PV_CORR", "volume")
def _(p: Plan) -> str:
    r, v = p.let(norm(p, logret(p, 1))), p.let(norm(p, volume_ratio(p)))
    lv = p.let(f"ln(1e0 + greatest({v}, -0.99e0))")
    return clean(p, p.k.clamp(corr(p, r, lv, 10), "-1e0", "1e0"))


def relative(p: Plan, x: str) -> str:
    """Less its cross-section mean, and normed again; of a single symbol itself."""
    x = p.let(x)
    n = p.let("count(*) over (partition by ts)")
    return f"case when {n} = 1 then {x} else {p.let(norm(p, f'{x} - avg({x}) over (partition by ts)'))} end"


feature("REL_RET5", "cross_sectional")(lambda p: relative(p, norm(p, logret(p, 5))))
feature("REL_RET20", "cross_sectional")(lambda p: relative(p, norm(p, logret(p, 20))))
feature("REL_VOL", "cross_sectional")(lambda p: relative(p, norm(p, f"ln(1e0 + sqrt({p.let(var(p, logret(p), 20))}) + 1e-9)")))


@feature("VWAP_DEV", "volume")
def _(p: Plan) -> str:
    tpv = p.let(f"{typical(p)} * volume")
    vwap = p.let(f"{p.k.sum(tpv, 20)} / ({p.k.sum('volume', 20)} + {EPS})")
    return norm(p, f"(close - {vwap}) / ({vwap} + {EPS})")


def band(p: Plan) -> tuple[str, str]:
    return p.let(p.k.mean("close", 20)), p.let(f"sqrt({p.let(var(p, 'close', 20))}) + 1e-9")


@feature("BOLL_POS", "channel")
def _(p: Plan) -> str:
    m, s = band(p)
    return clean(p, position(p, f"{m} - 2e0 * {s}", f"{m} + 2e0 * {s}"))


@feature("BOLL_WIDTH", "volatility")
def _(p: Plan) -> str:
    m, s = band(p)
    return norm(p, f"4e0 * {s} / ({m} + {EPS})")


@feature("MACD_HIST", "momentum")
def _(p: Plan) -> str:
    macd = p.let(f"{ema(p, 'close', 12)} - {ema(p, 'close', 26)}")
    return norm(p, f"{macd} - {ema(p, macd, 9)}")


feature("OBV_SLOPE", "volume")(lambda p: norm(p, level_slope(p, f"sum({signed_volume(p)}) {p.k.ever}", 20)))


@feature("MFI14", "volume")
def _(p: Plan) -> str:
    tp = typical(p)
    pc, flow = before(p, tp), p.let(f"{tp} * volume")
    up, down = p.let(f"case when {tp} > {pc} then {flow} else 0e0 end"), p.let(f"case when {tp} < {pc} then {flow} else 0e0 end")
    ratio = p.let(f"{p.k.sum(up, 14)} / ({p.k.sum(down, 14)} + {EPS})")
    return clean(p, p.k.clamp(f"(50e0 - 100e0 / (1e0 + {ratio})) / 50e0", "-1e0", "1e0"))


@feature("WILLR_14", "reversal")
def _(p: Plan) -> str:
    hi, lo = p.let(fmax(p, "high", 14)), p.let(fmin(p, "low", 14))
    return clean(p, p.k.clamp(p.k.safe(f"close - {hi}", f"{hi} - {lo} + {EPS}"), "-1e0", "0e0"))


@feature("CCI_14", "reversal")
def _(p: Plan) -> str:
    tp = typical(p)
    w, m = p.let(p.k.window_array(tp, 14)), p.let(p.k.mean(tp, 14))
    dev = p.let(f"{p.k.total(p.k.map(w, 'v', f'abs(v - {m})'))} / 14e0")
    return clean(p, p.k.clamp(f"({tp} - {m}) / (0.015e0 * {dev} + {EPS}) / 200e0", "-1e0", "1e0"))


feature("ROC_12", "momentum")(lambda p: norm(p, f"coalesce(close / ({p.k.lag('close', 12)} + {EPS}) - 1e0, 0e0)"))
feature("TYPICAL_DEV", "reversal")(lambda p: norm(p, f"({typical(p)} - {p.let(p.k.mean(typical(p), 20))}) / ({p.let(p.k.mean(typical(p), 20))} + {EPS})"))
feature("EMA_RATIO_12_26", "trend")(lambda p: norm(p, f"{ema(p, 'close', 12)} / ({ema(p, 'close', 26)} + {EPS}) - 1e0"))


@feature("TREND_STRENGTH_50", "trend")
def _(p: Plan) -> str:
    w = 50
    s, m = slope(p, "close", w), p.let(p.k.mean("close", w))
    tvar = sum((i - (w - 1) / 2) ** 2 for i in range(w))
    tot = p.let(f"{w}e0 * {var(p, 'close', w)}")
    res = p.let(f"{tot} - 2e0 * {s} * {s} * ({tvar!r} + {EPS}) + {s} * {s} * {tvar!r}")
    r2 = p.k.clamp(f"1e0 - {res} / ({tot} + {EPS})", "0e0", "1e0")
    return norm(p, f"{p.k.safe(s, f'{m} + {EPS}')} * {r2}")


feature("PRICE_POS_50", "trend")(lambda p: clean(p, position(p, p.let(fmin(p, "low", 50)), p.let(fmax(p, "high", 50)))))


def trix(p: Plan) -> str:
    e = ema(p, ema(p, ema(p, "close", 15), 15), 15)
    return p.let(f"({e} - {before(p, e)}) / (abs({before(p, e)}) + {EPS})")


feature("TRIX_15", "momentum")(lambda p: norm(p, trix(p)))
feature("PPO", "momentum")(lambda p: norm(p, f"({ema(p, 'close', 12)} - {ema(p, 'close', 26)}) / (abs({ema(p, 'close', 26)}) + {EPS})"))


@feature("ULT_OSC", "momentum")
def _(p: Plan) -> str:
    pc = before(p, "close")
    lo = p.let(f"least(low, {pc})")
    bp, tr = p.let(f"close - {lo}"), p.let(f"greatest(high, {pc}) - {lo}")
    a7, a14, a28 = (f"{p.k.sum(bp, w)} / ({p.k.sum(tr, w)} + {EPS})" for w in (7, 14, 28))
    return clean(p, p.k.clamp(f"(4e0 * {a7} + 2e0 * {a14} + {a28}) / 7e0 * 2e0 - 1e0", "-1e0", "1e0"))


feature("RET_ACCEL", "momentum")(lambda p: norm(p, f"{logret(p, 5)} - {p.k.lag(logret(p, 5), 5, '0e0')}"))
LN2 = "0.6931471805599453e0"
feature("GK_VOL", "volatility")(lambda p: vol_norm(p, f"greatest(0.5e0 * pow({ln_ratio('high', 'low')}, 2e0) - (2e0 * {LN2} - 1e0) * pow({ln_ratio('close', 'open')}, 2e0), 0e0)"))
feature("PARKINSON_VOL", "volatility")(lambda p: vol_norm(p, f"pow({ln_ratio('high', 'low')}, 2e0) / (4e0 * {LN2})"))
RS_BAR = f"({ln_ratio('high', 'close')} * {ln_ratio('high', 'open')} + {ln_ratio('low', 'close')} * {ln_ratio('low', 'open')})"
feature("YANG_ZHANG_VOL", "volatility")(lambda p: vol_norm(p, f"(pow({ln_ratio('open', before(p, 'close'))}, 2e0) + pow({ln_ratio('open', 'close')}, 2e0) + greatest({RS_BAR}, 0e0)) / 3e0"))
feature("RS_VOL", "volatility")(lambda p: vol_norm(p, RS_BAR))
feature("AMIHUD_ILLIQ", "volume")(lambda p: norm(p, f"ln(1e0 + {p.k.mean(p.let(f'abs({logret(p)}) / (volume + {EPS})'), 20)})"))


@feature("KYLE_LAMBDA", "volume")
def _(p: Plan) -> str:
    r = logret(p)
    a, s = p.let(f"abs({r})"), p.let(f"{p.k.sign(r)} * volume")
    return norm(p, f"{cov(p, a, s, 20)} / ({p.let(var(p, s, 20))} + {EPS})")


feature("CMF_20", "volume")(lambda p: clean(p, p.k.clamp(f"{p.k.sum(money_flow(p), 20)} / ({p.k.sum('volume', 20)} + {EPS})", "-1e0", "1e0")))
feature("AD_LINE_SLOPE", "volume")(lambda p: norm(p, level_slope(p, f"sum({money_flow(p)}) {p.k.ever}", 20)))


def stoch_k(p: Plan) -> str:
    hi, lo = p.let(fmax(p, "high", 14)), p.let(fmin(p, "low", 14))
    return p.let(p.k.safe(f"close - {lo}", f"{hi} - {lo} + {EPS}"))


feature("STOCH_K_14", "reversal")(lambda p: clean(p, p.k.clamp(f"{stoch_k(p)} * 2e0 - 1e0", "-1e0", "1e0")))
feature("STOCH_D_3", "reversal")(lambda p: clean(p, p.k.clamp(f"{p.k.mean(stoch_k(p), 3)} * 2e0 - 1e0", "-1e0", "1e0")))


@feature("AROON_OSC_25", "reversal")
def _(p: Plan) -> str:
    h, lo = p.let(p.k.window_array("high", 25)), p.let(p.k.window_array("low", 25))
    return clean(p, p.k.clamp(f"cast({p.k.find(h, p.k.max_of(h))} - {p.k.find(lo, p.k.min_of(lo))} as double) / 25e0", "-1e0", "1e0"))


def di(p: Plan) -> tuple[str, str]:
    up, down = p.let(f"greatest(high - {before(p, 'high')}, 0e0)"), p.let(f"greatest({before(p, 'low')} - low, 0e0)")
    tr = f"({p.k.mean(true_range(p), 14)} + {EPS})"
    return p.let(f"{p.k.mean(up, 14)} / {tr}"), p.let(f"{p.k.mean(down, 14)} / {tr}")


@feature("DMI_ADX_14", "trend")
def _(p: Plan) -> str:
    a, b = di(p)
    return clean(p, p.k.clamp(p.k.mean(p.let(f"abs({a} - {b}) / ({a} + {b} + {EPS})"), 14), "0e0", "1e0"))


@feature("DMI_DIFF_14", "trend")
def _(p: Plan) -> str:
    a, b = di(p)
    return clean(p, p.k.clamp(f"{a} - {b}", "-1e0", "1e0"))


feature("TRIX_SIGNAL", "momentum")(lambda p: norm(p, f"{trix(p)} - {p.k.mean(trix(p), 9)}"))
# channel -------------------------------------------------------------------------------------------------------
feature("DONCHIAN_POS_20", "channel")(lambda p: clean(p, position(p, p.let(fmin(p, "low", 20)), p.let(fmax(p, "high", 20)))))


@feature("KELTNER_POS_20", "channel")
def _(p: Plan) -> str:
    m, r = ema(p, "close", 20), ema(p, atr(p), 20)
    return clean(p, position(p, f"{m} - 2e0 * {r}", f"{m} + 2e0 * {r}"))


def mid_dev(p: Plan, w: int) -> str:
    m = p.let(f"({fmax(p, 'high', w)} + {fmin(p, 'low', w)}) / 2e0")
    return norm(p, f"(close - {m}) / ({m} + {EPS})")


feature("ICHIMOKU_KIJUN_DEV", "channel")(lambda p: mid_dev(p, 26))
feature("ICHIMOKU_TENKAN_DEV", "channel")(lambda p: mid_dev(p, 9))


@feature("SUPERTREND_DIR", "channel")
def _(p: Plan) -> str:
    """The last break of the bar before's band decides; 0 until the first break."""
    up, down = p.let(f"(high + low) / 2e0 + 1.5e0 * {atr(p)}"), p.let(f"(high + low) / 2e0 - 1.5e0 * {atr(p)}")
    flip = p.let(f"case when close < {p.k.lag(down)} then -1e0 when close > {p.k.lag(up)} then 1e0 end")
    last = f"last_value({flip} ignore nulls)" if p.k.duck else f"last_value({flip}, true)"
    return f"coalesce({last} {p.k.ever}, 0e0)"


feature("SAR_DIST", "channel")(lambda p: norm(p, f"{ema(p, 'close', 20)} - {ema(p, 'close', 50)}"))


# statistical ---------------------------------------------------------------------------------------------------
def centred(p: Plan, power: int, w: int = 20) -> tuple[str, str]:
    """Central moment of the zero-padded log-return window, and its variance, from the window itself."""
    r = logret(p)
    a, m = p.let(p.k.window_array(r, w)), p.let(p.k.mean(r, w))
    moment = lambda n: p.let(f"{p.k.total(p.k.map(a, 'v', f'pow(v - {m}, {n}e0)'))} / {w}e0")
    return moment(power), moment(2)


@feature("ROLL_SKEW_20", "statistical")
def _(p: Plan) -> str:
    m3, m2 = centred(p, 3)
    return norm(p, f"{m3} / (pow(sqrt({m2}), 3e0) + {EPS})")


@feature("ROLL_KURT_20", "statistical")
def _(p: Plan) -> str:
    m4, m2 = centred(p, 4)
    return norm(p, f"{m4} / ({m2} * {m2} + {EPS}) - 3e0")


@feature("HURST_50", "statistical")
def _(p: Plan) -> str:
    """Rescaled range of the window: the cumulated deviation at i is a difference of running sums less i means."""
    w, r = 50, logret(p)
    run, m = p.let(f"sum({r}) {p.k.ever}"), p.let(p.k.mean(r, w))
    sums = p.let(p.k.array([*(p.k.lag(run, k, "0e0") for k in range(w - 1, 0, -1)), run]))
    start = p.let(p.k.lag(run, w, "0e0"))
    dev = p.let(p.k.map(p.k.range("1", str(w)), "i", f"{p.k.at(sums, 'i')} - {start} - i * {m}"))
    rng, s = p.let(f"{p.k.max_of(dev)} - {p.k.min_of(dev)}"), p.let(f"sqrt({var(p, r, w)})")
    h = p.k.clamp(f"ln({rng} / ({s} + {EPS}) + {EPS}) / ln({w}e0)", "0e0", "1e0")
    return clean(p, f"case when {rng} < {EPS} or {s} < {EPS} then 0e0 else {h} * 2e0 - 1e0 end")


@feature("FRACTAL_DIM_30", "statistical")
def _(p: Plan) -> str:
    moves = p.let(f"abs(close - {before(p, 'close')})")
    rng = p.let(f"{fmax(p, 'close', 30)} - {fmin(p, 'close', 30)}")
    return clean(p, f"{p.k.clamp(f'{rng} / ({p.k.mean(moves, 30)} * sqrt(30e0) + {EPS})', '0e0', '3e0')} / 3e0 * 2e0 - 1e0")


feature("AC2", "statistical")(lambda p: clean(p, p.k.clamp(autocorr(p, 2), "-1e0", "1e0")))


@feature("RET_ENTROPY_20", "statistical")
def _(p: Plan) -> str:
    """Shares of positive, negative and zero returns; the missing head counts as zero returns."""
    r = logret(p)
    up, down = (p.let(f"{p.k.mean(p.let(f'case when {r} {o} 0e0 then 1e0 else 0e0 end'), 20)}") for o in "><")
    flat = f"(1e0 - {up} - {down})"
    h = " + ".join(f"(-{q} * ln(greatest({q}, 0e0) + {EPS}))" for q in (up, down, flat))
    return clean(p, p.k.clamp(f"({h}) / ln(3e0)", "0e0", "1e0"))


@feature("CS_RANK_RET5", "cross_sectional")
def _(p: Plan) -> str:
    r, n = logret(p, 5), p.let("count(*) over (partition by ts)")
    rank = p.let(f"row_number() over (partition by ts order by {r}, symbol)")
    return f"case when {n} = 1 then {p.let(norm(p, r))} else ({rank} - 1) / cast({n} - 1 as double) end"


@feature("CS_ZSCORE_RET20", "cross_sectional")
def _(p: Plan) -> str:
    r, n = logret(p, 20), p.let("count(*) over (partition by ts)")
    z = p.let(f"case when {n} > 1 then ({r} - avg({r}) over (partition by ts)) / (stddev_samp({r}) over (partition by ts) + {EPS}) else {r} end")
    return norm(p, z)


def table(frame: DataFrame, names: list[str] | None = None, chunk: int = 8) -> DataFrame:
    """symbol, ts and a column for each named feature (all 65 by default), of bars.

    Features are worked out `chunk` at a time and joined: rows of hundreds of window columns are slower than the joins.
    The bars are read once for each chunk, so they had better be a written table.
    """
    names = list(FEATURES) if names is None else names
    bars, out = numbered(frame), None
    for i in range(0, len(names), chunk):
        p = Plan(SPARK)
        made = p.spark(bars, {n: p.let(FEATURES[n].build(p)) for n in names[i : i + chunk]})
        out = made if out is None else out.join(made, ["symbol", "ts"])
    return out
