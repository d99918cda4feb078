"""Operators over a fixed number of last rows: averages, bands, oscillators, statistics, risk, volatility, volume."""

from __future__ import annotations

import math

from tapeworks.functions.prices import true_range
from tapeworks.plans.columns import operator

TP, HL2 = "(h + l + c) / 3", "(h + l) / 2"


def _op(family: str):
    def add(name: str, reads: str, make, **params):
        operator(name, reads, make, family, **params)

    return add


def when(condition: str, value, other="NULL") -> str:
    return f"(CASE WHEN {condition} THEN {value} ELSE {other} END)"


def clip0(x) -> str:
    return f"greatest({x}, 0e0)"


def log_return(s, x="x", k: int = 1) -> str:
    p = s.lag(x, k)
    return s.let(f"ln({x} / {p})")


def trend(s, x, n: int) -> tuple[str, str, str]:
    """Slope per row, mean and variance of the least-squares line through the last n values."""
    x = s.flat(x)
    return s.let(f"{s.roll2('covar_pop', x, s.rn(), n)} / {(n * n - 1) / 12!r}"), s.avg(x, n), s.var(x, n)


def residual(s, x, n: int) -> str:
    """Mean squared residual about that line."""
    b, _, v = trend(s, x, n)
    return s.let(clip0(f"{v} - {b} * {b} * {(n * n - 1) / 12!r}"))


def wma(s, x, n: int) -> str:
    return s.let(s.weighted(x, [2 * (k + 1) / (n * (n + 1)) for k in range(n)]))


# --- moving averages
m = _op("moving averages")
m("sma_of", "scalar", lambda s, period: s.avg("x", period), period=3)
m("wma", "scalar", lambda s, period: wma(s, "x", period), period=3)
m("hma", "scalar", lambda s, period: wma(s, f"2 * {wma(s, 'x', period // 2)} - {wma(s, 'x', period)}", round(math.sqrt(period))), period=9)
m("trima", "scalar", lambda s, period: s.avg(s.avg("x", (period + 1) // 2), period // 2 + 1), period=5)
m("vwma", "candle", lambda s, period: when(f"{s.sum('v', period)} > 0", s.div(s.sum("c * v", period), s.sum("v", period)), s.avg("c", period)), period=5)
m("geometric_ma", "scalar", lambda s, period: f"exp({s.avg('ln(x)', period)})", period=5)
m("median_ma", "scalar", lambda s, period: s.quantile("x", 0.5, period), period=5)


def _weights(raw: list[float]) -> list[float]:
    return [w / sum(raw) for w in raw]


m("sine_weighted_ma", "scalar", lambda s, period: s.weighted("x", _weights([math.sin(math.pi * (k + 1) / (period + 1)) for k in range(period)])), period=5)
m("alma", "scalar", lambda s, period, offset, sigma: s.weighted("x", _weights([math.exp(-((k - offset * (period - 1)) ** 2) / (2 * (period / sigma) ** 2)) for k in range(period)])), period=9, offset=0.85, sigma=6.0)

# --- bands
b = _op("bands and channels")


def bollinger(s, x, n: int, k: float) -> dict:
    mid, sd = s.avg(x, n), s.sd(x, n)
    return {"upper": f"{mid} + {k} * {sd}", "middle": mid, "lower": f"{mid} - {k} * {sd}", "stddev": sd}


b("bollinger_bands", "scalar", lambda s, period, multiplier: bollinger(s, "x", period, multiplier), period=5, multiplier=2.0)
b("bollinger_bandwidth", "scalar", lambda s, period, multiplier: s.div(f"2 * {multiplier} * {s.sd('x', period)}", s.avg("x", period), "0e0"), period=20, multiplier=2.0)
b("percent_b", "scalar", lambda s, period, multiplier: s.div(f"x - {s.avg('x', period)} + {multiplier} * {s.sd('x', period)}", f"2 * {multiplier} * {s.sd('x', period)}", "0.5e0"), period=20, multiplier=2.0)


def _double_bollinger(s, period, k_inner, k_outer):
    mid, sd = s.avg("x", period), s.sd("x", period)
    return {"upper_outer": f"{mid} + {k_outer} * {sd}", "upper_inner": f"{mid} + {k_inner} * {sd}", "middle": mid, "lower_inner": f"{mid} - {k_inner} * {sd}", "lower_outer": f"{mid} - {k_outer} * {sd}"}


b("double_bollinger", "scalar", _double_bollinger, period=20, k_inner=1.0, k_outer=2.0)


def _acceleration(s, period, factor):
    ratio = s.let(s.div("h - l", "(h + l)", "0e0"))
    return {"upper": s.avg(f"h * (1 + {factor} * {ratio})", period), "middle": s.avg("c", period), "lower": s.avg(f"l * (1 - {factor} * {ratio})", period)}


b("acceleration_bands", "candle", _acceleration, period=20, factor=0.001)
b("ma_envelope", "scalar", lambda s, period, percent: {"upper": f"{s.avg('x', period)} * (1 + {percent})", "middle": s.avg("x", period), "lower": f"{s.avg('x', period)} * (1 - {percent})"}, period=20, percent=0.025)


def _around(mid: str, width: str) -> dict:
    return {"upper": f"{mid} + {width}", "middle": mid, "lower": f"{mid} - {width}"}


b("hurst_channel", "candle", lambda s, period, multiplier: _around(s.avg("c", period), f"{multiplier} * ({s.max('h', period)} - {s.min('l', period)})"), period=10, multiplier=0.5)


def _linreg_end(s, x, n: int, ahead: int = 0) -> str:
    slope, mean, _ = trend(s, x, n)
    return s.let(f"{mean} + {slope} * {(n - 1) / 2 + ahead!r}")


b("linreg_channel", "scalar", lambda s, period, multiplier: _around(_linreg_end(s, "x", period), f"{multiplier} * sqrt({residual(s, 'x', period)})"), period=20, multiplier=2.0)
b("standard_error_bands", "scalar", lambda s, period, multiplier: _around(_linreg_end(s, "x", period), f"{multiplier} * sqrt({residual(s, 'x', period)} * {period / (period - 2)!r})"), period=21, multiplier=2.0)
b("quartile_bands", "scalar", lambda s, period: {"upper": s.quantile("x", 0.75, period), "middle": s.quantile("x", 0.5, period), "lower": s.quantile("x", 0.25, period)}, period=20)
b("donchian", "candle", lambda s, period: {"upper": s.max("h", period), "middle": f"({s.max('h', period)} + {s.min('l', period)}) / 2", "lower": s.min("l", period)}, period=5)
b("donchian_stop", "candle", lambda s, period: {"stop_long": s.min("l", period), "stop_short": s.max("h", period)}, period=10)


def _fractal_chaos(s, k):
    n = 2 * k + 1
    others = lambda x: [s.lag(x, i) for i in range(n) if i != k]
    high = when(" AND ".join(f"{s.lag('h', k)} > {x}" for x in others("h")), s.lag("h", k))
    low = when(" AND ".join(f"{s.lag('l', k)} < {x}" for x in others("l")), s.lag("l", k))
    up, down = s.held(s.let(high)), s.held(s.let(low))
    both = f"{up} IS NOT NULL AND {down} IS NOT NULL"
    return {"upper": when(both, up), "lower": when(both, down)}


b("fractal_chaos_bands", "candle", _fractal_chaos, k=2)


def _fractals(s):
    up = when(" AND ".join(f"{s.lag('h', 2)} > {s.lag('h', i)}" for i in (0, 1, 3, 4)), s.lag("h", 2))
    down = when(" AND ".join(f"{s.lag('l', 2)} < {s.lag('l', i)}" for i in (0, 1, 3, 4)), s.lag("l", 2))
    return {"up": up, "down": down}


b("williams_fractals", "candle", _fractals)
b("murrey_math_lines", "candle", lambda s, period: {f"mm{k}_8": f"{s.min('l', period)} + {k} * ({s.max('h', period)} - {s.min('l', period)}) / 8" for k in range(9)}, period=64)
b("volume_weighted_sr", "candle", lambda s, period: {"support": when(f"{s.sum('v', period)} > 0", s.div(s.sum("l * v", period), s.sum("v", period)), s.avg("l", period)), "resistance": when(f"{s.sum('v', period)} > 0", s.div(s.sum("h * v", period), s.sum("v", period)), s.avg("h", period))}, period=20)


def _ichimoku(s, tenkan, kijun, senkou_b, displacement):
    mid = lambda n: s.let(f"({s.max('h', n)} + {s.min('l', n)}) / 2")
    t, k = mid(tenkan), mid(kijun)
    back = displacement - 1
    return {"tenkan": t, "kijun": k, "senkou_a": s.lag(f"({t} + {k}) / 2", back), "senkou_b": s.lag(mid(senkou_b), back), "chikou": s.lag("c", back)}


b("ichimoku", "candle", _ichimoku, tenkan=5, kijun=10, senkou_b=20, displacement=10)
b("candle_volume", "candle", lambda s, period: {"body": s.ready(period, "c - o"), "width": s.div("v", s.avg("v", period), "0e0")}, period=14)
b("equivolume", "candle", lambda s, period: {"height": s.ready(period, "h - l"), "width": s.div("v", s.avg("v", period), "0e0")}, period=14)


def _median_channel(s, period, multiplier):
    med = s.quantile("x", 0.5, period)
    return _around(med, f"{multiplier} * {mad(s, 'x', period)}")


def mad(s, x, n: int) -> str:
    """Median absolute deviation from the median of the last n values."""
    values, med = s.array(x, n), s.quantile(x, 0.5, n)
    if s.spark:
        at = s.let(f"sort_array(transform({values}, e -> abs(e - {med})))")
        return s.let(f"({at}[{(n - 1) // 2}] + {at}[{n // 2}]) / 2")
    at = s.let(f"list_sort(list_transform({values}, lambda e: abs(e - {med})))")
    return s.let(f"({at}[{(n - 1) // 2 + 1}] + {at}[{n // 2 + 1}]) / 2")


b("median_channel", "scalar", _median_channel, period=20, multiplier=2.0)
b("median_absolute_deviation", "scalar", lambda s, period: mad(s, "x", period), period=20)


def _projection(s, period):
    """Highs and lows carried to the current row along their own least-squares slopes."""
    up, down = trend(s, "h", period)[0], trend(s, "l", period)[0]
    top = [f"{s.lag('h', k)} + {up} * {k}" for k in range(period)]
    low = [f"{s.lag('l', k)} + {down} * {k}" for k in range(period)]
    upper, lower = s.let(when(f"{up} IS NOT NULL", f"greatest({', '.join(top)})")), s.let(when(f"{up} IS NOT NULL", f"least({', '.join(low)})"))
    return {"upper": upper, "middle": f"({upper} + {lower}) / 2", "lower": lower}


b("projection_bands", "candle", _projection, period=14)
b("projection_oscillator", "candle", lambda s, period: (lambda p: s.div(f"100 * (c - {p['lower']})", f"({p['upper']} - {p['lower']})", "50e0"))(_projection(s, period)), period=14)

# --- momentum
o = _op("momentum oscillators")
o("mom", "scalar", lambda s, period: f"x - {s.lag('x', period)}", period=3)
o("roc", "scalar", lambda s, period: s.div(f"(x - {s.lag('x', period)}) * 100", s.lag("x", period), "0e0"), period=3)
o("rocp", "scalar", lambda s, period: s.div(f"x - {s.lag('x', period)}", s.lag("x", period), "0e0"), period=3)
o("rocr", "scalar", lambda s, period: s.div("x", s.lag("x", period), "0e0"), period=3)
o("rocr100", "scalar", lambda s, period: s.div("x * 100", s.lag("x", period), "0e0"), period=3)


def _moves(s, x="x") -> tuple[str, str]:
    d = s.let(f"{x} - {s.lag(x)}")
    return s.let(when(f"{d} IS NOT NULL", clip0(d))), s.let(when(f"{d} IS NOT NULL", clip0(f"-{d}")))


def _cmo(s, period):
    up, down = _moves(s)
    g, f = s.sum(up, period), s.sum(down, period)
    return s.div(f"100 * ({g} - {f})", f"({g} + {f})", "0e0")


o("cmo", "scalar", _cmo, period=14)
o("disparity_index", "scalar", lambda s, period: s.div(f"100 * (x - {s.avg('x', period)})", s.avg("x", period), "0e0"), period=14)


def cci(s, period, factor=0.015):
    tp = s.let(TP)
    mean, values = s.avg(tp, period), s.array(tp, period)
    dev = s.let(s.total(values, f"abs(e - {mean})"))
    return s.let(when(f"{mean} IS NOT NULL", s.div(f"({tp} - {mean}) * {period / factor!r}", dev, "0e0")))


o("cci", "candle", cci, period=5, factor=0.015)


def stochastic_of(s, x, n: int, flat: str = "50e0") -> str:
    x = s.flat(x)
    return s.let(s.div(f"100 * ({x} - {s.min(x, n)})", f"({s.max(x, n)} - {s.min(x, n)})", flat))


o("stochastic_cci", "candle", lambda s, period: stochastic_of(s, cci(s, period), period), period=14)


def _stochastic(s, k_period, d_period):
    k = s.let(s.div(f"100 * (c - {s.min('l', k_period)})", f"({s.max('h', k_period)} - {s.min('l', k_period)})", "50e0"))
    d = s.avg(k, d_period)
    return {"k": when(f"{d} IS NOT NULL", k), "d": d}


o("stochastic", "candle", _stochastic, k_period=5, d_period=3)
o("williams_r", "candle", lambda s, period: s.div(f"-100 * ({s.max('h', period)} - c)", f"({s.max('h', period)} - {s.min('l', period)})", "-50e0"), period=5)


def _imi(s, period):
    g, f = s.sum("greatest(c - o, 0e0)", period), s.sum("greatest(o - c, 0e0)", period)
    return s.div(f"100 * {g}", f"({g} + {f})", "50e0")


o("intraday_momentum_index", "candle", _imi, period=14)


def _kst(s, rocs, smas, signal):
    roc = lambda k: s.let(s.div(f"(x - {s.lag('x', k)}) * 100", s.lag("x", k), "0e0"))
    line = s.let(" + ".join(f"{k + 1} * {s.avg(roc(r), n)}" for k, (r, n) in enumerate(zip(rocs, smas, strict=True))))
    mean = s.avg(line, signal)
    return {"kst": when(f"{mean} IS NOT NULL", line), "signal": mean}


o("kst", "scalar", _kst, rocs=(2, 3, 4, 5), smas=(2, 2, 2, 3), signal=2)


def _mfi(s, period):
    tp = s.let(TP)
    p = s.lag(tp)
    up = s.sum(s.let(f"CASE WHEN {p} IS NULL THEN NULL WHEN {tp} > {p} THEN {tp} * v ELSE 0e0 END"), period)
    down = s.sum(s.let(f"CASE WHEN {p} IS NULL THEN NULL WHEN {tp} < {p} THEN {tp} * v ELSE 0e0 END"), period)
    return f"(CASE WHEN {up} = 0 AND {down} = 0 THEN 50e0 WHEN {down} = 0 THEN 100e0 ELSE 100 - 100 / (1 + {up} / nullif({down}, 0)) END)"


o("mfi", "candle", _mfi, period=5)


def _rvi(s, period):
    return s.held(when(f"{s.sum('h - l', period)} > 0", s.div(s.sum("c - o", period), s.sum("h - l", period))))


o("rvi", "candle", _rvi, period=10)


def _ultimate(s, short, mid, long):
    p = s.lag("c")
    low = s.let(when(f"{p} IS NOT NULL", f"least(l, {p})"))
    bp, tr = s.let(f"c - {low}"), s.let(f"greatest(h, {p}) - {low}")
    part = lambda n: s.div(s.sum(bp, n), s.sum(tr, n), "0.5e0")
    return when(f"{s.sum(bp, max(short, mid, long))} IS NOT NULL", f"100 * (4 * {part(short)} + 2 * {part(mid)} + {part(long)}) / 7")


o("ultimate_oscillator", "candle", _ultimate, short=7, mid=14, long=28)
ao = lambda s, fast, slow: s.let(f"{s.avg(HL2, fast)} - {s.avg(HL2, slow)}")
o("awesome_oscillator", "candle", ao, fast=3, slow=10)
o("awesome_oscillator_histogram", "candle", lambda s, fast, slow, lookback: f"{ao(s, fast, slow)} - {s.lag(ao(s, fast, slow), lookback)}", fast=3, slow=5, lookback=3)
o("accelerator_oscillator", "candle", lambda s, fast, slow, signal: f"{ao(s, fast, slow)} - {s.avg(ao(s, fast, slow), signal)}", fast=5, slow=34, signal=5)
o("anchored_rsi", "scalar", lambda s: (lambda g, f: f"(CASE WHEN {g} IS NULL THEN NULL WHEN {f} = 0 THEN CASE WHEN {g} = 0 THEN 50e0 ELSE 100e0 END ELSE 100 - 100 / (1 + {g} / nullif({f}, 0)) END)")(*[s.cum(k) for k in _moves(s)]))
o("dpo", "scalar", lambda s, period: s.ready(max(period, period // 2 + 2), f"{s.lag('x', period // 2 + 1)} - {s.avg('x', period)}"), period=20)
o("cfo", "scalar", lambda s, period: s.held(s.div(f"100 * (x - {_linreg_end(s, 'x', period)})", "x")), period=14)
o("tsf_oscillator", "scalar", lambda s, period: s.held(s.div(f"100 * (x - {_linreg_end(s, 'x', period, 1)})", "x")), period=14)


def _coppock(s, long, short, period):
    roc = lambda k: s.let(s.div(f"(x - {s.lag('x', k)}) * 100", s.lag("x", k), "0e0"))
    return wma(s, f"{roc(long)} + {roc(short)}", period)


o("coppock", "scalar", _coppock, long=14, short=11, period=10)
o("center_of_gravity", "scalar", lambda s, period: s.ready(period, s.div(f"-({s.weighted('x', [float(period - k) for k in range(period)])})", s.sum("x", period)) + f" + {(period + 1) / 2!r}"), period=10)


def _td_demarker(s, period):
    up = s.let(f"greatest(h - {s.lag('h')}, 0e0) + 0 * {s.lag('h')}")
    down = s.let(f"greatest({s.lag('l')} - l, 0e0) + 0 * {s.lag('l')}")
    return s.div(s.sum(up, period), f"({s.sum(up, period)} + {s.sum(down, period)})", "0.5e0")


o("td_demarker", "candle", _td_demarker, period=14)
o("td_moving_average", "candle", lambda s, st1, st2: {"st1": when(f"{s.avg(HL2, st2)} IS NOT NULL", s.avg(HL2, st1)), "st2": s.avg(HL2, st2)}, st1=5, st2=13)
o("td_pressure", "candle", lambda s, period: s.div(f"100 * {s.sum(s.div('(c - o) * v', '(h - l)', '0e0'), period)}", s.sum("v", period), "0e0"), period=5)


def _td_rei(s, period):
    h2, l2, h5, l5, h6, l6 = s.lag("h", 2), s.lag("l", 2), s.lag("h", 5), s.lag("l", 5), s.lag("h", 6), s.lag("l", 6)
    raw = f"(h - {h2}) + (l - {l2})"
    up = s.let(f"CASE WHEN {h6} IS NULL THEN NULL WHEN (h >= {l5} OR h >= {l6}) AND (l <= {h5} OR l <= {h6}) THEN {raw} ELSE 0e0 END")
    size = s.let(when(f"{h6} IS NOT NULL", f"abs(h - {h2}) + abs(l - {l2})"))
    return s.div(f"100 * {s.sum(up, period)}", s.sum(size, period), "0e0")


o("td_rei", "candle", _td_rei, period=5)

# --- trend
t = _op("trend")


def _aroon(s, period):
    n = period + 1
    place = lambda x, f: s.let("CASE " + " ".join(f"WHEN {s.lag(x, k)} = {f(x, n)} THEN {100 * (period - k) / period!r}" for k in range(n)) + " END")
    return {"up": place("h", s.max), "down": place("l", s.min)}


t("aroon", "candle", _aroon, period=5)
t("aroon_oscillator", "candle", lambda s, period: (lambda a: f"{a['up']} - {a['down']}")(_aroon(s, period)), period=5)
t("choppiness_index", "candle", lambda s, period: (lambda span: f"(CASE WHEN {span} = 0 THEN 100e0 ELSE 100 * log10({s.sum(true_range(s), period)} / nullif({span}, 0)) / {math.log10(period)!r} END)")(s.let(f"{s.max('h', period)} - {s.min('l', period)}")), period=14)
t("qstick", "candle", lambda s, period: s.avg("c - o", period), period=5)


def _tii(s, sma_period, dev_period):
    d = s.let(f"x - {s.avg('x', sma_period)}")
    up, down = s.sum(s.let(when(f"{d} IS NOT NULL", clip0(d))), dev_period), s.sum(s.let(when(f"{d} IS NOT NULL", clip0(f"-{d}"))), dev_period)
    return s.div(f"100 * {up}", f"({up} + {down})", "50e0")


t("tii", "scalar", _tii, sma_period=20, dev_period=10)
t("trend_label", "scalar", lambda s, period: f"sign({trend(s, 'x', period)[0]})", period=10)


def _r2(s, x, n: int, flat: str) -> str:
    slope, _, v = trend(s, x, n)
    return s.div(f"{slope} * {slope} * {(n * n - 1) / 12!r}", v, flat)


t("trend_strength_index", "scalar", lambda s, period: f"(CASE WHEN {trend(s, 'x', period)[0]} >= 0 THEN 1 ELSE -1 END) * {_r2(s, 'x', period, '0e0')}", period=20)
t("r_squared", "scalar", lambda s, period: _r2(s, "x", period, "1e0"), period=14)
t("correlation_trend_indicator", "scalar", lambda s, period: (lambda p: s.div(f"{p[0]} * {math.sqrt((period**2 - 1) / 12)!r}", f"sqrt({p[2]})", "0e0"))(trend(s, "x", period)), period=20)
t("ttm_trend", "candle", lambda s, period: when(f"{s.avg(HL2, period)} IS NULL", "NULL", f"CASE WHEN c > {s.avg(HL2, period)} THEN 1e0 ELSE -1e0 END"), period=6)
t("vertical_horizontal_filter", "scalar", lambda s, period: s.div(f"{s.max('x', period)} - {s.min('x', period)}", s.sum(f"abs(x - {s.lag('x')})", period), "0e0"), period=28)


def _vortex(s, period):
    tr = s.let(when(f"{s.lag('c')} IS NOT NULL", true_range(s)))
    total = s.sum(tr, period)
    return {"plus": s.div(s.sum(f"abs(h - {s.lag('l')})", period), total, "0e0"), "minus": s.div(s.sum(f"abs(l - {s.lag('h')})", period), total, "0e0")}


t("vortex", "candle", _vortex, period=14)
t("linear_regression", "scalar", lambda s, period: _linreg_end(s, "x", period), period=14)
t("linreg_slope", "scalar", lambda s, period: trend(s, "x", period)[0], period=14)
t("linreg_angle", "scalar", lambda s, period: f"degrees(atan({trend(s, 'x', period)[0]}))", period=14)
t("linreg_intercept", "scalar", lambda s, period: (lambda p: f"{p[1]} - {p[0]} * {(period - 1) / 2!r}")(trend(s, "x", period)), period=14)
t("tsf", "scalar", lambda s, period: _linreg_end(s, "x", period, 1), period=14)


# --- statistics
p = _op("price statistics")
p("variance", "scalar", lambda s, period: s.var("x", period), period=20)
p("std_dev", "scalar", lambda s, period: s.sd("x", period), period=20)
p("z_score", "scalar", lambda s, period: s.div(f"x - {s.avg('x', period)}", s.sd("x", period), "0e0"), period=20)
p("coefficient_of_variation", "scalar", lambda s, period: s.div(s.sd("x", period), s.avg("x", period), "0e0"), period=20)
p("detrended_std_dev", "scalar", lambda s, period: f"sqrt({residual(s, 'x', period)})", period=14)
p("standard_error", "scalar", lambda s, period: f"sqrt({residual(s, 'x', period)} * {period / (period - 2)!r})", period=14)


def moments(s, x, n: int) -> tuple[str, str, str]:
    """Second to fourth central moments of the last n values."""
    values, mean = s.array(x, n), s.avg(x, n)
    part = lambda k: s.let(s.total(values, "*".join([f"(e - {mean})"] * k)) + f" / {n}")
    return part(2), part(3), part(4)


def _skew(s, period):
    m2, m3, _ = moments(s, "x", period)
    return s.div(m3, f"pow({m2}, 1.5e0)", "0e0")


def _kurt(s, period):
    m2, _, m4 = moments(s, "x", period)
    return f"(CASE WHEN {m2} = 0 THEN 0e0 ELSE {m4} / nullif({m2} * {m2}, 0) - 3 END)"


p("skewness", "scalar", _skew, period=20)
p("kurtosis", "scalar", _kurt, period=20)
p("jarque_bera", "scalar", lambda s, period: f"{period / 6!r} * ({s.let(_skew(s, period))} * {s.let(_skew(s, period))} + {s.let(_kurt(s, period))} * {s.let(_kurt(s, period))} / 4)", period=50)
p("log_return", "scalar", lambda s, period: log_return(s, "x", period), period=1)
p("mid_point", "scalar", lambda s, period: f"({s.max('x', period)} + {s.min('x', period)}) / 2", period=5)
p("mid_price", "candle", lambda s, period: f"({s.max('h', period)} + {s.min('l', period)}) / 2", period=5)
p("rolling_iqr", "scalar", lambda s, period: f"{s.quantile('x', 0.75, period)} - {s.quantile('x', 0.25, period)}", period=20)
p("rolling_min_max_scaler", "scalar", lambda s, period: s.div(f"x - {s.min('x', period)}", f"({s.max('x', period)} - {s.min('x', period)})", "0.5e0"), period=14)
p("rolling_quantile", "scalar", lambda s, period, quantile: s.quantile("x", quantile, period), period=5, quantile=0.5)
p("rolling_percentile_rank", "scalar", lambda s, period: s.let(s.total(s.array("x", period), "CASE WHEN e < x THEN 1e0 WHEN e = x THEN 0.5e0 ELSE 0e0 END")) + f" * {100 / period!r}", period=20)
p("realized_volatility", "scalar", lambda s, period: (lambda r: f"sqrt({s.sum(f'{r} * {r}', period)})")(log_return(s)), period=20)


def _autocorrelation(s, period, lag):
    mean = s.avg("x", period)
    d = [s.let(f"{s.lag('x', k)} - {mean}") for k in range(period)]
    return s.div(" + ".join(f"{d[k]} * {d[k + lag]}" for k in range(period - lag)), "(" + " + ".join(f"{e} * {e}" for e in d) + ")", "0e0")


p("autocorrelation", "scalar", _autocorrelation, period=20, lag=1)


def beta(s, y, x, n: int, flat: str = "0e0") -> str:
    return s.let(s.div(s.roll2("covar_pop", y, x, n), s.var(x, n), flat))


def correlation(s, x, y, n: int) -> str:
    return s.div(s.roll2("covar_pop", x, y, n), f"sqrt({s.var(x, n)} * {s.var(y, n)})", "0e0")


p("beta", "pair", lambda s, period: beta(s, "x", "y", period), period=20)
p("beta_neutral_spread", "pair", lambda s, period: f"x - {s.avg('x', period)} - {beta(s, 'x', 'y', period)} * (y - {s.avg('y', period)})", period=20)
p("pearson_correlation", "pair", lambda s, period: correlation(s, "x", "y", period), period=20)
p("rolling_correlation", "pair", lambda s, period: correlation(s, s.let(f"x - {s.lag('x')}"), s.let(f"y - {s.lag('y')}"), period), period=10)
p("rolling_covariance", "pair", lambda s, period: s.roll2("covar_pop", f"x - {s.lag('x')}", f"y - {s.lag('y')}", period), period=5)
p("pairwise_beta", "pair", lambda s, period: beta(s, log_return(s), log_return(s, "y"), period), period=10)


def _pair_z(s, beta_period, z_period):
    a, c = s.let("ln(x)"), s.let("ln(y)")
    spread = s.let(f"{a} - {beta(s, a, c, beta_period)} * {c}")
    return s.div(f"{spread} - {s.avg(spread, z_period)}", s.sd(spread, z_period), "0e0")


p("pair_spread_z_score", "pair", _pair_z, beta_period=20, z_period=20)
p("spread_bollinger_bands", "pair", lambda s, period, num_std: (lambda d: (lambda q: {"middle": q["middle"], "upper": q["upper"], "lower": q["lower"], "percent_b": s.div(f"{d} - ({q['lower']})", f"({2 * num_std} * {q['stddev']})", "0.5e0")})(bollinger(s, d, period, num_std)))(s.let("x - y")), period=20, num_std=2.0)


def _lagged(s, period, difference: bool):
    d = s.let("x - y")
    prev = s.lag(d)
    nxt = s.let(f"{d} - {prev}") if difference else d
    n = period - 1
    return s.let(when(f"{s.rn()} >= {period}", s.div(s.roll2("covar_pop", nxt, s.let(f"{prev} + 0 * {d}"), n), s.var(prev, n), "0e0")))


p("spread_ar1_coefficient", "pair", lambda s, period: _lagged(s, period, False), period=40)
p("ou_half_life", "pair", lambda s, period: (lambda k: f"(CASE WHEN {k} IS NULL THEN NULL WHEN {k} >= 0 THEN 0e0 ELSE {-math.log(2)!r} / nullif({k}, 0) END)")(_lagged(s, period, True)), period=40)
p("hasbrouck_information_share", "pair", lambda s, period: (lambda a, c: s.div(a, f"({a} + {c})", "0.5e0"))(s.var(f"x - {s.lag('x')}", period), s.var(f"y - {s.lag('y')}", period)), period=20)
p("distance_ssd", "pair", lambda s, period: (lambda a, c: " + ".join(f"pow({s.lag('x', k)} / {a} - {s.lag('y', k)} / {c}, 2)" for k in range(period)))(s.lag("x", period - 1), s.lag("y", period - 1)), period=20)

# --- risk
r = _op("risk and performance")
up_, down_ = "greatest(x, 0e0)", "greatest(-x, 0e0)"
r("sharpe_ratio", "scalar", lambda s, period, risk_free: s.div(f"{s.avg('x', period)} - {risk_free}", s.sds("x", period), "0e0"), period=20, risk_free=0.0)
r("m2_measure", "scalar", lambda s, period, risk_free, benchmark_stddev: s.div(f"({s.avg('x', period)} - {risk_free}) * {benchmark_stddev}", s.sds("x", period), f"{-risk_free}") + f" + {risk_free}", period=20, risk_free=0.0, benchmark_stddev=0.02)
r("sortino_ratio", "scalar", lambda s, period, mar: s.div(f"{s.avg('x', period)} - {mar}", f"sqrt({s.avg(f'pow(least(x - {mar}, 0e0), 2)', period)})", "0e0"), period=20, mar=0.0)
r("upside_potential_ratio", "scalar", lambda s, period, mar: s.div(s.avg(f"greatest(x - {mar}, 0e0)", period), f"sqrt({s.avg(f'pow(least(x - {mar}, 0e0), 2)', period)})", "0e0"), period=20, mar=0.0)
r("omega_ratio", "scalar", lambda s, period, threshold: _gain_loss(s, f"greatest(x - {threshold}, 0e0)", f"greatest({threshold} - x, 0e0)", period), period=20, threshold=0.0)


def _gain_loss(s, gain, loss, n: int) -> str:
    """Gains over losses; without losses 1 if there are no gains either, else infinite."""
    g, f = s.sum(gain, n), s.sum(loss, n)
    return s.div(g, f, f"CASE WHEN {g} = 0 THEN 1e0 ELSE CAST('Infinity' AS DOUBLE) END")


r("profit_factor", "scalar", lambda s, period: _gain_loss(s, up_, down_, period), period=20)
r("gain_to_pain_ratio", "scalar", lambda s, period: s.div(s.sum("x", period), s.sum(down_, period), "0e0"), period=12)
r("win_rate", "scalar", lambda s, period: s.avg("CASE WHEN x > 0 THEN 1e0 ELSE 0e0 * x END", period), period=4)


def _wins(s, n: int) -> tuple[str, str, str, str]:
    return s.sum(up_, n), s.sum("CASE WHEN x > 0 THEN 1e0 ELSE 0e0 * x END", n), s.sum(down_, n), s.sum("CASE WHEN x < 0 THEN 1e0 ELSE 0e0 * x END", n)


def _gain_loss_ratio(s, period):
    g, ng, f, nf = _wins(s, period)
    return f"(CASE WHEN {nf} = 0 THEN CASE WHEN {ng} = 0 THEN 1e0 ELSE CAST('Infinity' AS DOUBLE) END WHEN {ng} = 0 THEN 0e0 ELSE ({g} / nullif({ng}, 0)) / ({f} / nullif({nf}, 0)) END)"


r("gain_loss_ratio", "scalar", _gain_loss_ratio, period=10)


def _kelly(s, period):
    g, ng, f, nf = _wins(s, period)
    return f"(CASE WHEN {nf} = 0 THEN {ng} / {period} WHEN {ng} = 0 THEN -1e0 ELSE {ng} / {period} - (1 - {ng} / {period}) * ({f} / nullif({nf}, 0)) / ({g} / nullif({ng}, 0)) END)"


r("kelly_criterion", "scalar", _kelly, period=10)
r("expectancy", "scalar", lambda s, period: (lambda w: f"(CASE WHEN {w[3]} = 0 THEN 0e0 ELSE {s.avg('x', period)} / nullif({w[2]} / nullif({w[3]}, 0), 0) END)")(_wins(s, period)), period=4)
r("tail_ratio", "scalar", lambda s, period: s.div(s.quantile("x", 0.95, period), f"abs({s.quantile('x', 0.05, period)})", "0e0"), period=20)
r("common_sense_ratio", "scalar", lambda s, period: s.div(f"{s.sum(up_, period)} * {s.quantile('x', 0.95, period)}", f"({s.sum(down_, period)} * abs({s.quantile('x', 0.05, period)}))", "0e0"), period=20)
r("value_at_risk", "scalar", lambda s, period, confidence: (lambda q: when(f"{q} IS NOT NULL", clip0(f"-({q})")))(s.quantile("x", round(1 - confidence, 12), period)), period=100, confidence=0.95)
r("information_ratio", "pair", lambda s, period: s.div(s.avg("x - y", period), s.sds("x - y", period), "0e0"), period=10)
r("alpha", "pair", lambda s, period, risk_free: f"{s.avg('x', period)} - ({risk_free} + {beta(s, 'x', 'y', period)} * ({s.avg('y', period)} - {risk_free}))", period=20, risk_free=0.001)
r("treynor_ratio", "pair", lambda s, period, risk_free: s.div(f"{s.avg('x', period)} - {risk_free}", beta(s, "x", "y", period), "0e0"), period=20, risk_free=0.001)


def _peaks(s, n: int, returns: bool) -> tuple[list[str], str]:
    """Drawdowns, as fractions of the peak so far, at each of the last n rows; and the mean of x."""
    values = [s.lag("x", n - 1 - k) for k in range(n)]
    if returns:
        curve = [s.let(f"(1 + {values[0]})")]
        for x in values[1:]:
            curve.append(s.let(f"{curve[-1]} * (1 + {x})"))
    else:
        curve = values
    peak, out = curve[0], []
    for k, e in enumerate(curve):
        peak = s.let(f"greatest({peak}, {e})") if k else e
        out.append(s.let(f"CASE WHEN {peak} > 0 THEN ({peak} - {e}) / {peak} ELSE 0e0 * {e} END"))
    return out, s.avg("x", n)


r("max_drawdown", "scalar", lambda s, period: s.ready(period, f"-greatest({', '.join(_peaks(s, period, False)[0])})"), period=10)
r("pain_index", "scalar", lambda s, period: s.ready(period, f"({' + '.join(_peaks(s, period, False)[0])}) / {period}"), period=10)
r("calmar_ratio", "scalar", lambda s, period: (lambda d: s.ready(period, s.div(d[1], f"greatest({', '.join(d[0])})", "0e0")))(_peaks(s, period, True)), period=20)
r("burke_ratio", "scalar", lambda s, period: (lambda d: s.ready(period, s.div(d[1], f"sqrt({' + '.join(f'{e} * {e}' for e in d[0])})", "0e0")))(_peaks(s, period, True)), period=12)
r("sterling_ratio", "scalar", lambda s, period: (lambda d: s.ready(period, s.div(d[1], f"(({' + '.join(d[0])}) / {period})", "0e0")))(_peaks(s, period, True)), period=12)
r("martin_ratio", "scalar", lambda s, period: (lambda d: s.ready(period, s.div(f"100 * {d[1]}", f"sqrt(({' + '.join(f'{e} * {e} * 10000' for e in d[0])}) / {period})", "0e0")))(_peaks(s, period, True)), period=14)
r("recovery_factor", "scalar", lambda s: _recovery(s))


def _recovery(s):
    first = s.let(f"first_value(x) OVER {s.over()}")
    dd = s.cum(s.let(f"CASE WHEN {s.cum('x', 'max')} > 0 THEN ({s.cum('x', 'max')} - x) / {s.cum('x', 'max')} ELSE 0e0 END"), "max")
    return f"(CASE WHEN {dd} > 0 AND {first} <> 0 THEN (x / nullif({first}, 0) - 1) / nullif({dd}, 0) ELSE 0e0 END)"


def _duration(s):
    top = s.let(f"CASE WHEN x >= {s.cum('x', 'max')} THEN {s.rn()} END")
    return f"{s.rn()} - {s.held(top)}"


r("drawdown_duration", "scalar", _duration)

# --- volatility
v = _op("volatility")
v("historical_volatility", "scalar", lambda s, period, trading_periods: f"{s.sds(log_return(s), period)} * {100 * math.sqrt(trading_periods)!r}", period=20, trading_periods=252)
v("bipower_variation", "scalar", lambda s, period: (lambda a: s.ready(period + 1, f"{math.pi / 2!r} * {s.sum(f'{a} * {s.lag(a)}', period - 1)}"))(s.let(f"abs({log_return(s)})")), period=20)
v("garman_klass_volatility", "candle", lambda s, period, trading_periods: f"sqrt(greatest({s.avg(f'0.5e0 * pow(ln(h / l), 2) - {2 * math.log(2) - 1!r} * pow(ln(c / o), 2)', period)}, 0e0)) * {100 * math.sqrt(trading_periods)!r}", period=20, trading_periods=252)
v("parkinson_volatility", "candle", lambda s, period, trading_periods: f"sqrt({s.avg('pow(ln(h / l), 2)', period)} * {1 / (4 * math.log(2))!r}) * {100 * math.sqrt(trading_periods)!r}", period=20, trading_periods=252)
_RS = "(ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o))"
v("rogers_satchell_volatility", "candle", lambda s, period, trading_periods: f"sqrt(greatest({s.avg(_RS, period)}, 0e0)) * {100 * math.sqrt(trading_periods)!r}", period=20, trading_periods=252)


def _yang_zhang(s, period, trading_periods):
    k = 0.34 / (1.34 + (period + 1) / (period - 1))
    on, oc = s.roll("var_samp", f"ln(o / {s.lag('c')})", period), s.roll("var_samp", s.let(f"ln(c / o) + 0 * {s.lag('c')}"), period)
    rs = s.avg(s.let(f"{_RS} + 0 * {s.lag('c')}"), period)
    return f"sqrt(greatest({on} + {k!r} * {oc} + {1 - k!r} * greatest({rs}, 0e0), 0e0)) * {100 * math.sqrt(trading_periods)!r}"


v("yang_zhang_volatility", "candle", _yang_zhang, period=20, trading_periods=252)


def _jump(s, period, threshold):
    ret = log_return(s)
    d = s.let(f"{ret} - {s.roll('avg', ret, period, 1)}")
    sd = s.sds(ret, period, 1)
    return f"(CASE WHEN {d} IS NULL THEN NULL WHEN {sd} = 0 THEN 0e0 WHEN {d} > {threshold} * {sd} THEN 1e0 WHEN {d} < -{threshold} * {sd} THEN -1e0 ELSE 0e0 END)"


v("jump_indicator", "scalar", _jump, period=20, threshold=3.0)


def _regime(s, vol_period, lookback):
    vol = s.sds(log_return(s), vol_period)
    q1, q3 = s.quantile(vol, 0.25, lookback), s.quantile(vol, 0.75, lookback)
    return f"(CASE WHEN {q1} IS NULL THEN NULL WHEN {vol} < {q1} THEN -1e0 WHEN {vol} > {q3} THEN 1e0 ELSE 0e0 END)"


v("regime_label", "scalar", _regime, vol_period=5, lookback=20)
v("volatility_of_volatility", "scalar", lambda s, vol_window, vov_window: s.sds(s.sds(log_return(s), vol_window), vov_window), vol_window=20, vov_window=20)


def _ulcer(s, period):
    top = s.max("x", period)
    d = s.let(s.div(f"100 * (x - {top})", top, "0e0"))
    return f"sqrt({s.avg(f'{d} * {d}', period)})"


v("ulcer_index", "scalar", _ulcer, period=14)

# --- volume
q = _op("volume")
_MFV = lambda s: s.let(s.div("((c - l) - (h - c)) * v", "(h - l)", "0e0"))
q("better_volume", "candle", lambda s, period: s.div("v", s.avg("v", period), "0e0") + " - " + s.div("(h - l)", s.avg("h - l", period), "0e0"), period=20)
q("chaikin_money_flow", "candle", lambda s, period: s.div(s.sum(_MFV(s), period), s.sum("v", period), "0e0"), period=20)
q("ease_of_movement", "candle", lambda s, period, divisor: s.avg(s.let(s.div(f"({HL2} - {s.lag(HL2)}) * (h - l) * {divisor}", "v", f"0e0 * {s.lag(HL2)}")), period), period=14, divisor=1e8)
q("tsv", "candle", lambda s, period: s.sum(f"(c - {s.lag('c')}) * v", period), period=18)
q("volume_oscillator", "candle", lambda s, fast, slow: s.div(f"100 * ({s.avg('v', fast)} - {s.avg('v', slow)})", s.avg("v", slow), "0e0"), fast=14, slow=28)
q("rolling_vwap", "candle", lambda s, period: s.div(s.sum(f"({TP}) * v", period), s.sum("v", period)), period=14)
q("vwap", "candle", lambda s: s.div(s.cum(f"({TP}) * v"), s.cum("v")))
q("anchored_vwap", "candle", lambda s: s.div(s.cum(f"({TP}) * v"), s.cum("v")))
q("adl", "candle", lambda s: s.cum(_MFV(s)))
q("obv", "candle", lambda s: s.cum(s.let(f"coalesce(sign(c - {s.lag('c')}) * v, 0e0)")))
q("volume_price_trend", "candle", lambda s: s.cum(s.let(f"coalesce({s.div(f'v * (c - {s.lag(chr(99))})', s.lag('c'), '0e0')}, 0e0)")))


def _index(s, sign: str, base: float):
    p, w = s.lag("c"), s.lag("v")
    return f"{base} * exp({s.cum(s.let(f'CASE WHEN v {sign} {w} AND {p} <> 0 THEN ln(c / nullif({p}, 0)) ELSE 0e0 END'))})"


q("nvi", "candle", lambda s, base: _index(s, "<", base), base=1000.0)
q("pvi", "candle", lambda s, base: _index(s, ">", base), base=1000.0)


def wad(s):
    p = s.lag("c")
    return s.cum(s.let(f"CASE WHEN {p} IS NULL THEN NULL WHEN c > {p} THEN c - least(l, {p}) WHEN c < {p} THEN c - greatest(h, {p}) ELSE 0e0 END"))


q("wad", "candle", wad)
q("ad_oscillator", "candle", lambda s, signal: f"{wad(s)} - {s.avg(wad(s), signal)}", signal=13)


def _tvi(s, min_tick):
    d = s.let(f"c - {s.lag('c')}")
    way = s.held(s.let(f"CASE WHEN {d} > {min_tick} THEN 1e0 WHEN {d} < -{min_tick} THEN -1e0 END"))
    return when(f"{d} IS NOT NULL", s.cum(s.let(f"coalesce({way}, 0e0) * v * CASE WHEN {d} IS NULL THEN 0 ELSE 1 END")))


q("trade_volume_index", "candle", _tvi, min_tick=0.5)


def _vwap_bands(s, multiplier):
    base = s.let(f"first_value({s.let(TP)}) OVER {s.over()}")
    d = s.let(f"{s.let(TP)} - {base}")
    vol = s.cum("v")
    mean = s.let(s.div(s.cum(f"{d} * v"), vol))
    sd = s.let(f"sqrt(greatest({s.div(s.cum(f'{d} * {d} * v'), vol)} - {mean} * {mean}, 0e0))")
    mid = f"{base} + {mean}"
    return {"upper": f"{mid} + {multiplier} * {sd}", "middle": mid, "lower": f"{mid} - {multiplier} * {sd}", "stddev": sd}


q("vwap_std_dev_bands", "candle", _vwap_bands, multiplier=2.0)
q("time_based_stop", "candle", lambda s, max_bars: f"least({s.rn()} / {max_bars}, 1e0)", max_bars=5)
