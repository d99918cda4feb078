"""Operators that remember all of the past through exponentially fading sums, as window expressions."""

from __future__ import annotations

import math

from tapeworks.functions.prices import true_range
from tapeworks.functions.windows import HL2, TP, _linreg_end, _moves, _rvi, clip0, log_return, stochastic_of, when
from tapeworks.plans.columns import operator

ALL, OSC, TREND, VOL, FLOW, STOP, BAND, AVG = "charts", "momentum oscillators", "trend", "volatility", "volume", "trailing stops", "bands and channels", "moving averages"


def _add(name: str, reads: str, family: str, make, **params) -> None:
    operator(name, reads, make, family, **params)


def atr(s, n: int) -> str:
    return s.rma(true_range(s), n)


def share(s, up: str, down: str, n: int) -> str:
    """100 times Wilder's average of up as a share of up and down; 50 where both are 0."""
    a, b = s.rma(up, n), s.rma(down, n)
    return s.let(s.div(f"100 * {a}", f"({a} + {b})", "50e0"))


def rsi(s, x, n: int) -> str:
    x = s.flat(x)
    return share(s, *_moves(s, x), n)


# --- moving averages
_add("ema", "scalar", AVG, lambda s, period: s.ema("x", period), period=3)
_add("smma", "scalar", AVG, lambda s, period: s.rma("x", period), period=3)


def _chain(s, x, n: int, depth: int) -> list[str]:
    out = [s.ema(x, n)]
    while len(out) < depth:
        out.append(s.ema(out[-1], n))
    return out


def _dema(s, period, v=1.0):
    a, b = _chain(s, "x", period, 2)
    return f"{1 + v!r} * {a} - {v!r} * {b}"


_add("dema", "scalar", AVG, _dema, period=3)
_add("generalized_dema", "scalar", AVG, _dema, period=5, v=0.7)
_add("tema", "scalar", AVG, lambda s, period: "3 * {0} - 3 * {1} + {2}".format(*_chain(s, "x", period, 3)), period=3)


def _t3(s, period, v):
    e = _chain(s, "x", period, 6)
    c = (-(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2)
    return " + ".join(f"{k!r} * {x}" for k, x in zip(c, reversed(e[2:]), strict=True))


_add("t3", "scalar", AVG, _t3, period=5, v=0.7)
_add("ehma", "scalar", AVG, lambda s, period: s.ema(f"2 * {s.ema('x', max(1, period // 2))} - {s.ema('x', period)}", max(1, round(math.sqrt(period)))), period=9)


def zlema(s, x, n: int) -> str:
    x = s.flat(x)
    return s.ema(f"2 * {x} - {s.lag(x, (n - 1) // 2)}", n)


_add("zlema", "scalar", AVG, lambda s, period: zlema(s, "x", period), period=10)


def _alligator(s, jaw, teeth, lips) -> dict:
    lines = [s.rma(HL2, n) for n in (jaw, teeth, lips)]
    ready = " AND ".join(f"{x} IS NOT NULL" for x in lines)
    return {k: s.let(when(ready, x)) for k, x in zip(("jaw", "teeth", "lips"), lines, strict=True)}


_add("alligator", "candle", AVG, _alligator, jaw=5, teeth=3, lips=2)
_add("gator_oscillator", "candle", TREND, lambda s, jaw, teeth, lips: (lambda a: {"upper": f"abs({a['jaw']} - {a['teeth']})", "lower": f"-abs({a['teeth']} - {a['lips']})"})(_alligator(s, jaw, teeth, lips)), jaw=5, teeth=3, lips=2)


# --- differences of averages
def macd(s, fast: str, slow: str, signal, n: int) -> dict:
    line = s.let(f"{fast} - {slow}")
    sig = signal(line, n)
    return {"macd": when(f"{sig} IS NOT NULL", line), "signal": sig, "histogram": f"{line} - {sig}"}


def _macd(s, fast, slow, signal):
    return macd(s, s.ema("x", fast), s.ema("x", slow), s.ema, signal)


_add("macd", "scalar", TREND, _macd, fast=3, slow=6, signal=3)
_add("macd_fix", "scalar", TREND, lambda s, signal: _macd(s, 12, 26, signal), signal=9)
_add("macd_histogram", "scalar", OSC, lambda s, fast, slow, signal: _macd(s, fast, slow, signal)["histogram"], fast=12, slow=26, signal=9)
_add("macd_ext", "scalar", TREND, lambda s, fast, slow, signal, kinds: (lambda f: macd(s, f[kinds[0]]("x", fast), f[kinds[1]]("x", slow), f[kinds[2]], signal))({"sma": s.avg, "ema": s.ema}), fast=12, slow=26, signal=9, kinds=("ema", "sma", "ema"))
_add("zero_lag_macd", "scalar", OSC, lambda s, fast, slow, signal: macd(s, zlema(s, "x", fast), zlema(s, "x", slow), lambda x, n: zlema(s, x, n), signal), fast=3, slow=5, signal=3)
_add("apo", "scalar", OSC, lambda s, fast, slow: f"{s.ema('x', fast)} - {s.ema('x', slow)}", fast=12, slow=26)


def ppo(s, fast, slow) -> str:
    return s.let(s.div(f"100 * ({s.ema('x', fast)} - {s.ema('x', slow)})", s.ema("x", slow), "0e0"))


_add("ppo", "scalar", OSC, ppo, fast=12, slow=26)
_add("ppo_histogram", "scalar", OSC, lambda s, fast, slow, signal: f"{ppo(s, fast, slow)} - {s.ema(ppo(s, fast, slow), signal)}", fast=12, slow=26, signal=9)


def _impulse(s, ema_period, fast, slow, signal):
    """1 where the average and the histogram both rise, -1 where both fall."""
    e, h = s.ema("x", ema_period), s.let(_macd(s, fast, slow, signal)["histogram"])
    de, dh = s.let(f"sign({e} - {s.lag(e)})"), s.let(f"sign({h} - {s.lag(h)})")
    return f"(CASE WHEN {de} IS NULL OR {dh} IS NULL THEN NULL WHEN {de} > 0 AND {dh} > 0 THEN 1e0 WHEN {de} < 0 AND {dh} < 0 THEN -1e0 ELSE 0e0 END)"


_add("elder_impulse", "scalar", OSC, _impulse, ema_period=3, fast=2, slow=4, signal=3)

# --- oscillators
_add("rsi", "scalar", OSC, lambda s, period: rsi(s, "x", period), period=3)
_add("volume_rsi", "candle", FLOW, lambda s, period: rsi(s, "v", period), period=14)
_add("stoch_rsi", "scalar", OSC, lambda s, rsi_period, stoch_period: stochastic_of(s, rsi(s, "x", rsi_period), stoch_period), rsi_period=14, stoch_period=14)


def _rmi(s, period, momentum):
    d = s.let(f"x - {s.lag('x', momentum)}")
    part = lambda e: s.let(when(f"{d} IS NOT NULL", clip0(e)))
    return share(s, part(d), part(f"-{d}"), period)


_add("rmi", "scalar", OSC, _rmi, period=14, momentum=5)


def _fisher_rsi(s, period):
    x = s.let(when(f"{rsi(s, 'x', period)} IS NOT NULL", f"least(greatest(({rsi(s, 'x', period)} - 50) / 50, -0.999e0), 0.999e0)"))
    return f"0.5e0 * ln((1 + {x}) / (1 - {x}))"


_add("fisher_rsi", "scalar", OSC, _fisher_rsi, period=9)


def _derivative(s, rsi_period, smooth1, smooth2, signal):
    twice = s.ema(s.ema(rsi(s, "x", rsi_period), smooth1), smooth2)
    return f"{twice} - {s.avg(twice, signal)}"


_add("derivative_oscillator", "scalar", OSC, _derivative, rsi_period=14, smooth1=5, smooth2=3, signal=9)


def _connors(s, period_rsi, period_streak, period_rank):
    from tapeworks.functions.patterns import streak

    sign = s.let(f"sign(x - {s.lag('x')})")
    run = s.let(f"{sign} * {streak(s, sign, '{now} IS NULL OR {before} IS NULL OR {now} <> {before}')}")
    roc = s.let(s.div(f"x - {s.lag('x')}", s.lag("x")))
    below = s.let(" + ".join(f"CASE WHEN {s.lag(roc, k)} IS NULL THEN NULL WHEN {s.lag(roc, k)} < {roc} THEN 1e0 ELSE 0e0 END" for k in range(period_rank)))
    return f"({rsi(s, 'x', period_rsi)} + {rsi(s, run, period_streak)} + {below} * {100 / period_rank!r}) / 3"


_add("connors_rsi", "scalar", OSC, _connors, period_rsi=3, period_streak=2, period_rank=5)
_add("elder_ray", "candle", OSC, lambda s, period: {"bull_power": f"h - {s.ema('c', period)}", "bear_power": f"l - {s.ema('c', period)}"}, period=13)
_add("pgo", "candle", OSC, lambda s, period: s.held(when(f"{s.ema(true_range(s), period)} > 0", f"(c - {s.avg('c', period)}) / nullif({s.ema(true_range(s), period)}, 0)")), period=14)


def _pmo(s, smoothing1, smoothing2):
    roc = s.let(s.div(f"(x - {s.lag('x')}) * 100", s.lag("x"), "0e0"))
    return s.smooth(f"10 * {s.smooth(roc, 2 / smoothing1, 1)}", 2 / smoothing2, 1)


_add("pmo", "scalar", OSC, _pmo, smoothing1=35, smoothing2=20)


def _smi(s, period, d_period, d2_period):
    hh, ll = s.max("h", period), s.min("l", period)
    d = s.ema(s.ema(f"c - ({hh} + {ll}) / 2", d_period), d2_period)
    r = s.ema(s.ema(f"{hh} - {ll}", d_period), d2_period)
    return s.held(when(f"{r} > 0", f"200 * {d} / nullif({r}, 0)"))


_add("smi", "candle", OSC, _smi, period=5, d_period=3, d2_period=3)


def _tsi(s, long, short):
    d = s.let(f"x - {s.lag('x')}")
    return s.div(f"100 * {s.ema(s.ema(d, long), short)}", s.ema(s.ema(f"abs({d})", long), short), "0e0")


_add("tsi", "scalar", OSC, _tsi, long=25, short=13)
_add("inertia", "candle", OSC, lambda s, rvi_period, linreg_period: _linreg_end(s, s.let(_rvi(s, rvi_period)), linreg_period), rvi_period=14, linreg_period=20)


def _laguerre(s, gamma):
    """Four stages, each a fading sum of the one before; all start at the first value."""
    first = s.let(f"{s.rn()} = 1")
    stage = [s.decay(f"CASE WHEN {first} THEN x ELSE {1 - gamma!r} * x END", gamma)]
    for _ in range(3):
        p = stage[-1]
        stage.append(s.decay(f"CASE WHEN {first} THEN x ELSE {s.lag(p)} - {gamma!r} * {p} END", gamma))
    up = " + ".join(clip0(f"{a} - {b}") for a, b in zip(stage, stage[1:], strict=False))
    all_ = " + ".join(f"abs({a} - {b})" for a, b in zip(stage, stage[1:], strict=False))
    return s.div(f"100 * ({up})", f"({all_})", "50e0")


_add("laguerre_rsi", "scalar", OSC, _laguerre, gamma=0.5)


def _rsx(s, length):
    f = 3 / (length + 2)
    d = s.let(f"x - {s.lag('x')}")

    def three(x: str) -> str:
        for _ in range(3):
            a = s.decay(f"{f!r} * {x}", 1 - f)
            b = s.decay(f"{f!r} * {a}", 1 - f)
            x = s.let(f"1.5e0 * {a} - 0.5e0 * {b}")
        return x

    size = three(s.let(f"abs({d})"))
    value = f"(CASE WHEN {size} > 0 THEN least(greatest(({three(d)} / nullif({size}, 0) + 1) * 50, 0e0), 100e0) ELSE 50e0 END)"
    return s.ready(length + 1, value)


_add("rsx", "scalar", OSC, _rsx, length=14)
_add("kase_permission_stochastic", "candle", TREND, lambda s, length, smooth: (lambda f: {"fast": when(f"{s.ema(f, smooth)} IS NOT NULL", f), "slow": s.ema(f, smooth)})(s.ema(s.let(s.div(f"100 * (c - {s.min('l', length)})", f"({s.max('h', length)} - {s.min('l', length)})", "50e0")), smooth)), length=9, smooth=3)


# --- directional movement
def _dm(s) -> tuple[str, str, str]:
    up, down = s.let(f"h - {s.lag('h')}"), s.let(f"{s.lag('l')} - l")
    plus = s.let(f"CASE WHEN {up} IS NULL THEN NULL WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0e0 END")
    minus = s.let(f"CASE WHEN {up} IS NULL THEN NULL WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0e0 END")
    return plus, minus, s.let(when(f"{s.lag('c')} IS NOT NULL", true_range(s)))


def wilder_sum(s, x, n: int) -> str:
    """Wilder's running sum: n times his average."""
    return s.let(f"{n} * {s.rma(x, n)}")


def _di(s, n: int) -> tuple[str, str, str]:
    plus, minus, tr = (wilder_sum(s, x, n) for x in _dm(s))
    a, b = s.let(s.div(f"100 * {plus}", tr, "0e0")), s.let(s.div(f"100 * {minus}", tr, "0e0"))
    return a, b, s.let(s.div(f"100 * abs({a} - {b})", f"({a} + {b})", "0e0"))


_add("plus_dm", "candle", TREND, lambda s, period: wilder_sum(s, _dm(s)[0], period), period=5)
_add("minus_dm", "candle", TREND, lambda s, period: wilder_sum(s, _dm(s)[1], period), period=5)
_add("plus_di", "candle", TREND, lambda s, period: _di(s, period)[0], period=5)
_add("minus_di", "candle", TREND, lambda s, period: _di(s, period)[1], period=5)
_add("dx", "candle", TREND, lambda s, period: _di(s, period)[2], period=5)


def _adx(s, period):
    a, b, dx = _di(s, period)
    adx = s.rma(dx, period)
    return {"plus_di": when(f"{adx} IS NOT NULL", a), "minus_di": when(f"{adx} IS NOT NULL", b), "adx": adx}


_add("adx", "candle", TREND, _adx, period=5)
_add("adxr", "candle", TREND, lambda s, period: f"({_adx(s, period)['adx']} + {s.lag(_adx(s, period)['adx'], period - 1)}) / 2", period=5)


# --- trend
def _mass(s, ema_period, sum_period):
    once = s.ema("h - l", ema_period)
    twice = s.ema(once, ema_period)
    return s.sum(s.let(s.div(once, twice, "1e0")), sum_period)


_add("mass_index", "candle", TREND, _mass, ema_period=9, sum_period=25)


def _pfe(s, period, smoothing):
    step = s.let(f"sqrt(pow(x - {s.lag('x')}, 2) + 1)")
    net = s.let(f"x - {s.lag('x', period)}")
    return s.ema(f"100 * sign({net}) * sqrt({net} * {net} + {period * period}) / {s.sum(step, period)}", smoothing)


_add("polarized_fractal_efficiency", "scalar", TREND, _pfe, period=10, smoothing=5)


def _trix(s, period):
    e = _chain(s, "x", period, 3)[-1]
    return s.div(f"100 * ({e} - {s.lag(e)})", s.lag(e), "0e0")


_add("trix", "scalar", TREND, _trix, period=3)


def _wave_pm(s, length, smoothing):
    m = s.let(f"x - {s.lag('x', length)}")
    energy = s.ema(f"{m} * {m}", length)
    raw = s.let(f"CASE WHEN {energy} IS NULL THEN NULL WHEN {energy} <= 0 THEN 0e0 ELSE 1 - exp(-({m} * {m}) / (2 * nullif({energy}, 0))) END")
    return f"100 * {s.ema(raw, smoothing)}"


_add("wave_pm", "scalar", TREND, _wave_pm, length=10, smoothing=3)


def _wave_trend(s, channel, average, signal):
    tp = s.let(TP)
    esa = s.ema(tp, channel)
    d = s.ema(f"abs({tp} - {esa})", channel)
    ci = s.let(f"CASE WHEN {d} IS NULL THEN NULL WHEN {d} <= greatest(abs({esa}), 1e0) * {16 * 2.0**-52!r} THEN 0e0 ELSE ({tp} - {esa}) / nullif(0.015e0 * {d}, 0) END")
    w1 = s.ema(ci, average)
    w2 = s.avg(w1, signal)
    return {"wt1": when(f"{w2} IS NOT NULL", w1), "wt2": w2}


_add("wave_trend", "candle", TREND, _wave_trend, channel=5, average=8, signal=3)

# --- bands and stops on the true range
_add("atr", "candle", VOL, lambda s, period: atr(s, period), period=5)
_add("natr", "candle", VOL, lambda s, period: s.div(f"100 * {atr(s, period)}", "c", "0e0"), period=14)


def _about(s, mid: str, width: str) -> dict:
    both = f"{mid} IS NOT NULL AND {width} IS NOT NULL"
    return {"upper": f"{mid} + {width}", "middle": when(both, mid), "lower": f"{mid} - {width}"}


_add("atr_bands", "candle", BAND, lambda s, period, multiplier: _about(s, "c", s.let(f"{multiplier} * {atr(s, period)}")), period=14, multiplier=3.0)
_add("keltner", "candle", VOL, lambda s, ema_period, atr_period, multiplier: _about(s, s.ema(TP, ema_period), s.let(f"{multiplier} * {atr(s, atr_period)}")), ema_period=5, atr_period=5, multiplier=2.0)
_add("starc_bands", "candle", BAND, lambda s, sma_period, atr_period, multiplier: _about(s, s.avg("c", sma_period), s.let(f"{multiplier} * {atr(s, atr_period)}")), sma_period=6, atr_period=15, multiplier=2.0)


def _squeeze(s, period, bb_mult, kc_mult):
    mid, sd, a = s.avg("c", period), s.sd("c", period), atr(s, period)
    base = s.let(f"(({s.max('h', period)} + {s.min('l', period)}) / 2 + {mid}) / 2")
    inside = f"{bb_mult} * {sd} <= {kc_mult} * {a}"
    return {"squeeze": when(f"{a} IS NOT NULL AND {sd} IS NOT NULL", f"CASE WHEN {inside} THEN 1e0 ELSE 0e0 END"), "momentum": f"{_linreg_end(s, 'c', period)} - {base}"}


_add("ttm_squeeze", "candle", BAND, _squeeze, period=20, bb_mult=2.0, kc_mult=1.5)
_add("chandelier_exit", "candle", STOP, lambda s, period, multiplier: {"long_stop": f"{s.max('h', period)} - {multiplier} * {atr(s, period)}", "short_stop": f"{s.min('l', period)} + {multiplier} * {atr(s, period)}"}, period=22, multiplier=3.0)
_add("chande_kroll_stop", "candle", STOP, lambda s, atr_period, multiplier, stop_period: {"stop_long": s.min(f"{s.min('l', atr_period)} + {multiplier} * {atr(s, atr_period)}", stop_period), "stop_short": s.max(f"{s.max('h', atr_period)} - {multiplier} * {atr(s, atr_period)}", stop_period)}, atr_period=10, multiplier=1.0, stop_period=9)

# --- volatility
_add("chaikin_volatility", "candle", VOL, lambda s, ema_period, roc_period: (lambda e: s.div(f"100 * ({e} - {s.lag(e, roc_period)})", s.lag(e, roc_period), "0e0"))(s.ema("h - l", ema_period)), ema_period=10, roc_period=10)


def _ewma(s, decay):
    r = log_return(s)
    return f"sqrt({s.smooth(f'{r} * {r}', 1 - decay, 1)})"


_add("ewma_volatility", "scalar", VOL, _ewma, decay=0.94)


def _garch(s, omega, alpha, beta):
    r = log_return(s)
    square = s.let(f"{r} * {r}")
    u = f"CASE WHEN {square} IS NULL THEN NULL WHEN {s.lag(square)} IS NULL THEN {omega / (1 - alpha - beta)!r} ELSE {omega!r} + {alpha!r} * {s.lag(square)} END"
    return f"sqrt({s.decay(u, beta)})"


_add("garch11", "scalar", VOL, _garch, omega=0.000002, alpha=0.10, beta=0.88)


def _rvi_volatility(s, period):
    sd, d = s.sd("x", period), s.let(f"x - {s.lag('x')}")
    side = lambda sign: s.let(when(f"{sd} IS NOT NULL AND {d} IS NOT NULL", f"CASE WHEN {d} {sign} 0 THEN {sd} ELSE 0e0 END"))
    return share(s, side(">"), side("<"), period)


_add("rvi_volatility", "scalar", VOL, _rvi_volatility, period=10)


def _volatility_ratio(s, period):
    tr = s.let(when(f"{s.lag('c')} IS NOT NULL", true_range(s)))
    before = s.lag(s.ema(tr, period))
    return s.div(tr, before, "0e0")


_add("volatility_ratio", "candle", VOL, _volatility_ratio, period=14)


# --- volume
def _chaikin(s, fast, slow):
    from tapeworks.functions.windows import _MFV

    line = s.cum(_MFV(s))
    return f"{s.ema(line, fast)} - {s.ema(line, slow)}"


_add("chaikin_oscillator", "candle", FLOW, _chaikin, fast=3, slow=10)


def _demand(s, period):
    p = s.lag("c")
    return s.ema(s.let(s.div(f"v * (c - {p}) * (1 + (h - l) / nullif({p}, 0))", p, "0e0")), period)


_add("demand_index", "candle", FLOW, _demand, period=10)
_add("force_index", "candle", FLOW, lambda s, period: s.ema(f"(c - {s.lag('c')}) * v", period), period=13)


def _twiggs(s, period):
    p = s.lag("c")
    hi, lo = s.let(when(f"{p} IS NOT NULL", f"greatest(h, {p})")), s.let(when(f"{p} IS NOT NULL", f"least(l, {p})"))
    ad = s.let(s.div(f"v * (2 * c - {hi} - {lo})", f"({hi} - {lo})", "0e0"))
    return s.div(s.rma(ad, period), s.rma(when(f"{p} IS NOT NULL", "v"), period), "0e0")


_add("twiggs_money_flow", "candle", FLOW, _twiggs, period=21)


def _vw_macd(s, fast, slow, signal):
    vwma = lambda n: s.let(when(f"{s.sum('v', n)} > 0", s.div(s.sum("c * v", n), s.sum("v", n)), s.avg("c", n)))
    return macd(s, vwma(fast), vwma(slow), s.ema, signal)


_add("volume_weighted_macd", "candle", FLOW, _vw_macd, fast=12, slow=26, signal=9)
_add("vzo", "candle", FLOW, lambda s, period: s.div(f"100 * {s.ema(f'sign(c - {s.lag(chr(99))}) * v', period)}", s.ema(when(f"{s.lag('c')} IS NOT NULL", "v"), period), "0e0"), period=14)


def _kvo(s, fast, slow):
    """The cumulative measure restarts with the sum of the last two where the trend turns."""
    dm = s.let("h + l + c")
    p = s.lag(dm)
    way = s.held(s.let(f"CASE WHEN {dm} > {p} THEN 1e0 WHEN {dm} < {p} THEN -1e0 END"))
    trend_ = s.let(when(f"{p} IS NOT NULL", f"coalesce({way}, 0e0)"))
    turn = s.let(f"CASE WHEN {trend_} IS NULL THEN 0 WHEN {s.lag(trend_)} IS NULL OR {trend_} <> {s.lag(trend_)} OR {trend_} = 0 THEN 1 ELSE 0 END")
    part = s.cum(turn)
    cm = s.let(f"sum(CASE WHEN {turn} = 1 THEN {p} + {dm} ELSE {dm} END) OVER (PARTITION BY series, {part} ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    force = s.let(when(f"{trend_} IS NOT NULL", f"CASE WHEN {cm} = 0 THEN 0e0 ELSE v * abs(2 * ({dm} / nullif({cm}, 0) - 1)) * {trend_} * 100 END"))
    return f"{s.ema(force, fast)} - {s.ema(force, slow)}"


_add("kvo", "candle", FLOW, _kvo, fast=34, slow=55)


# --- charts
def _heikin(s, o: str, h: str, l: str, c: str) -> dict:  # noqa: E741
    """The open is the fading mean of the closes before; the first is the middle of the first body."""
    close = s.let(f"({o} + {h} + {l} + {c}) / 4")
    p = s.lag(close)
    open_ = s.decay(f"CASE WHEN {close} IS NULL THEN NULL WHEN {p} IS NULL THEN ({o} + {c}) / 2 ELSE 0.5e0 * {p} END", 0.5)
    both = f"{open_} IS NOT NULL"
    return {"open": open_, "high": when(both, f"greatest({h}, {open_}, {close})"), "low": when(both, f"least({l}, {open_}, {close})"), "close": close}


_add("heikin_ashi", "candle", ALL, lambda s: _heikin(s, "o", "h", "l", "c"))
_add("heikin_ashi_oscillator", "candle", ALL, lambda s, period: (lambda k: s.ema(f"{k['close']} - {k['open']}", period))(_heikin(s, "o", "h", "l", "c")), period=5)
_add("smoothed_heikin_ashi", "candle", ALL, lambda s, period: _heikin(s, *(s.ema(x, period) for x in "ohlc")), period=10)

# --- breadth, pairs, filters
_RANA = "1000 * (adv - decl) / greatest(adv + decl, 1e0)"
_mcclellan = lambda s: s.let(f"{s.smooth(_RANA, 0.1, 1)} - {s.smooth(_RANA, 0.05, 1)}")
_add("mcclellan_oscillator", "section", "market breadth", _mcclellan)
_add("mcclellan_summation_index", "section", "market breadth", lambda s: s.cum(_mcclellan(s)))


def _relative(s, ma_period, rsi_period):
    ratio = s.let(s.div("x", "y"))
    ma, r = s.avg(ratio, ma_period), rsi(s, ratio, rsi_period)
    both = f"{ma} IS NOT NULL AND {r} IS NOT NULL"
    return {"ratio": when(both, ratio), "ratio_ma": when(both, ma), "ratio_rsi": when(both, r)}


_add("relative_strength_ab", "pair", "price statistics", _relative, ma_period=5, rsi_period=5)


def highpass(s, period: float) -> str:
    """The two-pole high pass: its double pole makes it two fading sums, one after the other."""
    a = 0.707 * 2 * math.pi / period
    alpha = (math.cos(a) + math.sin(a) - 1) / math.cos(a)
    x1, x2 = s.lag("x"), s.lag("x", 2)
    u = f"CASE WHEN {x2} IS NULL THEN 0e0 ELSE {(1 - alpha / 2) ** 2!r} * (x - 2 * {x1} + {x2}) END"
    return s.decay(s.decay(u, 1 - alpha), 1 - alpha)


_DSP = "cycles and filters"
_add("highpass_filter", "scalar", _DSP, lambda s, period: highpass(s, period), period=48)
_add("decycler", "scalar", _DSP, lambda s, period: f"x - {highpass(s, period)}", period=20)
_add("decycler_oscillator", "scalar", _DSP, lambda s, fast, slow: f"{highpass(s, slow)} - {highpass(s, fast)}", fast=10, slow=30)
