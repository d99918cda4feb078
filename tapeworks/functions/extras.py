"""Supplementary operations: elementwise mathematics, and the variants with other seeds, scales and zero rules.

Names that begin with ta_ follow the convention that an undefined ratio is 0 and that averages of price changes
start with the second row.
"""

from __future__ import annotations



from tapeworks.functions import patterns, recursive, windows  # noqa: F401  patterns: their sides are made here
from tapeworks.functions.prices import true_range
from tapeworks.functions.windows import HL2, TP, when
from tapeworks.plans.columns import OPERATORS, operator

MATH, MORE, TA = "mathematics", "supplementary", "lookback variants"

# --- elementwise; null where the result isn't finite
_UNARY = {
    "acos": "CASE WHEN x BETWEEN -1 AND 1 THEN acos(x) END", "asin": "CASE WHEN x BETWEEN -1 AND 1 THEN asin(x) END", "atan": "atan(x)", "ceil": "ceil(x)", "cos": "cos(x)", "cosh": "(exp(x) + exp(-x)) / 2",
    "exp": "exp(x)", "floor": "floor(x)", "ln": "CASE WHEN x > 0 THEN ln(x) END", "log10": "CASE WHEN x > 0 THEN log10(x) END", "sin": "sin(x)", "sinh": "(exp(x) - exp(-x)) / 2",
    "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END", "tan": "tan(x)", "tanh": "tanh(x)",
}
for _name, _sql in _UNARY.items():
    operator(f"math_{_name}", "scalar", lambda s, sql=_sql: sql, MATH)
for _name, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*")):
    operator(f"math_{_name}", "pair", lambda s, sign=_sign: f"x {sign} y", MATH)
operator("math_divide", "pair", lambda s: s.div("x", "y"), MATH)


def _m(name: str, reads: str, make, **params) -> None:
    operator(name, reads, make, MORE, **params)


_m("rolling_sum", "scalar", lambda s, period: s.sum("x", period), period=30)
_m("rolling_minimum", "scalar", lambda s, period: s.min("x", period), period=30)
_m("rolling_maximum", "scalar", lambda s, period: s.max("x", period), period=30)


def _index(s, period: int, f) -> str:
    """The row, from 0, of the window's extreme; the latest of equals."""
    best = f("x", period)
    return "CASE " + " ".join(f"WHEN {s.lag('x', k)} = {best} THEN {s.rn()} - {1 + k}" for k in range(period)) + " END"


_m("min_index", "scalar", lambda s, period: _index(s, period, s.min), period=30)
_m("max_index", "scalar", lambda s, period: _index(s, period, s.max), period=30)
_m("min_max", "scalar", lambda s, period: {"least": s.min("x", period), "most": s.max("x", period)}, period=30)
_m("min_max_index", "scalar", lambda s, period: {"min_index": _index(s, period, s.min), "max_index": _index(s, period, s.max)}, period=30)


def mean_deviation(s, period):
    mean = s.avg("x", period)
    return s.let(s.total(s.array("x", period), f"abs(e - {mean})") + f" / {period}")


_m("mean_deviation", "scalar", mean_deviation, period=14)
_m("relative_volume", "scalar", lambda s, period: s.div("x", s.avg("x", period)), period=20)
_m("efficiency_ratio", "scalar", lambda s, period: s.div(f"abs(x - {s.lag('x', period)})", s.sum(f"abs(x - {s.lag('x')})", period), "0e0"), period=10)
_m("positive_cmo", "scalar", lambda s, period: (lambda m: s.div(f"100 * {s.sum(m[0], period)}", f"({s.sum(m[0], period)} + {s.sum(m[1], period)})", "0e0"))(windows._moves(s)), period=14)
_m("wilder_sum", "scalar", lambda s, period: recursive.wilder_sum(s, "x", period), period=14)
_m("lag", "scalar", lambda s, period: s.lag("x", period), period=3)
_m("lags", "scalar", lambda s, period: {f"lag_{k}": s.lag("x", k) for k in range(1, period + 1)}, period=3)


def _factor(s, period):
    b, r = windows.beta(s, "x", "y", period), s.let(windows.correlation(s, "x", "y", period))
    return {"alpha": f"{s.avg('x', period)} - {b} * {s.avg('y', period)}", "beta": b, "r_squared": f"{r} * {r}"}


_m("single_factor_model", "pair", _factor, period=20)
_m("signal_noise_ratio", "candle", lambda s, period: s.div(f"abs(c - {s.lag('c', period)})", recursive.atr(s, period)), period=14)
_m("smoothed_obv", "candle", lambda s, period: s.avg(s.cum(s.let(f"coalesce(sign(c - {s.lag('c')}) * v, 0e0)")), period), period=10)
_m("sfx", "candle", lambda s, period: {"atr": recursive.atr(s, period), "std_dev": s.sd("c", period), "ma_std_dev": s.avg(s.sd("c", period), period)}, period=12)
_m("average_bar_range", "candle", lambda s, period: s.avg("h - l", period), period=14)
_m("smoothed_cmo", "scalar", lambda s, period: (lambda m: s.div(f"100 * ({s.rma(m[0], period)} - {s.rma(m[1], period)})", f"({s.rma(m[0], period)} + {s.rma(m[1], period)})", "0e0"))(windows._moves(s)), period=14)


def _slow(s, period):
    raw = s.let(s.div(f"100 * (c - {s.min('l', period)})", f"({s.max('h', period)} - {s.min('l', period)})", "0e0"))
    k = s.avg(raw, 3)
    d = s.avg(k, 3)
    return {"k": when(f"{d} IS NOT NULL", k), "d": d}


_m("slow_stochastic", "candle", _slow, period=5)
_m("sample_variance", "scalar", lambda s, period: s.roll("var_samp", "x", period), period=20)
_m("sample_std_dev", "scalar", lambda s, period: s.sds("x", period), period=20)
_m("sample_covariance", "pair", lambda s, period: s.roll2("covar_samp", "x", "y", period), period=20)
_m("scaled_median_deviation", "scalar", lambda s, period: f"1.4826e0 * {windows.mad(s, 'x', period)}", period=20)
_m("cumulative_sum", "scalar", lambda s: s.cum("x"))
_m("cumulative_return", "scalar", lambda s: (lambda f: s.div(f"100 * (x - {f})", f))(s.let(f"first_value(x) OVER {s.over()}")))
_m("internal_bar_strength", "candle", lambda s: s.div("c - l", "(h - l)"))
_m("close_location_value", "candle", lambda s: s.div("2 * c - h - l", "(h - l)"))
# The periods of the two groups of averages.
_m("guppy", "scalar", lambda s, periods: {f"ema_{n}": s.ema("x", n) for n in periods}, periods=(3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60))


def _kdj(s, period):
    """Two averages of weight a third, which start from 50."""
    rsv = s.let(s.div(f"100 * (c - {s.min('l', period)})", f"({s.max('h', period)} - {s.min('l', period)})", "50e0"))

    def third(x: str) -> str:
        first = s.let(f"{s.let(f'count({x}) OVER {s.over()}')} = 1")
        return s.decay(f"CASE WHEN {x} IS NULL THEN NULL WHEN {first} THEN {100 / 3!r} + {x} / 3 ELSE {x} / 3 END", 2 / 3)

    k = third(rsv)
    d = third(k)
    return {"k": k, "d": d, "j": f"3 * {k} - 2 * {d}"}


_m("kdj", "candle", _kdj, period=9)
_m("percentage_volume_oscillator", "candle", lambda s, fast, slow, signal: (lambda p: {"pvo": when(f"{s.ema(p, signal)} IS NOT NULL", p), "signal": s.ema(p, signal), "histogram": f"{p} - {s.ema(p, signal)}"})(s.let(s.div(f"100 * ({s.ema('v', fast)} - {s.ema('v', slow)})", s.ema("v", slow), "0e0"))), fast=12, slow=26, signal=9)


def _side(name: str, of: str, sign: int) -> None:
    """One side of a two-sided pattern."""
    base = OPERATORS[of]

    def make(s, **p):
        v = s.let(str(base.make(s, **(base.params | p))))
        return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} = {sign} THEN {float(sign)!r} ELSE 0e0 END"

    operator(name, "candle", make, "candlestick patterns")


for _name, _of, _sign in (("black_crows", "three_soldiers_or_crows", -1), ("white_soldiers", "three_soldiers_or_crows", 1), ("dark_cloud_cover", "piercing_dark_cloud", -1), ("piercing", "piercing_dark_cloud", 1), ("evening_star", "morning_evening_star", -1), ("morning_star", "morning_evening_star", 1)):
    _side(_name, _of, _sign)


def _both(name: str, a: str, b: str) -> None:
    one, two = OPERATORS[a], OPERATORS[b]
    operator(name, "candle", lambda s: f"{s.let(str(one.make(s, **one.params)))} + {s.let(str(two.make(s, **two.params)))}", "candlestick patterns")


_both("rise_fall_three_methods", "rising_three_methods", "falling_three_methods")
_both("side_gap_three_methods", "upside_gap_three_methods", "downside_gap_three_methods")


# --- variants
def _t(name: str, reads: str, make, **params) -> None:
    operator(f"ta_{name}", reads, make, TA, **params)


def _changes(s) -> str:
    """The true range from the second row on."""
    return s.let(when(f"{s.lag('c')} IS NOT NULL", true_range(s)))


_t("trange", "candle", lambda s: _changes(s))
_t("atr", "candle", lambda s, period: s.rma(_changes(s), period), period=14)
_t("natr", "candle", lambda s, period: s.div(f"100 * {s.rma(_changes(s), period)}", "c", "0e0"), period=14)
_t("adr", "candle", lambda s, period: s.avg("h - l", period), period=14)
_t("rsi", "scalar", lambda s, period: (lambda m: s.div(f"100 * {s.rma(m[0], period)}", f"({s.rma(m[0], period)} + {s.rma(m[1], period)})", "0e0"))(windows._moves(s)), period=14)
_t("obv", "candle", lambda s: s.cum(s.let(f"CASE WHEN {s.lag('c')} IS NULL THEN v ELSE sign(c - {s.lag('c')}) * v END")))
_t("avgdev", "scalar", mean_deviation, period=14)
_t("correl", "pair", lambda s, period: windows.correlation(s, "x", "y", period), period=30)
_t("beta", "pair", lambda s, period: windows.beta(s, s.let(f"y / {s.lag('y')} - 1"), s.let(f"x / {s.lag('x')} - 1"), period), period=5)
_t("stddev", "scalar", lambda s, period, factor: f"{factor} * {s.sd('x', period)}", period=5, factor=1.0)
_t("var", "scalar", lambda s, period: s.var("x", period), period=5)
_t("willr", "candle", lambda s, period: s.div(f"-100 * ({s.max('h', period)} - c)", f"({s.max('h', period)} - {s.min('l', period)})", "0e0"), period=14)


def _stoch(s, k, slow, d) -> dict:
    raw = s.let(s.div(f"100 * (c - {s.min('l', k)})", f"({s.max('h', k)} - {s.min('l', k)})", "0e0"))
    first = s.avg(raw, slow) if slow > 1 else raw
    second = s.avg(first, d)
    return {"k": when(f"{second} IS NOT NULL", first), "d": second}


_t("stoch", "candle", _stoch, k=5, slow=3, d=3)
_t("stochf", "candle", _stoch, k=5, slow=1, d=3)
_t("bbands", "scalar", lambda s, period, up, down: {"upper": f"{s.avg('x', period)} + {up} * {s.sd('x', period)}", "middle": s.avg("x", period), "lower": f"{s.avg('x', period)} - {down} * {s.sd('x', period)}"}, period=20, up=2.0, down=2.0)
_t("pvt", "candle", lambda s: s.cum(s.let(f"coalesce({s.div(f'v * (c - {s.lag(chr(99))})', s.lag('c'), '0e0')}, 0e0)")))
_t("rvol", "candle", lambda s, period: s.div("v", s.avg("v", period), "0e0"), period=20)
_t("fosc", "scalar", lambda s, period: s.div(f"100 * (x - {s.lag(windows._linreg_end(s, 'x', period, 1))})", "x", "0e0"), period=5)
_t("percentrank", "scalar", lambda s, period: s.ready(period, s.let(s.total(s.array("x", period), "CASE WHEN e < x THEN 1e0 ELSE 0e0 END")) + f" * {100 / (period - 1)!r}"), period=20)


def _late_ema(s, x: str, n: int, slow: int) -> str:
    """An average seeded by the last n values before the slow average's first row, so that both start together."""
    return s.ema(s.let(f"CASE WHEN {s.rn()} > {slow - n} THEN {x} END"), n)


_t("macd", "scalar", lambda s, fast, slow, signal: recursive.macd(s, _late_ema(s, "x", fast, slow), s.ema("x", slow), s.ema, signal), fast=12, slow=26, signal=9)
_t("macdext", "scalar", lambda s, fast, slow, signal: recursive.macd(s, s.avg("x", fast), s.avg("x", slow), s.avg, signal), fast=12, slow=26, signal=9)
_t("apo", "scalar", lambda s, fast, slow: f"{s.ema('x', fast)} - {s.ema('x', slow)}", fast=12, slow=26)


def _adosc(s, fast, slow):
    """Averages of the accumulation line that start at its first value."""
    line = s.cum(windows._MFV(s))
    return s.ready(slow, f"round({s.smooth(line, 2 / (fast + 1), 1)} - {s.smooth(line, 2 / (slow + 1), 1)}, 6)")  # a small difference of large sums


_t("adosc", "candle", _adosc, fast=3, slow=10)
_t("efi", "candle", lambda s, period: s.ema(f"(c - {s.lag('c')}) * v", period), period=13)
_t("smi", "candle", lambda s, period, fast, slow: (lambda d, r: s.div(f"200 * {d}", r, "0e0"))(*(s.ema(s.ema(x, slow), fast) for x in (f"c - ({s.max('h', period)} + {s.min('l', period)}) / 2", f"{s.max('h', period)} - {s.min('l', period)}"))), period=13, fast=2, slow=25)
_t("kc", "candle", lambda s, period, atr_period, width: recursive._about(s, s.ema(TP, period), s.let(f"{width} * {s.rma(_changes(s), atr_period)}")), period=20, atr_period=10, width=2.0)
_t("ao", "candle", lambda s, fast, slow: f"{s.avg(HL2, fast)} - {s.avg(HL2, slow)}", fast=5, slow=34)
_t("mom10", "scalar", lambda s, period: f"x - {s.lag('x', period)}", period=10)


# --- averages that start at the first value (profiles)
def first_seed(s, x: str, alpha: float) -> str:
    return s.smooth(x, alpha, 1)


_P = "seeded profiles"
for _n in (5, 8, 13, 21, 34, 55, 89, 144):
    operator(f"profile_ema_{_n}", "candle", lambda s, n=_n: s.ready(n, first_seed(s, "c", 2 / (n + 1))), _P)
for _n in (5, 10, 20, 50, 100, 200):
    operator(f"profile_sma_{_n}", "candle", lambda s, n=_n: s.avg("c", n), _P)


def _profile_rsi(s):
    up, down = windows._moves(s, "c")
    a, b = first_seed(s, up, 1 / 14), first_seed(s, down, 1 / 14)
    return s.ready(15, s.div(f"100 * {a}", f"({a} + {b})", "50e0"))


operator("profile_rsi_14", "candle", _profile_rsi, _P)
operator("profile_atr_14", "candle", lambda s: s.ready(15, first_seed(s, true_range(s), 1 / 14)), _P)
operator("profile_rma_14", "candle", lambda s: s.ready(14, first_seed(s, "c", 1 / 14)), _P)
operator("profile_wma_14", "candle", lambda s: windows.wma(s, "c", 14), _P)
operator("profile_roc_14", "candle", lambda s: s.div(f"c - {s.lag('c', 14)}", s.lag("c", 14)), _P)
operator("profile_momentum_14", "candle", lambda s: f"c - {s.lag('c', 14)}", _P)
operator("profile_vwma_14", "candle", lambda s: s.div(s.sum("c * v", 14), s.sum("v", 14)), _P)
operator("profile_williams_r_14", "candle", lambda s: s.div(f"-100 * ({s.max('h', 14)} - c)", f"({s.max('h', 14)} - {s.min('l', 14)})"), _P)
operator("profile_awesome", "candle", lambda s: f"{s.avg(HL2, 5)} - {s.avg(HL2, 34)}", _P)


def _two(s, n: int, depth: int) -> list[str]:
    out = [first_seed(s, "c", 2 / (n + 1))]
    while len(out) < depth:
        out.append(first_seed(s, out[-1], 2 / (n + 1)))
    return out


operator("profile_dema_14", "candle", lambda s: s.ready(27, "2 * {0} - {1}".format(*_two(s, 14, 2))), _P)
operator("profile_tema_14", "candle", lambda s: s.ready(40, "3 * {0} - 3 * {1} + {2}".format(*_two(s, 14, 3))), _P)

