"""The same names as three public libraries compute them: talipp_*, pyta_* and ttr_*, with their seeds, gaps and flat cases.

talipp_* and ttr_* averages begin with the mean of the first values, pyta_* ones with the first value. A quotient by 0
is null. Averages pass over nulls between values; a window with a null in it is null.
"""

from __future__ import annotations

import math

from tapeworks.functions import recursive  # noqa: F401  fills OPERATORS
from tapeworks.functions.windows import TP, _linreg_end, wma
from tapeworks.plans.columns import OPERATORS, operator

FAMILY = "source variants"


def _add(sources: str, name: str, reads: str, make, **params) -> None:
    """make takes the builder, whether averages begin with the first value (pyta), and the parameters."""
    for source in sources.split():
        operator(f"{source}_{name}", reads, lambda s, first=source == "pyta", **p: make(s, first, **p), FAMILY, **params)


# --- shared parts
def first_ema(s, x, n: int, alpha: float | None = None) -> str:
    """From the first value on, shown as soon as there are n."""
    x = s.flat(x)
    return s.let(f"CASE WHEN count({x}) OVER {s.over()} >= {n} THEN {s.smooth(x, alpha or 2 / (n + 1), 1)} END")


def ema(s, x, n: int, first: bool) -> str:
    return first_ema(s, x, n) if first else s.ema(x, n)


def moved(s, x, k: int = 1) -> str:
    return s.let(f"{s.flat(x)} - {s.lag(x, k)}")


def rate(s, x, k: int, scale: float) -> str:
    return s.let(f"{scale!r} * ({s.div(s.flat(x), s.lag(x, k))} - 1)")


def growth(s, x, k: int = 1) -> str:
    return s.let(f"ln({s.div(s.flat(x), s.lag(x, k))})")


def true_range(s, first: bool) -> str:
    """The range widened to the close before; first: the plain range on the first row, else null."""
    before = s.lag("c")
    made = f"greatest(h, {before}) - least(l, {before})"
    return s.let(made if first else f"CASE WHEN {before} IS NOT NULL THEN {made} END")


def directions(s) -> tuple[str, str]:
    up, down = moved(s, "h"), s.let(f"{s.lag('l')} - l")
    one = lambda a, b: s.let(f"CASE WHEN {a} IS NULL THEN NULL WHEN {a} > {b} AND {a} > 0 THEN {a} ELSE 0e0 END")
    return one(up, down), one(down, up)


def rsi(s, x, n: int, first: bool, flat: str) -> str:
    d = moved(s, x)
    halves = [s.let(f"CASE WHEN {d} IS NULL THEN {'0e0' if first else 'NULL'} WHEN {sign}{d} > 0 THEN {sign}{d} ELSE 0e0 END") for sign in ("", "-")]
    up, down = (first_ema(s, y, n, 1 / n) if first else s.rma(y, n) for y in halves)
    return s.let(f"CASE WHEN {up} IS NULL THEN NULL WHEN {down} = 0 THEN CASE WHEN {up} = 0 THEN {flat} ELSE 100e0 END ELSE 100 - 100 / (1 + {up} / {down}) END")


def place(s, x, high, low, n: int, flat: str) -> str:
    """Per cent of the way from the window's least to its greatest; flat where these are equal."""
    x, top, bottom = s.flat(x), s.max(high, n), s.min(low, n)
    return s.let(f"CASE WHEN {top} = {bottom} THEN {flat} ELSE 100 * ({x} - {bottom}) / nullif({top} - {bottom}, 0e0) END")


def mean_deviation(s, x, n: int) -> str:
    values, mean = s.array(x, n), s.avg(x, n)
    return s.let(f"{s.total(values, f'abs(e - {mean})')} / {float(n)!r}")


def wilder_sum(s, x, n: int) -> str:
    """y = y * (n - 1) / n + x, from the sum of the first n - 1 values."""
    x = s.flat(x)
    k, start = s.let(f"count({x}) OVER {s.over()}"), s.let(f"sum({x}) OVER {s.over()}")
    y = s.decay(f"CASE WHEN {x} IS NULL OR {k} < {n - 1} THEN NULL WHEN {k} = {n - 1} THEN {start} ELSE {x} END", (n - 1) / n)
    return s.let(f"CASE WHEN {k} >= {n} THEN {y} END")


def unbroken(s, f: str, x, n: int) -> str:
    """An aggregate over n rows that stays null for good after the first null between values."""
    x = s.flat(x)
    start = s.let(f"min(CASE WHEN {x} IS NOT NULL THEN {s.rn()} END) OVER {s.over()}")
    return s.let(f"CASE WHEN count({x}) OVER {s.over()} = {s.rn()} - {start} + 1 THEN {s.roll(f, x, n)} END")


def _clv(flat: str) -> str:
    return f"(CASE WHEN h = l THEN {flat} ELSE (2 * c - h - l) / nullif(h - l, 0e0) END)"


def extreme_at(s, x: str, f: str, n: int, latest: bool) -> str:
    """Age in rows of the extreme of the last n + 1 rows, or as many as there are."""
    best = s.let(f"{f}({x}) OVER {s.over(n + 1)}")
    ages = range(n + 1) if latest else range(n, -1, -1)
    return s.let("CASE " + " ".join(f"WHEN {s.lag(x, k)} = {best} THEN {float(k)!r}" for k in ages) + " END")


def mid(s, n: int) -> str:
    return s.let(f"({s.max('h', n)} + {s.min('l', n)}) / 2")


def band(m: str, width: str) -> dict[str, str]:
    return {"lower": f"{m} - {width}", "middle": m, "upper": f"{m} + {width}"}


# --- direction and trend
def _adx(s, first, period):
    up, down = directions(s)
    tr = s.rma(true_range(s, not first), period)
    plus, minus = (s.let(f"CASE WHEN {a} IS NOT NULL THEN {s.div(f'100 * {a}', tr, '0e0')} END") for a in (s.rma(up, period), s.rma(down, period)))
    adx = s.rma(s.let(s.div(f"100 * abs({plus} - {minus})", f"({plus} + {minus})", "0e0")), period)
    if first:  # zeros instead of nulls before there are values
        i = s.rn()
        return {"adx": f"CASE WHEN {i} < {2 * period} THEN 0e0 ELSE {adx} END"} | {k: f"CASE WHEN {i} <= {period + 1} THEN 0e0 ELSE {x} END" for k, x in (("plus_di", plus), ("minus_di", minus))}
    return {"adx": adx, "plus_di": plus, "minus_di": minus}


_add("talipp pyta", "adx", "candle", _adx, period=5)


def _ttr_adx(s, _, period):
    tr = wilder_sum(s, true_range(s, False), period)
    plus, minus = (s.let(s.div(f"100 * {wilder_sum(s, x, period)}", tr)) for x in directions(s))
    dx = s.let(s.div(f"100 * abs({plus} - {minus})", f"({plus} + {minus})"))
    return {"plus_di": plus, "minus_di": minus, "dx": dx, "adx": s.rma(dx, period)}


_add("ttr", "adx", "candle", _ttr_adx, period=5)


def _pyta_aroon(s, _, period):
    return {k: s.ready(period + 1, f"({period} - {extreme_at(s, x, f, period, False)}) * {100 / period!r}") for k, x, f in (("up", "h", "max"), ("down", "l", "min"))}


def _ttr_aroon(s, _, period):
    up, down = (s.let(s.ready(period, f"({period} - {extreme_at(s, x, f, period, True)}) * {100 / period!r}")) for x, f in (("h", "max"), ("l", "min")))
    return {"up": up, "down": down, "oscillator": f"{up} - {down}"}


_add("pyta", "aroon", "candle", _pyta_aroon, period=5)
_add("ttr", "aroon", "candle", _ttr_aroon, period=5)


def _vortex(s, _, period):
    tr = s.sum(true_range(s, True), period)
    return {"plus": s.div(s.sum(f"abs(h - {s.lag('l')})", period), tr), "minus": s.div(s.sum(f"abs(l - {s.lag('h')})", period), tr)}


_add("talipp pyta", "vortex", "candle", _vortex, period=14)


def _ichimoku(s, first, tenkan_period, kijun_period, senkou_b_period, displacement):
    t, k = mid(s, tenkan_period), mid(s, kijun_period)
    a = s.let(f"({k} + {t}) / 2")
    if first:
        top, bottom = (s.let(f"{f}({x}) OVER {s.over(senkou_b_period)}") for f, x in (("max", "h"), ("min", "l")))
        return {"tenkan": t, "kijun": k, "senkou_a": a, "senkou_b": f"({top} + {bottom}) / 2"}
    return {"tenkan": t, "kijun": k, "chikou": s.ready(displacement, "c"), "senkou_a": s.lag(a, displacement), "senkou_b": s.lag(mid(s, senkou_b_period), displacement + 1)}


_add("talipp pyta", "ichimoku", "candle", _ichimoku, tenkan_period=9, kijun_period=26, senkou_b_period=52, displacement=26)


def _mass(s, first, ema_period, sum_period):
    a = ema(s, "h - l", ema_period, first)
    return s.sum(s.let(s.div(a, ema(s, a, ema_period, first))), sum_period)


_add("talipp pyta", "mass_index", "candle", _mass, ema_period=9, sum_period=25)
_add("ttr", "vhf", "scalar", lambda s, _, period: s.div(f"{s.max('x', period)} - {s.min('x', period)}", s.sum(s.let(f"abs({moved(s, 'x')})"), period)), period=28)
_add("ttr", "snr", "candle", lambda s, _, period: s.div(f"abs({moved(s, 'c', period)})", s.rma(true_range(s, False), period)), period=5)


def _tdi(s, _, period):
    m = s.let(f"coalesce({moved(s, 'x', period)}, 0e0)")
    size, di = s.let(f"abs({m})"), s.sum(m, period)
    return {"tdi": f"abs({di}) - {s.sum(size, 2 * period)} + {s.sum(size, period)}", "di": di}


_add("ttr", "tdi", "scalar", _tdi, period=5)


def _cti(s, _, period):
    """Correlation of average ranks with time."""
    values, centre = s.array("x", period), (period - 1) / 2
    ranks = [s.let(f"{s.total(values, f'CASE WHEN e < {s.lag("x", k)} THEN 1e0 WHEN e = {s.lag("x", k)} THEN 0.5e0 ELSE 0e0 END')} - {period / 2!r}") for k in range(period)]
    both = " + ".join(f"{centre - k!r} * {r}" for k, r in enumerate(ranks))
    own = " + ".join(f"{r} * {r}" for r in ranks)
    return s.div(both, f"sqrt(({own}) * {period * (period**2 - 1) / 12!r})")


_add("ttr", "cti", "scalar", _cti, period=20)


# --- averages
_add("pyta", "ema", "scalar", lambda s, _, period: first_ema(s, "x", period), period=3)


def _hma(s, _, period):
    root = math.isqrt(period)
    return wma(s, s.let(s.ready(period + root - 1, f"2 * {wma(s, 'x', period // 2)} - {wma(s, 'x', period)}")), root)


_add("talipp", "hma", "scalar", _hma, period=9)
_add("talipp ttr", "vwma", "candle", lambda s, _, period: s.div(s.sum("c * v", period), s.sum("v", period)), period=5)
_add("ttr", "vwap", "candle", lambda s, _, period: s.div(s.sum("c * v", period), s.sum("v", period)), period=10)


def _alma(s, _, period, offset, sigma):
    centre, spread = math.floor(offset * (period - 1)), period / sigma
    raw = [math.exp(-((k - centre) ** 2) / (2 * spread**2)) for k in range(period)]
    return s.weighted("x", [w / sum(raw) for w in raw])


_add("ttr", "alma", "scalar", _alma, period=9, offset=0.85, sigma=6.0)


def _zlema(s, _, period):
    alpha, behind = 2 / (period + 1), (period + 1) / 2
    k, part = math.ceil(behind), behind % 1
    ahead = s.let(f"{alpha!r} * (2 * x - ({1 - part!r} * {s.lag('x', k)} + {part!r} * {s.lag('x', k - 1)}))")
    return s.decay(f"CASE WHEN {s.rn()} < {period} THEN NULL WHEN {s.rn()} = {period} THEN {s.avg('x', period)} ELSE {ahead} END", 1 - alpha)


_add("ttr", "zlema", "scalar", _zlema, period=10)
_add("ttr", "gmma", "scalar", lambda s, _: {f"{group}_{n}": s.ema("x", n) for group, periods in (("short", (3, 5, 8, 10, 12, 15)), ("long", (30, 35, 40, 45, 50, 60))) for n in periods})
_add("ttr", "wilder_sum", "scalar", lambda s, _, period: wilder_sum(s, "x", period), period=5)


# --- bands and channels
_add("talipp pyta", "bollinger", "scalar", lambda s, _, period, multiplier: band(s.avg("x", period), f"{multiplier!r} * {s.sd('x', period)}"), period=5, multiplier=2.0)


def _ttr_bollinger(s, _, period, multiplier):
    m, d = s.avg("x", period), s.let(f"{multiplier!r} * {s.sd('x', period)}")
    return band(m, d) | {"pct_b": s.div(f"x - ({m} - {d})", f"(2 * {d})")}


_add("ttr", "bollinger", "scalar", _ttr_bollinger, period=5, multiplier=2.0)


def _pbands(s, _, period):
    m = s.avg("x", period)
    return band(m, f"2 * {s.sd(s.let(f'{m} - {s.avg("x", 2)}'), period)}")


_add("ttr", "price_bands", "scalar", _pbands, period=5)
_add("pyta", "donchian", "candle", lambda s, _, period: {"lower": s.min("l", period), "middle": mid(s, period), "upper": s.max("h", period)}, period=5)
_add("ttr", "donchian", "candle", lambda s, _, period: {"high": s.max("h", period), "mid": mid(s, period), "low": s.min("l", period)}, period=5)


def _keltner(s, first, ema_period, atr_period, multiplier):
    if first:
        some = lambda x: s.let(f"avg({x}) OVER {s.over(ema_period)}")
        return {"lower": some("(4 * l - 2 * h + c) / 3"), "middle": s.avg(TP, ema_period), "upper": some("(4 * h - 2 * l + c) / 3")}
    return band(s.ema("c", ema_period), f"{multiplier!r} * {s.rma(true_range(s, True), atr_period)}")


_add("talipp pyta", "keltner", "candle", _keltner, ema_period=5, atr_period=5, multiplier=2.0)
_add("ttr", "keltner", "candle", lambda s, _, ema_period, multiplier: band(s.ema(TP, ema_period), f"{multiplier!r} * {s.rma(true_range(s, False), ema_period)}"), ema_period=5, multiplier=2.0)


def _ttm(s, _, period, bb_mult, kc_mult):
    m = s.avg("c", period)
    momentum = _linreg_end(s, s.let(f"c - ({m} + {mid(s, period)}) / 2"), period)
    spread, width, centre = s.let(f"{bb_mult!r} * {s.sd('c', period)}"), s.let(f"{kc_mult!r} * {s.rma(true_range(s, True), period)}"), s.ema("c", period)
    return {"squeeze": s.ready(period, f"CASE WHEN {m} + {spread} < {centre} + {width} AND {m} - {spread} > {centre} - {width} THEN 1e0 ELSE 0e0 END"), "momentum": momentum}


_add("talipp", "ttm_squeeze", "candle", _ttm, period=20, bb_mult=2.0, kc_mult=1.5)


def _chande_kroll(s, _, atr_period, atr_multiplier, stop_period):
    made = OPERATORS["chande_kroll_stop"].make(s, atr_period=atr_period, multiplier=atr_multiplier, stop_period=stop_period)
    return {"long_stop": made["stop_long"], "short_stop": made["stop_short"]}


_add("talipp", "chande_kroll_stop", "candle", _chande_kroll, atr_period=10, atr_multiplier=1.0, stop_period=9)


# --- oscillators
_add("talipp pyta", "rsi", "scalar", lambda s, first, period: rsi(s, "x", period, first, "100e0"), period=3)
_add("ttr", "rsi", "scalar", lambda s, _, period: rsi(s, "x", period, False, "NULL"), period=3)
_add("talipp pyta ttr", "cci", "candle", lambda s, _, period: s.div(f"({TP} - {s.avg(TP, period)})", f"(0.015e0 * {mean_deviation(s, TP, period)})"), period=5)


def _macd(s, first, fast, slow, signal):
    line = s.let(f"{ema(s, 'x', fast, first)} - {ema(s, 'x', slow, first)}")
    mean = ema(s, line, signal, first)
    return {"macd": line, "signal": mean, "histogram": f"{line} - {mean}"}


def _percentage(s, fast, slow, first) -> str:
    a, b = ema(s, "x", fast, first), ema(s, "x", slow, first)
    return s.let(s.div(f"100 * ({a} - {b})", b))


_add("talipp pyta", "macd", "scalar", _macd, fast=3, slow=6, signal=3)
_add("pyta", "ppo", "scalar", lambda s, first, fast, slow: _percentage(s, fast, slow, first), fast=12, slow=26)
_add("pyta", "pvo", "scalar", lambda s, first, fast, slow: _percentage(s, fast, slow, first), fast=12, slow=26)
_add("ttr", "macd", "scalar", lambda s, first, fast, slow, signal: (lambda line: {"macd": line, "signal": s.ema(line, signal)})(_percentage(s, fast, slow, False)), fast=3, slow=6, signal=3)


def _thrice(s, period, first) -> str:
    x = "x"
    for _ in range(3):
        x = ema(s, x, period, first)
    return x


_add("talipp", "trix", "scalar", lambda s, first, period: rate(s, _thrice(s, period, first), 1, 10000.0), period=3)
_add("pyta", "trix", "scalar", lambda s, first, period: rate(s, _thrice(s, period, first), 1, 100.0), period=3)
_add("ttr", "trix", "scalar", lambda s, first, period: (lambda t: {"trix": t, "signal": s.ema(t, 9)})(rate(s, _thrice(s, period, first), 1, 100.0)), period=3)


def _tsi(s, first, long, short):
    d = moved(s, "x")
    a, b = (ema(s, ema(s, y, long, first), short, first) for y in (d, s.let(f"abs({d})")))
    return s.div(f"100 * {a}", b)


_add("talipp pyta", "tsi", "scalar", _tsi, long=25, short=13)


def _stoch(s, first, k_period, d_period):
    k = place(s, "c", "h", "l", k_period, "NULL" if first else "100e0")
    return {"k": k, "d": s.avg(k, d_period)}


def _ttr_stoch(s, _, k_period, d_period):
    k = s.let(f"{place(s, 'c', 'h', 'l', k_period, 'NULL')} / 100")
    d = unbroken(s, "avg", k, d_period)
    return {"k": k, "d": d, "slow_d": unbroken(s, "avg", d, 3)}


_add("talipp pyta", "stoch", "candle", _stoch, k_period=5, d_period=3)
_add("ttr", "stoch", "candle", _ttr_stoch, k_period=5, d_period=3)


def _stoch_rsi(s, first, rsi_period, stoch_period):
    r = rsi(s, "x", rsi_period, first, "100e0")
    raw = place(s, r, r, r, stoch_period, "NULL" if first else "100e0")
    if first:
        return f"{raw} / 100"
    k = s.avg(raw, 3)
    return {"k": k, "d": s.avg(k, 3)}


_add("talipp pyta", "stoch_rsi", "scalar", _stoch_rsi, rsi_period=14, stoch_period=14)


def _stc(s, first, fast, slow, schaff_period):
    flat, n = "NULL" if first else "100e0", schaff_period
    smooth = lambda x: first_ema(s, x, 3) if first else s.avg(x, 3)
    line = s.let(f"{ema(s, 'x', fast, first)} - {ema(s, 'x', slow, first)}")
    a = smooth(place(s, line, line, line, n, flat))
    if first:
        return smooth(place(s, a, a, a, n, flat))
    # The second place is told among the values there are, from the row on where a full one of first places begins.
    top, bottom = (s.let(f"{f}({a}) OVER {s.over(n)}") for f in ("max", "min"))
    return smooth(s.let(s.ready(slow + 2 * (n - 1), f"CASE WHEN {top} = {bottom} THEN {flat} ELSE 100 * ({a} - {bottom}) / nullif({top} - {bottom}, 0e0) END")))


_add("talipp pyta", "stc", "scalar", _stc, fast=23, slow=50, schaff_period=10)


def _smi(s, _, period, d_period, d2_period):
    top, bottom = s.let(f"coalesce({s.max('h', period)}, h)"), s.let(f"coalesce({s.min('l', period)}, l)")
    a, b = (s.ema(s.ema(y, d_period), d2_period) for y in (s.let(f"c - ({top} + {bottom}) / 2"), s.let(f"{top} - {bottom}")))
    smi = s.let(s.div(f"200 * {a}", b))
    return {"smi": smi, "signal": s.ema(smi, 9)}


_add("ttr", "smi", "candle", _smi, period=5, d_period=3, d2_period=3)
_add("talipp pyta", "williams_r", "candle", lambda s, _, period: s.div(f"-100 * ({s.max('h', period)} - c)", f"({s.max('h', period)} - {s.min('l', period)})"), period=5)
_add("ttr", "wpr", "candle", lambda s, _, period: s.div(f"{s.max('h', period)} - c", f"({s.max('h', period)} - {s.min('l', period)})", "0.5e0"), period=5)


def _ultimate(s, _, short, mid, long):
    pressure = s.let(f"CASE WHEN {s.lag('c')} IS NOT NULL THEN c - least(l, {s.lag('c')}) END")
    tr = true_range(s, False)
    return " + ".join(f"{w * 100 / 7!r} * {s.div(s.sum(pressure, n), s.sum(tr, n))}" for w, n in ((4, short), (2, mid), (1, long)))


_add("talipp pyta ttr", "ultimate_oscillator", "candle", _ultimate, short=7, mid=14, long=28)
_add("talipp", "bop", "candle", lambda s, _: s.div("c - o", "(h - l)"))


def _cmo(s, _, period):
    d = moved(s, "x")
    rises, all_ = s.sum(s.let(f"CASE WHEN {d} IS NULL THEN NULL WHEN {d} > 0 THEN {d} ELSE 0e0 END"), period), s.sum(s.let(f"abs({d})"), period)
    return s.div(f"100 * (2 * {rises} - {all_})", all_)


_add("ttr", "cmo", "scalar", _cmo, period=14)
_add("ttr", "dpo", "scalar", lambda s, _, period: f"{s.lag('x', period // 2 + 1)} - {s.avg('x', period)}", period=20)
_add("ttr", "roc", "scalar", lambda s, _, period: growth(s, "x", period), period=3)
_add("pyta", "daily_log_return", "scalar", lambda s, _: f"100 * {growth(s, 'x')}")

_KST = {"roc1": 10, "roc2": 15, "roc3": 20, "roc4": 30, "sma1": 10, "sma2": 10, "sma3": 10, "sma4": 15, "signal": 9}


def _kst_lines(p: dict) -> list[tuple[int, int, int]]:
    return [(j, p[f"roc{j}"], p[f"sma{j}"]) for j in range(1, 5)]


def _kst(of, scale: str):
    def make(s, _, signal, **p):
        line = s.let(" + ".join(f"{scale}{j} * {s.avg(of(s, k), n)}" for j, k, n in _kst_lines(p)))
        return {"kst": line, "signal": s.avg(line, signal)}

    return make


def _pyta_kst(s, _, signal, **p):
    """Rates that have no former value yet are taken of the mean so far, also in the lines of the rows before.

    So a line is a / mean + b, a and b being sums that don't change any more.
    """
    i, mean = s.rn(), s.let(f"avg(x) OVER {s.over()}")
    a = s.let(" + ".join(f"{j} * {s.avg(f'CASE WHEN {i} <= {k} THEN 100 * x ELSE 0e0 END', n)}" for j, k, n in _kst_lines(p)))
    b = s.let(" + ".join(f"{j} * {s.avg(s.let(f'CASE WHEN {i} <= {k} THEN -100e0 ELSE {rate(s, "x", k, 100.0)} END'), n)}" for j, k, n in _kst_lines(p)))
    mean_a, mean_b = (s.let(f"avg({y}) OVER {s.over(signal)}") for y in (a, b))
    return {"kst": f"{s.div(a, mean)} + {b}", "signal": f"{s.div(mean_a, mean)} + {mean_b}"}


_add("talipp", "kst", "scalar", _kst(lambda s, k: rate(s, "x", k, 100.0), ""), **_KST)
_add("pyta", "kst", "scalar", _pyta_kst, **_KST)
_add("ttr", "kst", "scalar", _kst(lambda s, k: growth(s, "x", k), "100 * "), **_KST)


def _dvi(s, _):
    r = s.let(f"{s.div('x', s.avg('x', 3))} - 1")
    size = s.avg(s.let(f"({s.avg(r, 5)} + {s.avg(r, 100)} / 10) / 2"), 5)
    step = s.let(f"CASE WHEN {s.lag('x')} IS NULL THEN NULL WHEN x > {s.lag('x')} THEN 1e0 ELSE -1e0 END")
    stretch = s.avg(s.let(f"({s.sum(step, 10)} + {s.sum(step, 100)} / 10) / 2"), 2)
    rank = lambda y: s.let(f"{s.total(s.array(y, 252), f'CASE WHEN e < {y} OR abs(e - {y}) < 1e-8 THEN 1e0 ELSE 0e0 END')} / 252e0")
    m, t = rank(size), rank(stretch)
    return {"dvi_mag": m, "dvi_str": t, "dvi": f"0.8e0 * {m} + 0.2e0 * {t}"}


_add("ttr", "dvi", "scalar", _dvi)


# --- volatility
_add("pyta", "atr", "candle", lambda s, _, period: f"CASE WHEN {s.rn()} < {period} THEN 0e0 ELSE {s.rma(true_range(s, True), period)} END", period=5)


def _true(s, _):
    before = s.lag("c")
    seen = lambda x: f"CASE WHEN {before} IS NOT NULL THEN {x} END"
    return {"tr": true_range(s, False), "true_high": seen(f"greatest(h, {before})"), "true_low": seen(f"least(l, {before})")}


_add("ttr", "tr", "candle", _true)
_add("ttr", "atr", "candle", lambda s, _, period: _true(s, _) | {"atr": s.rma(true_range(s, False), period)}, period=5)


def _choppiness(s, _, period):
    ratio = s.let(s.div(s.sum(true_range(s, True), period), f"({s.max('h', period)} - {s.min('l', period)})"))
    return f"CASE WHEN {ratio} > 0 THEN {100 / math.log10(period)!r} * log10({ratio}) END"


_add("talipp", "chop", "candle", _choppiness, period=14)


def _rogers_satchell(s, _, period):
    v = s.avg("ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)", period)
    return f"CASE WHEN {v} > 0 THEN sqrt({v}) END"


_add("talipp", "rogers_satchell", "candle", _rogers_satchell, period=20)
_add("talipp", "sfx", "candle", lambda s, _, period: {"atr": s.rma(true_range(s, True), period), "stddev": s.sd("c", period), "smoothed_stddev": s.avg(s.sd("c", period), period)}, period=5)
_add("pyta", "ulcer_index", "scalar", lambda s, _, period: (lambda top: f"sqrt({s.avg(s.let(f'pow(100 * {s.div(f"(x - {top})", top)}, 2)'), period)})")(s.let(f"max(x) OVER {s.over(period)}")), period=14)
_add("ttr", "volatility", "scalar", lambda s, _, period, trading_periods: f"{s.sds(growth(s, 'x'), period - 1)} * {math.sqrt(trading_periods)!r}", period=20, trading_periods=252)
_add("ttr", "chaikin_volatility", "candle", lambda s, _, ema_period: rate(s, s.ema("h - l", ema_period), ema_period, 1.0), ema_period=10)


# --- volume
def _line(s) -> str:
    """Accumulation and distribution; null where a bar has no range."""
    total = s.cum(f"{_clv('0e0')} * v")
    return s.let(f"CASE WHEN h <> l THEN {total} END")


_add("talipp", "accu_dist", "candle", lambda s, _: _line(s))
_add("talipp", "chaikin_osc", "candle", lambda s, _, fast, slow: f"{s.ema(_line(s), fast)} - {s.ema(_line(s), slow)}", fast=3, slow=10)
_add("pyta", "chaikin_money_flow", "candle", lambda s, _, period: s.div(s.sum(f"{_clv('0e0')} * v", period), s.sum("v", period)), period=20)
_add("ttr", "cmf", "candle", lambda s, _, period: s.div(unbroken(s, "sum", f"{_clv('NULL')} * v", period), s.sum("v", period)), period=20)
_add("ttr", "clv", "candle", lambda s, _: _clv("0e0"))


def _flow_of_bars(s, scale: float) -> str:
    """Move of the middle times range over volume."""
    return s.let(s.div(f"{scale!r} * {moved(s, '(h + l) / 2')} * (h - l)", "v"))


_add("pyta", "ease_of_movement", "candle", lambda s, _, period: s.avg(_flow_of_bars(s, 1e8), period), period=14)
_add("ttr", "emv", "candle", lambda s, _, period: (lambda e: {"emv": e, "ma_emv": s.avg(e, period)})(_flow_of_bars(s, 1e4)), period=14)
_add("pyta", "force_index", "candle", lambda s, _, period: first_ema(s, s.let(f"{moved(s, 'c')} * v"), period), period=13)


def _mfi(s, _, period):
    typical = s.let(TP)
    before = s.lag(typical)
    up, down = (s.sum(s.let(f"CASE WHEN {typical} {sign} {before} THEN {typical} * v ELSE 0e0 END"), period) for sign in "><")
    return f"CASE WHEN {down} = 0 THEN CASE WHEN {up} > 0 THEN 100e0 END ELSE 100 - 100 / (1 + {up} / nullif({down}, 0e0)) END"


_add("pyta", "mfi", "candle", _mfi, period=5)
_add("pyta", "obv", "candle", lambda s, _: s.cum(s.let(f"CASE WHEN c < {s.lag('c')} THEN -v ELSE v END")))
_add("talipp", "sobv", "candle", lambda s, _, period: s.avg(s.cum(s.let(f"CASE WHEN {s.lag('c')} IS NULL OR c > {s.lag('c')} THEN v WHEN c < {s.lag('c')} THEN -v ELSE 0e0 END")), period), period=5)
_add("pyta", "vpt", "candle", lambda s, _: s.cum(s.let(f"{rate(s, 'c', 1, 1.0)} * v")))


def _kvo(s, _, fast, slow):
    """The range adds up while the typical price keeps its direction; a turn begins with the range before."""
    total = s.let("h + l + c")
    side = s.let(f"CASE WHEN {s.rn()} < 3 THEN NULL WHEN {total} > {s.lag(total)} THEN 1e0 ELSE -1e0 END")
    turn = s.let(f"CASE WHEN {side} IS NULL THEN 0 WHEN {s.lag(side)} = {side} THEN 0 ELSE 1 END")
    run = s.cum(turn)
    span = s.cum(f"h - l + CASE WHEN {turn} = 1 THEN {s.lag('h - l')} ELSE 0e0 END", keys=f"series, {run}")
    force = s.let(f"CASE WHEN {side} IS NULL THEN NULL WHEN {span} = 0 THEN 0e0 ELSE v * abs(2 * ((h - l) / nullif({span}, 0e0) - 1)) * {side} * 100 END")
    return f"{s.ema(force, fast)} - {s.ema(force, slow)}"


_add("talipp", "kvo", "candle", _kvo, fast=34, slow=55)


# --- statistics
def _deviations(s, period) -> tuple[str, str, str]:
    return s.roll2("covar_samp", "x", "y", period), s.roll("var_samp", "x", period), s.roll("var_samp", "y", period)


def _cor(s, _, period):
    both, a, b = _deviations(s, period)
    return s.div(both, f"sqrt({a} * {b})")


def _sfm(s, _, period):
    both, a, b = _deviations(s, period)
    beta = s.let(s.div(both, b))
    return {"alpha": f"{s.avg('x', period)} - {beta} * {s.avg('y', period)}", "beta": beta, "r_squared": s.div(f"{beta} * {beta} * {b}", a)}


_add("ttr", "run_cor", "pair", _cor, period=10)
_add("ttr", "roll_sfm", "pair", _sfm, period=5)
_add("ttr", "run_percent_rank", "scalar", lambda s, _, period: f"({OPERATORS['rolling_percentile_rank'].make(s, period=period)}) / 100", period=20)
_add("ttr", "run_range", "scalar", lambda s, _, period: {"min": s.min("x", period), "max": s.max("x", period)}, period=5)
_add("ttr", "lags", "scalar", lambda s, _, period: {"v1": s.ready(period + 1, "x")} | {f"v1_{k}": s.ready(period + 1, s.lag("x", k)) for k in range(1, period + 1)}, period=5)
_add("talipp", "fibonacci_retracement", "scalar", lambda s, _: "x * 1.618e0")
