"""Methods whose windows are filled with the first value before the series begins, and the default profiles made of them.

A window sees its first value as often as rows are missing. So a sum is the sum of distances to the first value, plus
the first value times the length, and a spread is that of the distances; nothing is null at the start. Recursive
averages start at the first value. Profiles are null for their first 255 rows.
"""

from __future__ import annotations

import math

from tapeworks.functions.extras import first_seed
from tapeworks.plans.columns import operator

_M, _P = "prefilled methods", "default profiles"
#: Rows from which the profiles below give values.
READY = 256


def first(s, x) -> str:
    return s.let(f"first_value({s.flat(x)}) OVER {s.over()}")


def past(s, x, k: int) -> str:
    """The value k rows ago, the first one where there are fewer."""
    return s.let(f"coalesce({s.lag(x, k)}, {first(s, x)})") if k else s.flat(x)


def distance(s, x) -> str:
    return s.let(f"{s.flat(x)} - {first(s, x)}")


def window(s, f: str, x, n: int) -> str:
    """An aggregate over the last n rows, or as many as there are."""
    return s.let(f"{f}({s.flat(x)}) OVER {s.over(n)}")


def total(s, x, n: int) -> str:
    return s.let(f"{window(s, 'sum', distance(s, x), n)} + {n} * {first(s, x)}")


def mean(s, x, n: int) -> str:
    return s.let(f"{window(s, 'sum', distance(s, x), n)} / {float(n)!r} + {first(s, x)}")


def deviation(s, x, n: int) -> str:
    """Sample standard deviation."""
    d = distance(s, x)
    a, b = window(s, "sum", d, n), window(s, "sum", f"{d} * {d}", n)
    return s.let(f"sqrt(greatest(({b} - {a} * {a} / {float(n)!r}) / {float(n - 1)!r}, 0e0))")


def weighted(s, x, weights: list[float]) -> str:
    """Mean by weights, the last on the current row."""
    d, n = distance(s, x), len(weights)
    terms = " + ".join(f"{w!r} * coalesce({s.lag(d, n - 1 - k)}, 0e0)" for k, w in enumerate(weights))
    return s.let(f"({terms}) / {float(sum(weights))!r} + {first(s, x)}")


def wma(s, x, n: int) -> str:
    return weighted(s, x, [float(k) for k in range(1, n + 1)])


def hma(s, x, n: int) -> str:
    return wma(s, s.let(f"2 * {wma(s, x, n // 2)} - {wma(s, x, n)}"), int(math.sqrt(n)))


def symmetric(n: int) -> list[float]:
    """1, 2, ... to the middle and down again."""
    return [float(min(k, n + 1 - k)) for k in range(1, n + 1)]


def ema(s, x, n: int) -> str:
    return first_seed(s, x, 2 / (n + 1))


def elements(s, x, n: int, centre: str) -> str:
    """Mean distance of the prefilled window's values from a centre; both as distances to the first value."""
    values = s.let(f"{'collect_list' if s.spark else 'list'}({distance(s, x)}) OVER {s.over(n)}")
    missing = s.let(f"greatest({float(n)!r} - {s.rn()}, 0e0)")
    return s.let(f"({s.total(values, f'abs(e - {centre})')} + {missing} * abs({centre})) / {float(n)!r}")


def mean_deviation(s, x, n: int) -> str:
    return elements(s, x, n, s.let(f"{window(s, 'sum', distance(s, x), n)} / {float(n)!r}"))


def median(s, x, n: int) -> str:
    """Of the prefilled window, as a distance to the first value."""
    values = ", ".join(f"coalesce({s.lag(distance(s, x), k)}, 0e0)" for k in range(n))
    ordered = s.let(f"sort_array(array({values}))" if s.spark else f"list_sort([{values}])")
    return s.let(s.item(ordered, n // 2) if n % 2 else f"({s.item(ordered, n // 2 - 1)} + {s.item(ordered, n // 2)}) / 2e0")


def since(s, x, n: int, f: str) -> str:
    """Rows since the latest greatest (f max) or least value of the last n."""
    extreme = window(s, f, x, n)
    cases = " ".join(f"WHEN {s.lag(x, k)} = {extreme} THEN {float(k)!r}" for k in range(n))
    return s.let(f"CASE {cases} END")


def cross(s, a: str, b: str) -> dict[str, str]:
    d = s.let(f"{a} - {b}")
    before = s.lag(d)
    return {"above": f"(CASE WHEN {before} < 0 AND {d} >= 0 THEN 1e0 ELSE 0e0 END)", "under": f"(CASE WHEN {before} > 0 AND {d} <= 0 THEN 1e0 ELSE 0e0 END)"}


def reversal(s, x, left: int, right: int, sign: int) -> str:
    """1 where the value right rows ago is the extreme of the rows to its left and right, the latest of equal ones."""
    v = s.let(f"{sign} * {s.flat(x)}")
    at = s.lag(v, right)
    older, newer = s.lag(window(s, "max", v, left + 1), right), window(s, "max", v, right)
    return s.let(f"CASE WHEN {at} >= {older} AND {at} > {newer} THEN 1e0 ELSE 0e0 END")


def _m(name: str, make, reads: str = "scalar", **params) -> None:
    operator(f"native_{name}", reads, make, _M, **params)


_CLV = "(CASE WHEN h = l THEN 0e0 ELSE ((c - l) - (h - c)) / (h - l) END)"
_m("adi", lambda s, period: total(s, f"{_CLV} * v", period) if period else s.cum(f"{_CLV} * v"), "candle", period=14)
_m("adi_unbounded", lambda s: s.cum(f"{_CLV} * v"), "candle")
_m("cci", lambda s, period: s.div(f"x - {mean(s, 'x', period)}", mean_deviation(s, "x", period), "0e0"), period=18)
_m("conv", lambda s, weights: weighted(s, "x", list(weights)), weights=(1.0, 2.0, 0.5, 3.0))
_m("cross", lambda s: "{above} - {under}".format(**cross(s, "x", "y")), "pair")
_m("cross_above", lambda s: cross(s, "x", "y")["above"], "pair")
_m("cross_under", lambda s: cross(s, "x", "y")["under"], "pair")
_m("derivative", lambda s, period: f"(x - {past(s, 'x', period)}) / {float(period)!r}", period=5)
_m("ema", lambda s, period: ema(s, "x", period), period=10)
_m("dma", lambda s, period: ema(s, ema(s, "x", period), period), period=10)
_m("tma", lambda s, period: ema(s, ema(s, ema(s, "x", period), period), period), period=10)
_m("highest_lowest_delta", lambda s, period: f"{window(s, 'max', 'x', period)} - {window(s, 'min', 'x', period)}", period=10)
_m("highest", lambda s, period: window(s, "max", "x", period), period=10)
_m("lowest", lambda s, period: window(s, "min", "x", period), period=10)
_m("highest_index", lambda s, period: since(s, "x", period, "max"), period=10)
_m("lowest_index", lambda s, period: since(s, "x", period, "min"), period=10)
_m("hma", lambda s, period: hma(s, "x", period), period=9)
_m("integral", lambda s, period: total(s, "x", period), period=10)
_m("integral_unbounded", lambda s: s.cum("x"))
_m("lin_reg", lambda s, period: f"3 * {wma(s, 'x', period)} - 2 * {mean(s, 'x', period)}", period=10)
_m("mean_abs_dev", lambda s, period: mean_deviation(s, "x", period), period=10)
_m("median_abs_dev", lambda s, period: elements(s, "x", period, median(s, "x", period)), period=9)
_m("momentum", lambda s, period: f"x - {past(s, 'x', period)}", period=5)
_m("past", lambda s, period: past(s, "x", period), period=5)
_m("rate_of_change", lambda s, period: s.div(f"x - {past(s, 'x', period)}", past(s, "x", period)), period=5)
_m("upper_reversal", lambda s, left, right: reversal(s, "x", left, right, 1), left=3, right=2)
_m("lower_reversal", lambda s, left, right: reversal(s, "x", left, right, -1), left=3, right=2)
_m("reversal", lambda s, left, right: f"{reversal(s, 'x', left, right, -1)} - {reversal(s, 'x', left, right, 1)}", left=3, right=2)
_m("rma", lambda s, period: first_seed(s, "x", 1 / period), period=10)
_m("sma", lambda s, period: mean(s, "x", period), period=10)
_m("smm", lambda s, period: f"{median(s, 'x', period)} + {first(s, 'x')}", period=9)
_m("st_dev", lambda s, period: deviation(s, "x", period), period=10)
_m("swma", lambda s, period: weighted(s, "x", symmetric(period)), period=9)
_m("trima", lambda s, period: mean(s, mean(s, "x", period), period), period=10)


def _tsi(s, short, long):
    move = s.let(f"coalesce(x - {s.lag('x')}, 0e0)")
    twice = lambda u: s.decay(f"{2 / (short + 1)!r} * {s.decay(f'{2 / (long + 1)!r} * {s.flat(u)}', 1 - 2 / (long + 1))}", 1 - 2 / (short + 1))
    return s.div(twice(move), twice(s.let(f"abs({move})")), "0e0")


_m("tsi", _tsi, short=13, long=25)
_m("linear_volatility", lambda s, period: window(s, "sum", s.let(f"coalesce(abs(x - {s.lag('x')}), 0e0)"), period), period=10)
_m("vwma", lambda s, period: s.div(total(s, "c * v", period), total(s, "v", period)), "candle", period=10)
_m("wma", lambda s, period: wma(s, "x", period), period=10)
_m("wsma", lambda s, period: ema(s, "x", 2 * period - 1), period=10)


# --- the default profiles
def _p(name: str, make) -> None:
    """make gives an expression or a dict of them; all are null before the READY-th row."""

    def ready(s):
        made = make(s)
        return {k: s.ready(READY, x) for k, x in (made if isinstance(made, dict) else {"value": made}).items()}

    operator(f"profile_{name}", "candle", ready, _P)


def _macd(s):
    line = s.let(f"{ema(s, 'c', 12)} - {ema(s, 'c', 26)}")
    return {"macd": line, "signal": ema(s, line, 9)}


def _bollinger(s):
    m, d = mean(s, "c", 20), deviation(s, "c", 20)
    return {"upper": f"{m} + 2 * {d}", "middle": m, "lower": f"{m} - 2 * {d}"}


def _true_range(s) -> str:
    before = s.let(f"coalesce({s.lag('c')}, c)")
    return s.let(f"greatest(h, {before}) - least(l, {before})")


def _adx(s):
    rma = lambda x: first_seed(s, x, 1 / 14)
    du, dd = s.let(f"h - {past(s, 'h', 1)}"), s.let(f"{past(s, 'l', 1)} - l")
    tr = s.let(rma(_true_range(s)))
    plus, minus = (s.let(s.div(rma(s.let(f"CASE WHEN {a} > {b} AND {a} > 0 THEN {a} ELSE 0e0 END")), tr, "0e0")) for a, b in ((du, dd), (dd, du)))
    return {"adx": rma(s.let(s.div(f"abs({plus} - {minus})", f"({plus} + {minus})", "0e0"))), "plus_di": plus, "minus_di": minus}


def _stochastic(s):
    top, bottom = window(s, "max", "h", 14), window(s, "min", "l", 14)
    k = mean(s, s.let(s.div(f"c - {bottom}", f"({top} - {bottom})", "0.5e0")), 14)
    return {"k": k, "d": mean(s, k, 3)}


def _donchian(s):
    top, bottom = window(s, "max", "h", 20), window(s, "min", "l", 20)
    return {"lower": bottom, "middle": f"({top} + {bottom}) / 2e0", "upper": top}


def _ichimoku(s):
    mid = lambda n: s.let(f"({window(s, 'max', 'h', n)} + {window(s, 'min', 'l', n)}) * 0.5e0")
    a, b = mid(9), mid(26)
    return {"tenkan": a, "kijun": b, "senkou_a": s.lag(s.let(f"({a} + {b}) * 0.5e0"), 26), "senkou_b": s.lag(mid(52), 26)}


def _keltner(s):
    m, width = ema(s, "c", 20), mean(s, _true_range(s), 20)
    return {"source": "c", "upper": f"{m} + {width}", "lower": f"{m} - {width}"}


def _mfi(s):
    typical = s.let("(h + l + c) / 3e0")
    before = s.lag(typical)
    up, down = (window(s, "sum", s.let(f"CASE WHEN {typical} {sign} {before} THEN {typical} * v ELSE 0e0 END"), 14) for sign in "><")
    ratio = s.let(s.div(up, down, "1e0"))
    return {"upper_threshold": "0.8e0", "mfi": f"1 - 1 / (1 + {ratio})", "lower_threshold": "0.2e0"}


def _trix(s):
    smooth = s.let(ema(s, ema(s, ema(s, "c", 18), 18), 18))
    value = s.let(f"coalesce({smooth} - {s.lag(smooth)}, 0e0)")
    return {"trix": value, "signal": ema(s, value, 6)}


def _cmo(s):
    move = s.let(f"coalesce(c - {s.lag('c')}, 0e0)")
    return s.div(window(s, "sum", move, 9), window(s, "sum", s.let(f"abs({move})"), 9), "0e0")


def _chaikin(s):
    """Averages of the cumulative line, started at zero; by the line's distance to each, which needs no long sum."""
    gap = lambda n: s.let(s.decay(f"{(n - 1) / (n + 1)!r} * {_CLV} * v", (n - 1) / (n + 1)))
    return s.let(f"{gap(10)} - {gap(3)}")


_p("macd_default", _macd)
_p("bollinger_default", _bollinger)
_p("adx_default", _adx)
_p("cci_default", lambda s: s.div(f"(c - {mean(s, 'c', 18)}) / 1.5e0", mean_deviation(s, "c", 18), "0e0"))
_p("stochastic_default", _stochastic)
_p("donchian_default", _donchian)
_p("aroon_default", lambda s: {"up": f"(14 - {since(s, 'h', 15, 'max')}) / 14e0", "down": f"(14 - {since(s, 'l', 15, 'min')}) / 14e0"})
_p("cmf_default", lambda s: s.div(window(s, "sum", f"{_CLV} * v", 20), window(s, "sum", "v", 20), "0e0"))
_p("hma_default", lambda s: hma(s, "c", 9))
_p("ichimoku_default", _ichimoku)
_p("keltner_default", _keltner)
_p("mfi_default", _mfi)
_p("trix_default", _trix)
_p("cmo_default", _cmo)
_p("chaikin_default", _chaikin)
_p("efi_default", lambda s: ema(s, s.let(f"(c - {past(s, 'c', 1)}) * v"), 13))
