"""Operators that need the window's values themselves: order statistics, ranks, histograms, paths."""

from __future__ import annotations

import math

from tapeworks.functions.prices import true_range
from tapeworks.functions.windows import clip0, log_return, when
from tapeworks.plans.columns import operator

STAT, RISK, BAND, VOL, MARKET = "price statistics", "risk and performance", "bands and channels", "volatility", "market profile"


def _bomar(s, period, coverage):
    mid = s.avg("x", period)
    dev = s.sorted(s.array("x", period), f"CASE WHEN {mid} = 0 THEN 0e0 ELSE abs((e - {mid}) / {mid}) END")
    width = f"abs({mid}) * {s.sorted_quantile(dev, coverage, period)}"
    return {"upper": f"{mid} + {width}", "middle": mid, "lower": f"{mid} - {width}"}


operator("bomar_bands", "scalar", _bomar, BAND, period=20, coverage=0.85)


def _cvar(s, period, confidence):
    k = max(1, math.floor(round((1 - confidence) * period, 9)))
    tail = s.sorted(s.array("x", period))
    return when(f"{tail} IS NOT NULL", clip0("-(" + " + ".join(s.item(tail, i) for i in range(k)) + f") / {k}"))


operator("conditional_value_at_risk", "scalar", _cvar, RISK, period=100, confidence=0.95)


def _k_ratio(s, period):
    """Slope of the summed returns by time over its standard error."""
    values = [s.lag("x", period - 1 - k) for k in range(period)]
    curve = [values[0]]
    for x in values[1:]:
        curve.append(s.let(f"{curve[-1]} + {x}"))
    mean = s.let("(" + " + ".join(curve) + f") / {period}")
    sxx = period * (period**2 - 1) / 12
    slope = s.let("(" + " + ".join(f"{k - (period - 1) / 2!r} * ({c} - {mean})" for k, c in enumerate(curve)) + f") / {sxx!r}")
    sse = s.let(" + ".join(f"pow({c} - {mean} - {slope} * {k - (period - 1) / 2!r}, 2)" for k, c in enumerate(curve)))
    return f"(CASE WHEN {sse} IS NULL THEN NULL WHEN {sse} <= 0 THEN 0e0 ELSE {slope} / sqrt(nullif({sse}, 0) / {(period - 2) * sxx!r}) END)"


operator("k_ratio", "scalar", _k_ratio, RISK, period=30)


def _average_drawdown(s, period):
    """The mean depth of the window's drawdowns: each runs from a peak until a value is at least as high again."""
    values = [s.lag("x", period - 1 - k) for k in range(period)]
    peak, low, total, count = values[0], values[0], "0e0", "0e0"
    for x in values[1:]:
        back = s.let(f"CASE WHEN {x} >= {peak} THEN 1 ELSE 0 END")
        depth = s.let(f"CASE WHEN {low} < {peak} AND {peak} > 0 THEN ({peak} - {low}) / {peak} ELSE 0e0 END")
        total = s.let(f"{total} + {back} * {depth}")
        count = s.let(f"{count} + CASE WHEN {back} = 1 AND {low} < {peak} AND {peak} > 0 THEN 1 ELSE 0 END")
        low = s.let(f"CASE WHEN {back} = 1 THEN {x} ELSE least({low}, {x}) END")
        peak = s.let(f"greatest({peak}, {x})")
    open_ = f"{low} < {peak} AND {peak} > 0"
    depth = f"CASE WHEN {open_} THEN ({peak} - {low}) / {peak} ELSE 0e0 END"
    n = s.let(f"{count} + CASE WHEN {open_} THEN 1 ELSE 0 END")
    return s.ready(period, f"(CASE WHEN {n} = 0 THEN 0e0 ELSE ({total} + {depth}) / nullif({n}, 0) END)")


operator("average_drawdown", "scalar", _average_drawdown, RISK, period=10)


def histogram(s, x: str, low: str, width: str, n: int, bins: int) -> list[str]:
    """Counts of the last n values in equal bins."""
    values = s.array(x, n)
    place = f"least(floor((e - {low}) / nullif({width}, 0)), {bins - 1})"
    return [s.let(s.total(values, f"CASE WHEN {place} = {k} THEN 1e0 ELSE 0e0 END")) for k in range(bins)]


def _entropy(s, period, bins):
    lo, hi = s.min("x", period), s.max("x", period)
    width = s.let(f"({hi} - {lo}) / {bins}")
    counts = histogram(s, "x", lo, width, period, bins)
    h = " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / {period}) * ln(greatest({c}, 1e-9) / {period}) / {math.log(2)!r} ELSE 0e0 END" for c in counts)
    return f"(CASE WHEN {hi} IS NULL THEN NULL WHEN {hi} <= {lo} THEN 0e0 ELSE {h} END)"


operator("shannon_entropy", "scalar", _entropy, STAT, period=32, bins=8)


def _spearman(s, period):
    """Pearson on average ranks: a value's rank counts the smaller and half of the equal ones."""
    rank = lambda x: [s.let(s.total(s.array(x, period), f"CASE WHEN e < {s.lag(x, k)} THEN 1e0 WHEN e = {s.lag(x, k)} THEN 0.5e0 ELSE 0e0 END")) for k in range(period)]
    rx, ry, mid = rank("x"), rank("y"), period / 2
    part = lambda a, b: s.let(" + ".join(f"({p} - {mid!r}) * ({q} - {mid!r})" for p, q in zip(a, b, strict=True)))
    return s.div(part(rx, ry), f"sqrt({part(rx, rx)} * {part(ry, ry)})", "0e0")


operator("spearman_correlation", "pair", _spearman, STAT, period=10)


def _kendall(s, period):
    both, tx, ty = [], [], []
    for i in range(period):
        for j in range(i + 1, period):
            a, b = (f"(1e0 * sign({s.lag(x, i)} - {s.lag(x, j)}))" for x in ("x", "y"))
            both.append(f"{a} * {b}")
            tx.append(f"abs({a})")
            ty.append(f"abs({b})")
    add = lambda terms: s.let("(" + " + ".join(terms) + ")")
    return s.div(add(both), f"sqrt({add(tx)} * {add(ty)})", "0e0")


operator("kendall_tau", "pair", _kendall, STAT, period=20)


def _cone(s, window, lookback):
    vol = s.sds(log_return(s, "c"), window)
    values = s.array(vol, lookback)
    rank = s.let(s.total(values, f"CASE WHEN e <= {vol} THEN 1e0 ELSE 0e0 END"))
    return {"current": when(f"{values} IS NOT NULL", vol), "least": s.min(vol, lookback), "median": s.quantile(vol, 0.5, lookback), "most": s.max(vol, lookback), "percentile": f"{rank} * {100 / lookback!r}"}


operator("volatility_cone", "candle", _cone, VOL, window=20, lookback=60)


def _rwi(s, period):
    tr = true_range(s)
    high, low = ["0e0"], ["0e0"]
    for k in range(2, period + 1):
        width = s.let(f"{s.avg(tr, k - 1)} * {math.sqrt(k)!r}")
        high.append(s.div(f"h - {s.lag('l', k - 1)}", width, "0e0"))
        low.append(s.div(f"{s.lag('h', k - 1)} - l", width, "0e0"))
    return {"high": s.ready(period, f"greatest({', '.join(high)})"), "low": s.ready(period, f"greatest({', '.join(low)})")}


operator("rwi", "candle", _rwi, "trend", period=14)


def _variance_ratio(s, period, q):
    d = s.let("x - y")
    r = s.let(f"{d} - {s.lag(d)}")
    n = period - 1
    mean, var = s.avg(r, n), s.var(r, n)
    steps = [s.let(" + ".join(s.lag(r, k + j) for j in range(q))) for k in range(n - q + 1)]
    total = s.let("(" + " + ".join(f"pow({x} - {q} * {mean}, 2)" for x in steps) + f") / {n - q + 1}")
    return s.ready(period, s.div(total, f"({q} * {var})", "1e0"))


operator("variance_ratio", "pair", _variance_ratio, STAT, period=60, q=2)


# --- market profile: a candle's volume spread evenly over the price bins of the window that it spans
def _profile(s, period: int, bins: int, touches: bool = False) -> tuple[str, str, list[str]]:
    """Lowest price, bin width, and what each bin holds: volume, or the number of candles that touch it."""
    lo, hi = s.min("l", period), s.max("h", period)
    width = s.let(f"({hi} - {lo}) / {bins}")
    place = lambda x: f"least(floor(({x} - {lo}) / nullif({width}, 0)), {bins - 1})"
    held = []
    for k in range(bins):
        terms = []
        for j in range(period):
            a, b = place(s.lag("l", j)), place(s.lag("h", j))
            terms.append(f"CASE WHEN {k} BETWEEN {a} AND {b} THEN {'1e0' if touches else f'{s.lag(chr(118), j)} / ({b} - {a} + 1)'} ELSE 0e0 END")
        held.append(s.let("(" + " + ".join(terms) + ")"))
    return lo, width, held


def _volume_profile(s, period, bin_count):
    lo, width, held = _profile(s, period, bin_count)
    return {"price_low": lo, "price_high": s.max("h", period)} | {f"bin_{k}": s.ready(period, x) for k, x in enumerate(held)}


operator("volume_profile", "candle", _volume_profile, MARKET, period=5, bin_count=10)


def _tpo(s, period, bin_count):
    lo, width, held = _profile(s, period, bin_count, touches=True)
    return {"price_low": lo, "price_high": s.max("h", period)} | {f"count_{k}": s.ready(period, x) for k, x in enumerate(held)}


operator("tpo_profile", "candle", _tpo, MARKET, period=5, bin_count=10)


def _prints(s, period, bins):
    _, _, held = _profile(s, period, bins, touches=True)
    return s.ready(period, " + ".join(f"CASE WHEN {x} = 1 THEN 1e0 ELSE 0e0 END" for x in held))


operator("single_prints", "candle", _prints, MARKET, period=10, bins=12)
