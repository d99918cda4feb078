"""Candlestick and DeMark patterns over a few bars, as conditions on lagged columns.

In a condition a name ends in the age of its bar: o0 h0 l0 c0 are the current bar's prices, c2 the close two bars
ago. body is close minus open, size its absolute value, rng the range, top and bot the ends of the body, up and
dn the shadows, mid the middle of the body.
"""

from __future__ import annotations

import re

from tapeworks.plans.columns import operator

_PARTS = {
    "body": "({c} - {o})", "size": "abs({c} - {o})", "rng": "({h} - {l})", "top": "greatest({o}, {c})", "bot": "least({o}, {c})",
    "up": "({h} - greatest({o}, {c}))", "dn": "(least({o}, {c}) - {l})", "mid": "(({o} + {c}) / 2)", "white": "({c} > {o})", "black": "({c} < {o})",
}
_TOKEN = re.compile(r"\b(o|h|l|c|" + "|".join(_PARTS) + r")(\d)\b")


def expand(s, text: str) -> str:
    def bar(x: str, age: str) -> str:
        return s.lag(x, int(age))

    def put(m: re.Match) -> str:
        return bar(m[1], m[2]) if m[1] in "ohlc" else _PARTS[m[1]].format(**{x: bar(x, m[2]) for x in "ohlc"})

    return _TOKEN.sub(put, text)


def pattern(name: str, bars: int, bull: str = "", bear: str = "", family: str = "candlestick patterns", need: str = "", **params) -> None:
    """1 where bull holds, -1 where bear does (bull first), else 0; need must hold for either. Null before there are that many bars."""

    def make(s, **p):
        fill = lambda t: f"({t.format(**p)})" if t else ""
        cases = [(" AND ".join(filter(None, (fill(need), fill(c)))), v) for c, v in ((bull, "1e0"), (bear, "-1e0")) if c]
        chosen = " ".join(f"WHEN {expand(s, c)} THEN {v}" for c, v in cases)
        return f"(CASE WHEN {s.lag('c', bars - 1)} IS NULL THEN NULL {chosen} ELSE 0e0 END)"

    operator(name, "candle", make, family, **params)


# one bar
pattern("belt_hold", 1, "body0 > 0 AND o0 - l0 <= {tolerance} * rng0", "body0 < 0 AND h0 - o0 <= {tolerance} * rng0", need="rng0 > 0 AND size0 >= 0.5 * rng0", tolerance=0.05)
pattern("closing_marubozu", 1, "body0 > 0 AND h0 - c0 <= 0.05 * rng0", "body0 < 0 AND c0 - l0 <= 0.05 * rng0", need="rng0 > 0 AND size0 >= 0.7 * rng0")
pattern("opening_marubozu", 1, "body0 > 0 AND o0 - l0 <= 0.05 * rng0", "body0 < 0 AND h0 - o0 <= 0.05 * rng0", need="rng0 > 0 AND size0 >= 0.7 * rng0")
pattern("marubozu", 1, "body0 > 0", "body0 < 0", need="rng0 > 0 AND up0 <= {tolerance} * rng0 AND dn0 <= {tolerance} * rng0", tolerance=0.05)
pattern("doji", 1, "rng0 > 0 AND size0 <= {threshold} * rng0", threshold=0.1)
_DOJI0 = "rng0 > 0 AND size0 <= 0.1 * rng0"
pattern("dragonfly_doji", 1, f"{_DOJI0} AND up0 <= 0.1 * rng0 AND dn0 >= 0.5 * rng0")
pattern("gravestone_doji", 1, bear=f"{_DOJI0} AND dn0 <= 0.1 * rng0 AND up0 >= 0.5 * rng0")
pattern("long_legged_doji", 1, f"{_DOJI0} AND up0 >= 0.3 * rng0 AND dn0 >= 0.3 * rng0")
pattern("rickshaw_man", 1, f"{_DOJI0} AND up0 >= 0.3 * rng0 AND dn0 >= 0.3 * rng0 AND mid0 - l0 BETWEEN 0.4 * rng0 AND 0.6 * rng0")
pattern("takuri", 1, f"{_DOJI0} AND up0 <= 0.05 * rng0 AND dn0 >= 0.7 * rng0")
pattern("high_wave", 1, "rng0 > 0 AND up0 >= 0.4 * rng0 AND dn0 >= 0.4 * rng0")
_SHORT0 = "rng0 > 0 AND size0 > 0"
pattern("hammer", 1, f"{_SHORT0} AND dn0 >= 2 * size0 AND up0 <= size0")
pattern("hanging_man", 1, bear=f"{_SHORT0} AND dn0 >= 2 * size0 AND up0 <= size0")
pattern("inverted_hammer", 1, f"{_SHORT0} AND up0 >= 2 * size0 AND dn0 <= size0")
pattern("shooting_star", 1, bear=f"{_SHORT0} AND up0 >= 2 * size0 AND dn0 <= size0")
pattern("spinning_top", 1, "body0 > 0", "body0 < 0", need="rng0 > 0 AND size0 > 0 AND size0 <= {threshold} * rng0 AND up0 >= 2 * size0 AND dn0 >= 2 * size0", threshold=0.3)

# two bars
pattern("engulfing", 2, "black1 AND white0 AND o0 <= c1 AND c0 >= o1", "white1 AND black0 AND o0 >= c1 AND c0 <= o1", need="size1 > 0 AND size0 > size1")
pattern("harami", 2, "black1 AND white0 AND o0 >= c1 AND c0 <= o1", "white1 AND black0 AND o0 <= c1 AND c0 >= o1", need="size0 > 0 AND size0 < size1")
pattern("harami_cross", 2, "black1", "NOT black1", need=f"NOT (rng1 > 0 AND size1 <= 0.1 * rng1) AND {_DOJI0} AND bot0 >= bot1 AND top0 <= top1")
pattern("counterattack", 2, "body1 < 0 AND body0 > 0", "body1 > 0 AND body0 < 0", need="size1 >= 0.5 * rng1 AND size0 >= 0.5 * rng0 AND abs(c0 - c1) <= {tolerance} * 0.5 * (rng1 + rng0)", tolerance=0.05)
pattern("doji_star", 2, "body1 < 0 AND top0 < c1", "body1 > 0 AND bot0 > c1", need="rng1 > 0 AND rng0 > 0 AND size1 >= 0.5 * rng1 AND size0 <= 0.1 * rng0")
pattern("homing_pigeon", 2, "black1 AND black0 AND o0 <= o1 AND c0 >= c1 AND size0 < size1")
_LONG_BLACK1 = "rng1 > 0 AND black1 AND size1 >= 0.5 * rng1"
pattern("in_neck", 2, bear=f"{_LONG_BLACK1} AND white0 AND o0 < l1 AND c0 >= c1 AND c0 <= c1 + 0.1 * size1")
pattern("on_neck", 2, bear=f"{_LONG_BLACK1} AND white0 AND o0 < l1 AND abs(c0 - l1) <= 0.05 * rng1")
pattern("thrusting", 2, bear=f"{_LONG_BLACK1} AND white0 AND o0 < l1 AND c0 > c1 + 0.1 * size1 AND c0 < mid1")
_FULL = "rng1 > 0 AND size1 >= 0.95 * rng1 AND rng0 > 0 AND size0 >= 0.95 * rng0"
pattern("kicking", 2, "black1 AND white0 AND l0 > h1", "white1 AND black0 AND h0 < l1", need=_FULL)
_KICK = "((body1 < 0 AND body0 > 0 AND l0 > h1) OR (body1 > 0 AND body0 < 0 AND h0 < l1))"
pattern("kicking_by_length", 2, "CASE WHEN size1 >= size0 THEN body1 > 0 ELSE body0 > 0 END", "TRUE", need=f"{_FULL} AND {_KICK}")
pattern("matching_low", 2, "black1 AND black0 AND abs(c0 - c1) <= 0.025 * (rng1 + rng0)")
pattern("piercing_dark_cloud", 2, "black1 AND white0 AND o0 < l1 AND c0 > mid1 AND c0 < o1", "white1 AND black0 AND o0 > h1 AND c0 < mid1 AND c0 > o1")
pattern("separating_lines", 2, "black1 AND body0 > 0 AND o0 - l0 <= 0.05 * rng0", "white1 AND body0 < 0 AND h0 - o0 <= 0.05 * rng0", need="rng1 > 0 AND rng0 > 0 AND abs(o0 - o1) <= 0.05 * rng1 AND size0 >= 0.5 * rng0")
pattern("tweezer", 2, "abs(l0 - l1) <= {tolerance} * greatest(abs(l1), abs(l0))", "abs(h0 - h1) <= {tolerance} * greatest(abs(h1), abs(h0))", tolerance=0.001)

# three bars
_ABANDONED = "size1 <= {tolerance} * greatest(abs(o1), abs(c1))"
pattern("abandoned_baby", 3, "black2 AND h1 < l2 AND white0 AND l0 > h1", "white2 AND l1 > h2 AND black0 AND h0 < l1", need=_ABANDONED, tolerance=0.001)
pattern("advance_block", 3, bear="white2 AND white1 AND white0 AND c1 > c2 AND c0 > c1 AND o1 BETWEEN o2 AND c2 AND o0 BETWEEN o1 AND c1 AND body1 < body2 AND body0 < body1 AND h0 - c0 >= h1 - c1 AND h0 - c0 > 0")
pattern("downside_gap_three_methods", 3, bear="black2 AND black1 AND o1 < c2 AND white0 AND o0 > c1 AND o0 < o1 AND c0 > c2 AND c0 < o2")
pattern("upside_gap_three_methods", 3, "white2 AND white1 AND o1 > c2 AND black0 AND o0 > o1 AND o0 < c1 AND c0 > o2 AND c0 < c2")
_STAR = "rng2 > 0 AND rng1 > 0 AND size1 <= 0.1 * rng1"
pattern("evening_doji_star", 3, bear=f"{_STAR} AND body2 >= 0.5 * rng2 AND bot1 > c2 AND black0 AND top0 < bot1 AND c0 < c2 - {{penetration}} * body2", penetration=0.3)
pattern("morning_doji_star", 3, f"{_STAR} AND -body2 >= 0.5 * rng2 AND top1 < c2 AND white0 AND bot0 > top1 AND c0 > c2 - {{penetration}} * body2", penetration=0.3)
pattern("morning_evening_star", 3, "black2 AND white0 AND c0 > mid2", "white2 AND black0 AND c0 < mid2", need="size2 > 0 AND size0 > 0 AND size2 >= 2 * size1 AND size0 >= 2 * size1")
pattern("gap_side_by_side_white", 3, "bot1 > top2", "top1 < bot2", need="rng1 > 0 AND white1 AND white0 AND abs(o0 - o1) <= 0.1 * rng1 AND body1 <= 2 * body0 AND body0 <= 2 * body1")
_INSIDE = "h1 < h2 AND l1 > l2"
pattern("hikkake", 3, "h0 < h1 AND l0 < l1", "h0 > h1 AND l0 > l1", need=_INSIDE)
pattern("hikkake_modified", 3, "h0 < h1 AND l0 < l1 AND c0 > l1", "h0 > h1 AND l0 > l1 AND c0 < h1", need=_INSIDE)
pattern("identical_three_crows", 3, bear="black2 AND black1 AND black0 AND c1 < c2 AND c0 < c1 AND abs(o1 - c2) <= {tolerance} * greatest(abs(o1), abs(c2)) AND abs(o0 - c1) <= {tolerance} * greatest(abs(o0), abs(c1))", tolerance=0.001)
pattern("stalled_pattern", 3, bear="rng2 > 0 AND rng1 > 0 AND rng0 > 0 AND white2 AND white1 AND white0 AND c0 > c1 AND c1 > c2 AND body2 >= 0.5 * rng2 AND body1 >= 0.5 * rng1 AND body0 <= 0.3 * rng0 AND o0 >= c1 - 0.1 * rng1")
pattern("stick_sandwich", 3, "black2 AND white1 AND black0 AND l1 > c2 AND abs(c0 - c2) <= 0.1 * rng2")
pattern("tasuki_gap", 3, "white2 AND white1 AND o1 > c2 AND black0 AND o0 > o1 AND o0 < c1 AND c0 < o1 AND c0 > c2", "black2 AND black1 AND o1 < c2 AND white0 AND o0 < o1 AND o0 > c1 AND c0 > o1 AND c0 < c2")
pattern("three_inside", 3, "black2 AND white1 AND o1 >= c2 AND c1 <= o2 AND white0 AND c0 > o2", "white2 AND black1 AND o1 <= c2 AND c1 >= o2 AND black0 AND c0 < o2", need="size1 > 0 AND size1 < size2")
pattern("three_outside", 3, "black2 AND white1 AND o1 <= c2 AND c1 >= o2 AND white0 AND c0 > c1", "white2 AND black1 AND o1 >= c2 AND c1 <= o2 AND black0 AND c0 < c1", need="size2 > 0 AND size1 > size2")
pattern("three_soldiers_or_crows", 3, "white2 AND white1 AND white0 AND c1 > c2 AND c0 > c1 AND o1 BETWEEN o2 AND c2 AND o0 BETWEEN o1 AND c1", "black2 AND black1 AND black0 AND c1 < c2 AND c0 < c1 AND o1 BETWEEN c2 AND o2 AND o0 BETWEEN c1 AND o1")
pattern("three_stars_in_south", 3, "black2 AND black1 AND black0 AND c2 - l2 >= size2 AND o1 BETWEEN c2 AND o2 AND l1 > l2 AND c1 > c2 AND size1 < size2 AND h0 - o0 <= {tolerance} * greatest(abs(h0), abs(l0)) AND c0 - l0 <= {tolerance} * greatest(abs(h0), abs(l0)) AND h0 < h1 AND l0 > l1", tolerance=0.001)
_TALL = "CASE WHEN rng{0} > 0 THEN size{0} >= {1} * rng{0} ELSE 0 >= {1} END"
pattern("tower_top_bottom", 3, "NOT white2 AND white0", "white2 AND NOT white0", need="(rng1 <= 0 OR size1 <= 0.3 * rng1) AND rng2 > 0 AND size2 >= 0.5 * rng2 AND rng0 > 0 AND size0 >= 0.5 * rng0")
pattern("tristar", 3, "mid1 < mid2 AND mid1 < mid0", "mid1 > mid2 AND mid1 > mid0", need=" AND ".join(f"rng{k} > 0 AND size{k} <= 0.1 * rng{k}" for k in range(3)))
pattern("two_crows", 3, bear="white2 AND black1 AND c1 > c2 AND black0 AND o0 < o1 AND o0 > c1 AND c0 > o2 AND c0 < c2")
pattern("upside_gap_two_crows", 3, bear="white2 AND black1 AND c1 > c2 AND black0 AND o0 > o1 AND c0 < c1 AND c0 > c2")
pattern("unique_three_river", 3, "black2 AND size2 >= 0.5 * rng2 AND black1 AND o1 <= o2 AND c1 >= c2 AND l1 < l2 AND white0 AND body0 <= 0.3 * rng0 AND h0 <= c1")

# four and five bars
pattern("concealing_baby_swallow", 4, " AND ".join(f"rng{k} > 0 AND black{k} AND up{k} <= 0.05 * rng{k} AND dn{k} <= 0.05 * rng{k}" for k in (3, 2)) + " AND black1 AND o1 < c2 AND h1 > c2 AND black0 AND o0 > h1 AND c0 < l1")
pattern("three_line_strike", 4, "white3 AND white2 AND white1 AND o2 BETWEEN o3 AND c3 AND c2 > c3 AND o1 BETWEEN o2 AND c2 AND c1 > c2 AND black0 AND o0 > c1 AND c0 < o3", "black3 AND black2 AND black1 AND o2 BETWEEN c3 AND o3 AND c2 < c3 AND o1 BETWEEN c2 AND o2 AND c1 < c2 AND white0 AND o0 < c1 AND c0 > o3")
pattern("breakaway", 5, "black4 AND black3 AND o3 < c4 AND h2 < h3 AND l2 < l3 AND black1 AND h1 < h2 AND l1 < l2 AND white0 AND c0 > o3 AND c0 < c4", "white4 AND white3 AND o3 > c4 AND h2 > h3 AND l2 > l3 AND white1 AND h1 > h2 AND l1 > l2 AND black0 AND c0 < o3 AND c0 > c4")
_HELD = " AND ".join(f"size{k} < size4 AND h{k} <= h4 AND l{k} >= l4" for k in (3, 2, 1))
pattern("falling_three_methods", 5, bear=f"rng4 > 0 AND -body4 >= 0.5 * rng4 AND {_HELD} AND black0 AND c0 < c4")
pattern("rising_three_methods", 5, f"rng4 > 0 AND body4 >= 0.5 * rng4 AND {_HELD} AND white0 AND c0 > c4")
pattern("ladder_bottom", 5, "black4 AND black3 AND black2 AND o3 < o4 AND c3 < c4 AND o2 < o3 AND c2 < c3 AND black1 AND h1 > o1 AND white0 AND o0 > o1")
pattern("mat_hold", 5, "rng4 > 0 AND body4 >= 0.5 * rng4 AND size3 <= 0.5 * body4 AND size2 <= 0.5 * body4 AND size1 <= 0.5 * body4 AND bot3 > c4 AND least(l3, l2, l1) > c4 - {penetration} * body4 AND white0 AND c0 > greatest(h4, h3, h2, h1)", penetration=0.5)

# DeMark
_D = "demark"
pattern("td_camouflage", 2, "c0 < c1 AND white0 AND l0 < l1", "c0 > c1 AND black0 AND h0 > h1", _D)
pattern("td_clop", 2, "o0 < bot1 AND c0 > top1", "o0 > top1 AND c0 < bot1", _D)
pattern("td_clopwin", 2, "c0 >= o0", "c0 < o0", _D, need="bot0 >= bot1 AND top0 <= top1")
pattern("td_differential", 2, "c0 < c1 AND c0 - l0 > c1 - l1 AND h0 - c0 < h1 - c1", "c0 > c1 AND h0 - c0 > h1 - c1 AND c0 - l0 < c1 - l1", _D)
pattern("td_open", 2, "o0 < l1 AND h0 > l1", "o0 > h1 AND l0 < h1", _D)
pattern("td_propulsion", 2, "o0 >= c1 AND c0 > h1", "o0 <= c1 AND c0 < l1", _D)
pattern("td_trap", 3, "c0 > h1", "c0 < l1", _D, need=_INSIDE)
_X = "(CASE WHEN c < o THEN h + 2 * l + c WHEN c > o THEN 2 * h + l + c ELSE h + l + 2 * c END) / 2"
operator("td_range_projection", "candle", lambda s: {"high": f"{_X} - l", "low": f"{_X} - h"}, _D)


def streak(s, sign: str, reset: str) -> str:
    """How many rows in a row sign (an expression of -1, 0, 1) has been as it is now."""
    value = s.let(sign)
    changed = s.held(s.let(f"CASE WHEN {reset.format(now=value, before=s.lag(value))} THEN {s.rn()} END"))
    return s.let(f"{s.rn()} - {changed} + 1")


def _setup(s, lookback, target):
    p = s.lag("c", lookback)
    sign = s.let(f"sign({p} - c)")
    n = streak(s, sign, "{now} IS NULL OR {before} IS NULL OR {now} <> {before}")
    return f"{sign} * least({n}, {target})"


operator("td_setup", "candle", _setup, _D, lookback=4, target=9)


def _new_lines(s, count):
    sign = s.let(f"sign(c - {s.lag('c')})")
    n = streak(s, sign, "{now} IS NULL OR {before} IS NULL OR {now} <> {before}")
    return f"(CASE WHEN {sign} IS NULL THEN NULL WHEN {sign} <> 0 AND {n} >= {count} THEN -{sign} ELSE 0e0 END)"


operator("new_price_lines", "candle", _new_lines, "candlestick patterns", count=8)


def _line(s, period, sign):
    mean = s.roll("avg", "h - l", period, 1)
    return f"(CASE WHEN {mean} IS NULL THEN NULL WHEN h - l {sign} {mean} AND abs(c - o) >= 0.5 * (h - l) THEN CASE WHEN c > o THEN 1e0 ELSE -1e0 END ELSE 0e0 END)"


operator("long_line", "candle", lambda s, period: _line(s, period, ">"), "candlestick patterns", period=5)
operator("short_line", "candle", lambda s, period: _line(s, period, "<"), "candlestick patterns", period=5)


def _pan(s, period, top: bool):
    """Whether the extreme close of the window (the first of equals) lies in its middle half, and is left again."""
    best = s.max("c", period) if top else s.min("c", period)
    lo, hi = period // 4, period - period // 4
    place = s.let("CASE " + " ".join(f"WHEN {s.lag('c', period - 1 - k)} = {best} THEN {k}" for k in range(period)) + " END")
    first = s.lag("c", period - 1)
    left = f"c < {first} AND c < {best}" if top else f"c > {first} AND c > {best}"
    return f"(CASE WHEN {best} IS NULL THEN NULL WHEN {place} >= {lo} AND {place} < {hi} AND {left} THEN {'-1e0' if top else '1e0'} ELSE 0e0 END)"


operator("dumpling_top", "candle", lambda s, period: _pan(s, period, True), "candlestick patterns", period=9)
operator("fry_pan_bottom", "candle", lambda s, period: _pan(s, period, False), "candlestick patterns", period=9)
