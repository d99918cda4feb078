"""Candlestick functions by rolling averages, on the scale of 100.

A candle is long, short, a doji, near and so on in comparison with the average of the candles before it. In a
condition a name ends in the age of its candle, as in patterns; besides, long1 is what the body of the last candle is
compared with to be long, and so on (SETTINGS). white is close >= open, black the rest, col 1 or -1.
"""

from __future__ import annotations

import re

from tapeworks.plans.columns import operator

# By name, what is averaged, over how many candles before (0: the candle itself), and the factor.
SETTINGS = {
    "long": ("size", 10, 1.0), "short": ("size", 10, 1.0), "doji": ("rng", 10, 0.1), "shlong": ("size", 0, 1.0), "shvlong": ("size", 0, 2.0),
    "shshort": ("shadows", 10, 0.5), "tiny": ("rng", 10, 0.1), "near": ("rng", 5, 0.2), "far": ("rng", 5, 0.6), "equal": ("rng", 5, 0.05),
}
_PARTS = {
    "size": "abs({c} - {o})", "rng": "({h} - {l})", "top": "greatest({o}, {c})", "bot": "least({o}, {c})", "up": "({h} - greatest({o}, {c}))", "dn": "(least({o}, {c}) - {l})",
    "shadows": "({h} - {l} - abs({c} - {o}))", "white": "({c} >= {o})", "black": "({c} < {o})", "col": "(CASE WHEN {c} >= {o} THEN 1e0 ELSE -1e0 END)",
}
_TOKEN = re.compile(r"\b(" + "|".join([*SETTINGS, *_PARTS, "o", "h", "l", "c"]) + r")(\d)\b")


def expand(s, text: str) -> str:
    def part(name: str, age: int) -> str:
        return _PARTS[name].format(**{x: s.lag(x, age) for x in "ohlc"})

    def put(m: re.Match) -> str:
        name, age = m[1], int(m[2])
        if name in SETTINGS:
            what, n, factor = SETTINGS[name]
            return f"({s.lag(s.avg(part(what, 0), n), age + 1)} * {factor!r})" if n else f"({part(what, age)} * {factor!r})"
        return part(name, age) if name in _PARTS else s.lag(name, age)

    return _TOKEN.sub(put, text)


def lookback(texts: list[str], bars: int) -> int:
    """Rows before the first result."""
    used = [SETTINGS[m[1]][1] for t in texts for m in _TOKEN.finditer(t) if m[1] in SETTINGS]
    return max(used, default=0) + bars - 1


def candle(name: str, bars: int, need: str, bull: str = "", bear: str = "", value: str = "", **params) -> None:
    """need must hold; then 100 where bull holds, -100 where bear does, or value (an expression, times 100). Else 0."""

    def make(s, **p):
        fill = lambda t: t.format(**p)
        cases = [(" AND ".join(f"({fill(x)})" for x in (need, c) if x), v) for c, v in ((bull, "1e0"), (bear, "-1e0")) if c] if not value else [(fill(need), fill(value))]
        ready = lookback([need, bull, bear, value], bars)
        chosen = " ".join(f"WHEN {expand(s, c)} THEN 100 * ({expand(s, v)})" for c, v in cases)
        return s.ready(ready + 1, f"CASE {chosen} ELSE 0e0 END")

    operator(f"ta_{name}", "candle", make, "candlestick functions", **params)


_GAP_UP_1_2, _GAP_DOWN_1_2 = "bot1 > top2", "top1 < bot2"
_EQUAL_1 = "c0 <= c1 + equal1 AND c0 >= c1 - equal1"
_ONE_LONG_BLACK = "black1 AND size1 > long1 AND white0 AND o0 < l1"

# one candle
candle("cdlbelthold", 1, "size0 > long0", "white0 AND dn0 < tiny0", "black0 AND up0 < tiny0")
candle("cdlclosingmarubozu", 1, "size0 > long0", "white0 AND up0 < tiny0", "black0 AND dn0 < tiny0")
candle("cdldoji", 1, "size0 <= doji0", value="1e0")
candle("cdldragonflydoji", 1, "size0 <= doji0 AND up0 < tiny0 AND dn0 > tiny0", value="1e0")
candle("cdlgravestonedoji", 1, "size0 <= doji0 AND dn0 < tiny0 AND up0 > tiny0", value="1e0")
candle("cdlhighwave", 1, "size0 < short0 AND up0 > shvlong0 AND dn0 > shvlong0", value="col0")
candle("cdllongleggeddoji", 1, "size0 <= doji0 AND (dn0 > shlong0 OR up0 > shlong0)", value="1e0")
candle("cdllongline", 1, "size0 > long0 AND up0 < shshort0 AND dn0 < shshort0", value="col0")
candle("cdlmarubozu", 1, "size0 > long0 AND up0 < tiny0 AND dn0 < tiny0", value="col0")
candle("cdlrickshawman", 1, "size0 <= doji0 AND dn0 > shlong0 AND up0 > shlong0 AND bot0 <= l0 + rng0 / 2 + near0 AND top0 >= l0 + rng0 / 2 - near0", value="1e0")
candle("cdlshortline", 1, "size0 < short0 AND up0 < shshort0 AND dn0 < shshort0", value="col0")
candle("cdlspinningtop", 1, "size0 < short0 AND up0 > size0 AND dn0 > size0", value="col0")
candle("cdltakuri", 1, "size0 <= doji0 AND up0 < tiny0 AND dn0 > shvlong0", value="1e0")

# two candles
candle("cdlcounterattack", 2, f"col1 = -col0 AND size1 > long1 AND size0 > long0 AND {_EQUAL_1}", value="col0")
candle("cdldarkcloudcover", 2, "white1 AND size1 > long1 AND black0 AND o0 > h1 AND c0 > o1 AND c0 < c1 - size1 * {penetration}", value="-1e0", penetration=0.5)
candle("cdldojistar", 2, "size1 > long1 AND size0 <= doji0 AND (white1 AND bot0 > top1 OR black1 AND top0 < bot1)", value="-col1")
candle("cdlengulfing", 2, "white0 AND black1 AND c0 >= o1 AND o0 <= c1 AND (c0 > o1 OR o0 < c1) OR black0 AND white1 AND o0 >= c1 AND c0 <= o1 AND (o0 > c1 OR c0 < o1)", value="CASE WHEN o0 <> c1 AND c0 <> o1 THEN col0 ELSE 0.8e0 * col0 END")
candle("cdlhammer", 2, "size0 < short0 AND dn0 > shlong0 AND up0 < tiny0 AND bot0 <= l1 + near1", value="1e0")
candle("cdlhangingman", 2, "size0 < short0 AND dn0 > shlong0 AND up0 < tiny0 AND bot0 >= h1 - near1", value="-1e0")
_INSIDE = "top0 <= top1 AND bot0 >= bot1"
_INSIDE_VALUE = "CASE WHEN top0 < top1 AND bot0 > bot1 THEN -col1 ELSE -0.8e0 * col1 END"
candle("cdlharami", 2, f"size1 > long1 AND size0 <= short0 AND {_INSIDE}", value=_INSIDE_VALUE)
candle("cdlharamicross", 2, f"size1 > long1 AND size0 <= doji0 AND {_INSIDE}", value=_INSIDE_VALUE)
candle("cdlhomingpigeon", 2, "black1 AND black0 AND size1 > long1 AND size0 <= short0 AND o0 < o1 AND c0 > c1", value="1e0")
candle("cdlinneck", 2, f"{_ONE_LONG_BLACK} AND c0 <= c1 + equal1 AND c0 >= c1", value="-1e0")
candle("cdlonneck", 2, f"{_ONE_LONG_BLACK} AND c0 <= l1 + equal1 AND c0 >= l1 - equal1", value="-1e0")
candle("cdlthrusting", 2, f"{_ONE_LONG_BLACK} AND c0 > c1 + equal1 AND c0 <= c1 + size1 * 0.5", value="-1e0")
candle("cdlinvertedhammer", 2, "size0 < short0 AND up0 > shlong0 AND dn0 < tiny0 AND top0 < bot1", value="1e0")
candle("cdlshootingstar", 2, "size0 < short0 AND up0 > shlong0 AND dn0 < tiny0 AND bot0 > top1", value="-1e0")
_KICK = "col1 = -col0 AND size1 > long1 AND up1 < tiny1 AND dn1 < tiny1 AND size0 > long0 AND up0 < tiny0 AND dn0 < tiny0 AND (black1 AND l0 > h1 OR white1 AND h0 < l1)"
candle("cdlkicking", 2, _KICK, value="col0")
candle("cdlkickingbylength", 2, _KICK, value="CASE WHEN size0 > size1 THEN col0 ELSE col1 END")
candle("cdlmatchinglow", 2, f"black1 AND black0 AND {_EQUAL_1}", value="1e0")
candle("cdlpiercing", 2, f"{_ONE_LONG_BLACK} AND size0 > long0 AND c0 < o1 AND c0 > c1 + size1 * 0.5", value="1e0")
candle("cdlseparatinglines", 2, "col1 = -col0 AND o0 <= o1 + equal1 AND o0 >= o1 - equal1 AND size0 > long0 AND (white0 AND dn0 < tiny0 OR black0 AND up0 < tiny0)", value="col0")

# three candles
candle("cdl2crows", 3, f"white2 AND size2 > long2 AND black1 AND {_GAP_UP_1_2} AND black0 AND o0 < o1 AND o0 > c1 AND c0 > o2 AND c0 < c2", value="-1e0")
candle("cdl3inside", 3, "size2 > long2 AND size1 <= short1 AND top1 < top2 AND bot1 > bot2 AND (white2 AND black0 AND c0 < o2 OR black2 AND white0 AND c0 > o2)", value="-col2")
candle("cdl3outside", 3, "", "white1 AND black2 AND c1 > o2 AND o1 < c2 AND c0 > c1", "black1 AND white2 AND o1 > c2 AND c1 < o2 AND c0 < c1")
candle("cdl3starsinsouth", 3, "black2 AND black1 AND black0 AND size2 > long2 AND dn2 > shlong2 AND size1 < size2 AND o1 > c2 AND o1 <= h2 AND l1 < c2 AND l1 >= l2 AND dn1 > tiny1 AND size0 < short0 AND dn0 < tiny0 AND up0 < tiny0 AND l0 > l1 AND h0 < h1", value="1e0")
_RISING = "white2 AND white1 AND white0 AND c0 > c1 AND c1 > c2 AND o1 > o2 AND o1 <= c2 + near2"
_OPENS = "o0 > o1 AND o0 <= c1 + near1"
candle("cdl3whitesoldiers", 3, f"{_RISING} AND {_OPENS} AND up2 < tiny2 AND up1 < tiny1 AND up0 < tiny0 AND size1 > size2 - far2 AND size0 > size1 - far1 AND size0 > short0", value="1e0")
candle("cdladvanceblock", 3, f"{_RISING} AND {_OPENS} AND size2 > long2 AND up2 < shshort2 AND (size1 < size2 - far2 AND size0 < size1 + near1 OR size0 < size1 - far1 OR size0 < size1 AND size1 < size2 AND (up0 > shshort0 OR up1 > shshort1) OR size0 < size1 AND up0 > shlong0)", value="-1e0")
candle("cdlstalledpattern", 3, f"{_RISING} AND size2 > long2 AND size1 > long1 AND up1 < tiny1 AND size0 < short0 AND o0 >= c1 - size0 - near1", value="-1e0")
candle("cdlabandonedbaby", 3, "size2 > long2 AND size1 <= doji1 AND size0 > short0", "black2 AND white0 AND c0 > c2 + size2 * {penetration} AND h1 < l2 AND l0 > h1", "white2 AND black0 AND c0 < c2 - size2 * {penetration} AND l1 > h2 AND h0 < l1", penetration=0.3)
for _star, _small in (("doji", "doji1"), ("", "short1")):
    candle(f"cdlevening{_star}star", 3, f"white2 AND size2 > long2 AND size1 <= {_small} AND {_GAP_UP_1_2} AND size0 > short0 AND black0 AND c0 < c2 - size2 * {{penetration}}", value="-1e0", penetration=0.3)
    candle(f"cdlmorning{_star}star", 3, f"black2 AND size2 > long2 AND size1 <= {_small} AND {_GAP_DOWN_1_2} AND size0 > short0 AND white0 AND c0 > c2 + size2 * {{penetration}}", value="1e0", penetration=0.3)
candle("cdlgapsidesidewhite", 3, "white1 AND white0 AND size0 >= size1 - near1 AND size0 <= size1 + near1 AND o0 >= o1 - equal1 AND o0 <= o1 + equal1", f"{_GAP_UP_1_2} AND bot0 > top2", f"{_GAP_DOWN_1_2} AND top0 < bot2")
candle("cdlidentical3crows", 3, "black2 AND dn2 < tiny2 AND black1 AND dn1 < tiny1 AND black0 AND dn0 < tiny0 AND c2 > c1 AND c1 > c0 AND o1 <= c2 + equal2 AND o1 >= c2 - equal2 AND o0 <= c1 + equal1 AND o0 >= c1 - equal1", value="-1e0")
candle("cdlsticksandwich", 3, "black2 AND white1 AND black0 AND l1 > c2 AND c0 <= c2 + equal2 AND c0 >= c2 - equal2", value="1e0")
candle("cdltasukigap", 3, "abs(size1 - size0) < near1", f"{_GAP_UP_1_2} AND white1 AND black0 AND o0 < c1 AND o0 > o1 AND c0 < o1 AND c0 > top2", f"{_GAP_DOWN_1_2} AND black1 AND white0 AND o0 < o1 AND o0 > c1 AND c0 > o1 AND c0 < bot2")
candle("cdltristar", 3, "size2 <= doji2 AND size1 <= doji2 AND size0 <= doji2", f"{_GAP_DOWN_1_2} AND bot0 > bot1", f"{_GAP_UP_1_2} AND top0 < top1")
candle("cdlunique3river", 3, "size2 > long2 AND black2 AND black1 AND c1 > c2 AND o1 <= o2 AND l1 < l2 AND size0 < short0 AND white0 AND o0 > l1", value="1e0")
candle("cdlupsidegap2crows", 3, f"white2 AND size2 > long2 AND black1 AND size1 <= short1 AND {_GAP_UP_1_2} AND black0 AND o0 > o1 AND c0 < c1 AND c0 > c2", value="-1e0")
candle("cdlxsidegap3methods", 3, f"col2 = col1 AND col1 = -col0 AND o0 < top1 AND o0 > bot1 AND c0 < top2 AND c0 > bot2 AND (white2 AND {_GAP_UP_1_2} OR black2 AND {_GAP_DOWN_1_2})", value="col2")

# four and five candles
candle("cdl3blackcrows", 4, "white3 AND black2 AND dn2 < tiny2 AND black1 AND dn1 < tiny1 AND black0 AND dn0 < tiny0 AND o1 < o2 AND o1 > c2 AND o0 < o1 AND o0 > c1 AND h3 > c2 AND c2 > c1 AND c1 > c0", value="-1e0")
candle("cdl3linestrike", 4, "col3 = col2 AND col2 = col1 AND col0 = -col1 AND o2 >= bot3 - near3 AND o2 <= top3 + near3 AND o1 >= bot2 - near2 AND o1 <= top2 + near2", "white1 AND c1 > c2 AND c2 > c3 AND o0 > c1 AND c0 < o3", "black1 AND c1 < c2 AND c2 < c3 AND o0 < c1 AND c0 > o3")
candle("cdlconcealbabyswall", 4, "black3 AND black2 AND black1 AND black0 AND dn3 < tiny3 AND up3 < tiny3 AND dn2 < tiny2 AND up2 < tiny2 AND top1 < bot2 AND up1 > tiny1 AND h1 > c2 AND h0 > h1 AND l0 < l1", value="1e0")
candle("cdlbreakaway", 5, "size4 > long4 AND col4 = col3 AND col3 = col1 AND col1 = -col0 AND (black4 AND top3 < bot4 AND h2 < h3 AND l2 < l3 AND h1 < h2 AND l1 < l2 AND c0 > o3 AND c0 < c4 OR white4 AND bot3 > top4 AND h2 > h3 AND l2 > l3 AND h1 > h2 AND l1 > l2 AND c0 < o3 AND c0 > c4)", value="col0")
candle("cdlladderbottom", 5, "black4 AND black3 AND black2 AND o4 > o3 AND o3 > o2 AND c4 > c3 AND c3 > c2 AND black1 AND up1 > tiny1 AND white0 AND o0 > o1 AND c0 > h1", value="1e0")
candle("cdlmathold", 5, "size4 > long4 AND size3 < short3 AND size2 < short2 AND size1 < short1 AND white4 AND black3 AND white0 AND bot3 > top4 AND bot2 < c4 AND bot1 < c4 AND bot2 > c4 - size4 * {penetration} AND bot1 > c4 - size4 * {penetration} AND top2 < o3 AND top1 < top2 AND o0 > c1 AND c0 > greatest(h3, h2, h1)", value="1e0", penetration=0.5)
candle("cdlrisefall3methods", 5, "size4 > long4 AND size3 < short3 AND size2 < short2 AND size1 < short1 AND size0 > long0 AND col4 = -col3 AND col3 = col2 AND col2 = col1 AND col1 = -col0 AND "
       + " AND ".join(f"bot{k} < h4 AND top{k} > l4" for k in (3, 2, 1)) + " AND c2 * col4 < c3 * col4 AND c1 * col4 < c2 * col4 AND o0 * col4 > c1 * col4 AND c0 * col4 > c4 * col4", value="col4")


def _confirmed(name: str, bars: int, bull: str, bear: str) -> None:
    """100 or -100 where an inside bar breaks; twice that where one of the next three closes goes back beyond the inside bar, once."""

    def make(s):
        p = s.let(f"CASE WHEN {expand(s, bull)} THEN 1e0 WHEN {expand(s, bear)} THEN -1e0 ELSE 0e0 END")
        back = lambda age, at: f"({s.lag(p, at)} > 0 AND {s.lag('c', age)} > {s.lag('h', at + 1)} OR {s.lag(p, at)} < 0 AND {s.lag('c', age)} < {s.lag('l', at + 1)})"
        cases = [f"WHEN {p} <> 0 THEN 100 * {p}"]
        for at in (1, 2, 3):
            fresh = " AND ".join(["TRUE", *(f"NOT {back(age, at)}" for age in range(1, at))])
            cases.append(f"WHEN {s.lag(p, at)} <> 0 THEN CASE WHEN {back(0, at)} AND {fresh} THEN 200 * {s.lag(p, at)} ELSE 0e0 END")
        return s.ready(lookback([bull, bear], bars) + 4, f"CASE {' '.join(cases)} ELSE 0e0 END")

    operator(f"ta_{name}", "candle", make, "candlestick functions")


_IN_1, _IN_2 = "h1 < h2 AND l1 > l2", "h2 < h3 AND l2 > l3"
_confirmed("cdlhikkake", 3, f"{_IN_1} AND h0 < h1 AND l0 < l1", f"{_IN_1} AND h0 > h1 AND l0 > l1")
_confirmed("cdlhikkakemod", 4, f"{_IN_1} AND {_IN_2} AND h0 < h1 AND l0 < l1 AND c2 <= l2 + near2", f"{_IN_1} AND {_IN_2} AND h0 > h1 AND l0 > l1 AND c2 >= h2 - near2")
