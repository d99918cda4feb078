"""State machines over ordered rows: trailing stops, swings and the patterns made of them, counters, and bar builders.

A machine is a generator: it is sent one row at a time and yields what it makes of it, so its state is its local
variables. Rows are dealt by series, sorted by time, and streamed through Arrow batches: a task holds one batch
and one machine, however long a series is. Averages that a machine needs are columns of a window plan before it.
"""

from __future__ import annotations

import math
from collections import deque, namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions import recursive
from tapeworks.plans.columns import INPUTS, Builder


@dataclass(frozen=True)
class Machine:
    name: str
    reads: str
    make: Callable
    outputs: tuple[str, ...]
    params: dict
    needs: dict
    bars: bool
    family: str


MACHINES: dict[str, Machine] = {}


def machine(name: str, outputs: str = "value", reads: str = "candle", needs: dict | None = None, bars: bool = False, family: str = "state machines", **params):
    def add(make):
        MACHINES[name] = Machine(name, reads, make, tuple(outputs.split()), params, needs or {}, bars, family)
        return make

    return add


def run(df: DataFrame, name: str, **params) -> DataFrame:
    """series, at_ms and the machine's outputs (doubles): a row for each of df, or, of a bar builder, for each bar, with emit_seq."""
    m = MACHINES[name]
    p = m.params | params
    b = Builder()
    extra = {k: b.let(str(f(b, p))) for k, f in m.needs.items()}
    for level in b.levels:
        if level:
            df = df.selectExpr("*", *(f"{x} AS {k}" for k, x in level.items()))
    columns = [*INPUTS[m.reads], *extra]
    given = df.select("series", "at_ms", *INPUTS[m.reads], *(F.expr(x).alias(k) for k, x in extra.items()))
    fields = ", ".join(f"{k} double" for k in m.outputs)
    schema = f"series string, at_ms long, {'emit_seq long, ' if m.bars else ''}{fields}"

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        row_of = namedtuple("Row", columns)
        at, state, seq = None, None, 0
        for batch in batches:
            keys, times = batch.column("series").to_pylist(), batch.column("at_ms").to_pylist()
            out: list[tuple] = []
            for key, t, *values in zip(keys, times, *(batch.column(c).to_pylist() for c in columns), strict=True):
                if state is None or key != at:
                    at, state, seq = key, MACHINES[name].make(**p), 0
                    next(state)
                made = state.send(row_of(*values))
                if m.bars:
                    for bar in made or ():
                        out.append((key, t, seq, *bar))
                        seq += 1
                else:
                    made = made if isinstance(made, tuple) else (made,) * len(m.outputs) if made is None else (made,)
                    out.append((key, t, *made))
            names = ["series", "at_ms", *(["emit_seq"] if m.bars else []), *m.outputs]
            kinds = [pa.string(), pa.int64(), *([pa.int64()] if m.bars else []), *[pa.float64()] * len(m.outputs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return given.repartition("series").sortWithinPartitions("series", "at_ms").mapInArrow(scan, schema)


ATR = {"atr": lambda s, p: recursive.atr(s, p["atr_period"])}
STOPS, SWINGS, BARS, COUNTS = "trailing stops", "swing patterns", "alternative bars", "demark"


# --- trailing stops
def _flipping(long_stop, short_stop, first_long=lambda r: True):
    """A stop that follows price on one side and changes sides when the close crosses it.

    long_stop(row, before) and short_stop(row, before) give the stop of a side; before is None on entry.
    """
    out = stop = None
    side = 1.0
    while True:
        r = yield out
        if any(x is None for x in r):
            out = None
            continue
        if stop is None:
            side = 1.0 if first_long(r) else -1.0
            stop = (long_stop if side > 0 else short_stop)(r, None)
        else:
            stop = (long_stop if side > 0 else short_stop)(r, stop)
            if side * (r[0] - stop) < 0:
                side = -side
                stop = (long_stop if side > 0 else short_stop)(r, None)
        out = (stop, side)


def _closing(machine_, pick):
    """A machine that reads plain rows, made from one that wants the close first."""
    out = None
    next(machine_)
    while True:
        r = yield out
        out = machine_.send(pick(r))


@machine("atr_ratchet", "value direction", needs=ATR, family=STOPS, atr_period=14, start_mult=4.0, increment=0.1)
def _(atr_period, start_mult, increment):
    return _closing(_flipping(lambda r, b: r[0] - start_mult * r[1] if b is None else b + increment * r[1], lambda r, b: r[0] + start_mult * r[1] if b is None else b - increment * r[1]), lambda r: (r.c, r.atr))


@machine("modified_ma_stop", "value direction", needs={"ma": lambda s, p: s.rma("c", p["period"])}, family=STOPS, period=14)
def _(period):
    return _closing(_flipping(lambda r, b: r[1] if b is None else max(b, r[1]), lambda r, b: r[1] if b is None else min(b, r[1]), lambda r: r[0] >= r[1]), lambda r: (r.c, r.ma))


def _mean_positive(s, x: str, n: int) -> str:
    total, count = s.sum(x, n), s.sum(f"CASE WHEN {s.flat(x)} > 0 THEN 1e0 ELSE 0e0 * {s.flat(x)} END", n)
    return s.div(total, count, "0e0")


@machine("elder_safe_zone", "value direction", family=STOPS, needs={
    "noise_down": lambda s, p: _mean_positive(s, s.let(f"greatest({s.lag('l')} - l, 0e0) + 0 * {s.lag('l')}"), p["period"]),
    "noise_up": lambda s, p: _mean_positive(s, s.let(f"greatest(h - {s.lag('h')}, 0e0) + 0 * {s.lag('h')}"), p["period"])}, period=14, coeff=2.0)
def _(period, coeff):
    def low(r, b):
        raw = r[1] - coeff * r[3]
        return raw if b is None else max(b, raw)

    def high(r, b):
        raw = r[2] + coeff * r[4]
        return raw if b is None else min(b, raw)

    return _closing(_flipping(low, high), lambda r: (r.c, r.l, r.h, r.noise_down, r.noise_up))


@machine("kase_dev_stop", "value direction", family=STOPS, needs={"band": lambda s, p: (lambda d: f"{s.avg(d, p['period'])} + {p['dev']} * {s.sds(d, p['period'])}")(s.let(f"greatest(h, {s.lag('h')}) - least(l, {s.lag('l')}) + 0 * {s.lag('l')}"))}, period=30, dev=1.0)
def _(period, dev):
    out = stop = None
    side, extreme = 1.0, 0.0
    while True:
        r = yield out
        if r.band is None:
            out = None
            continue
        if stop is None:
            extreme, stop = r.h, r.h - r.band
        else:
            extreme = max(extreme, r.h) if side > 0 else min(extreme, r.l)
            stop = max(stop, extreme - r.band) if side > 0 else min(stop, extreme + r.band)
            if side * (r.c - stop) < 0:
                side = -side
                extreme = r.h if side > 0 else r.l
                stop = extreme - side * r.band
        out = (stop, side)


@machine("nrtr", "value direction", family=STOPS, pct=2.0)
def _(pct):
    out, side, water = None, 1.0, None
    while True:
        r = yield out
        if water is None:
            water = r.c
        else:
            water = max(water, r.c) if side > 0 else min(water, r.c)
            if side * (r.c - water * (1 - side * pct / 100)) < 0:
                side, water = -side, r.c
        out = (water * (1 - side * pct / 100), side)


@machine("atr_trailing_stop", needs=ATR, family=STOPS, atr_period=14, multiplier=3.0)
def _(atr_period, multiplier):
    stop = before = None
    while True:
        r = yield stop
        if r.atr is None:
            continue
        loss = multiplier * r.atr
        if stop is None:
            stop = r.c - loss
        elif r.c > stop:
            stop = max(stop, r.c - loss) if before > stop else r.c - loss
        else:
            stop = min(stop, r.c + loss) if r.c < stop and before < stop else r.c + loss
        before = r.c


def _stepping(step_long, step_short):
    """A stop of closes alone: a side's next stop from (close, stop before)."""
    stop, long = None, True
    while True:
        r = yield stop
        if stop is None:
            stop = step_long(r.x, None)
        elif (r.x < stop) if long else (r.x > stop):
            long = not long
            stop = (step_long if long else step_short)(r.x, None)
        else:
            stop = (step_long if long else step_short)(r.x, stop)


@machine("percentage_trailing_stop", reads="scalar", family=STOPS, percent=5.0)
def _(percent):
    f = percent / 100
    return _stepping(lambda x, b: x - abs(x) * f if b is None else max(b, x - abs(x) * f), lambda x, b: x + abs(x) * f if b is None else min(b, x + abs(x) * f))


@machine("step_trailing_stop", reads="scalar", family=STOPS, step_size=1.0)
def _(step_size):
    low, high = lambda x: math.floor((x - step_size) / step_size) * step_size, lambda x: math.ceil((x + step_size) / step_size) * step_size
    return _stepping(lambda x, b: low(x) if b is None else max(b, low(x)), lambda x, b: high(x) if b is None else min(b, high(x)))


@machine("renko_trailing_stop", reads="scalar", family=STOPS, block_size=1.0)
def _(block_size):
    out = anchor = None
    side = 1
    while True:
        r = yield out
        if anchor is None:
            anchor = r.x
        elif side * (r.x - anchor) < -block_size:
            side, anchor = -side, r.x
        else:
            anchor += side * max(0, math.floor(side * (r.x - anchor) / block_size)) * block_size
        out = anchor - side * block_size


@machine("volty_stop", needs=ATR, family=STOPS, atr_period=14, multiplier=2.0)
def _(atr_period, multiplier):
    out = anchor = None
    side = 1
    while True:
        r = yield out
        if r.atr is None:
            continue
        band = multiplier * r.atr
        if anchor is None:
            anchor = r.c
        elif side * (r.c - (anchor - side * band)) < 0:
            side, anchor = -side, r.c
        else:
            anchor = max(anchor, r.c) if side > 0 else min(anchor, r.c)
        out = anchor - side * band


@machine("yoyo_exit", needs=ATR, family=STOPS, atr_period=14, multiplier=2.0)
def _(atr_period, multiplier):
    trail, held = None, True
    while True:
        r = yield trail
        if r.atr is None:
            continue
        band = multiplier * r.atr
        if trail is None:
            trail = r.c - band
        elif held:
            if r.c < trail:
                held = False
            else:
                trail = max(trail, r.c - band)
        elif r.c > trail + band:
            held, trail = True, r.c - band


@machine("hilo_activator", needs={"hi": lambda s, p: s.lag(s.avg("h", p["period"])), "lo": lambda s, p: s.lag(s.avg("l", p["period"]))}, family=STOPS, period=3)
def _(period):
    out, long = None, True
    while True:
        r = yield out
        if r.hi is None:
            continue
        long = True if r.c > r.hi else False if r.c < r.lo else long
        out = r.lo if long else r.hi


@machine("super_trend", "value direction", needs=ATR, family=STOPS, atr_period=10, multiplier=3.0)
def _(atr_period, multiplier):
    out = upper = lower = before = None
    side = 1.0
    while True:
        r = yield out
        if r.atr is None:
            continue
        mid, width = (r.h + r.l) / 2, multiplier * r.atr
        if before is None:
            upper, lower = mid + width, mid - width
        else:
            upper = mid + width if mid + width < upper or before > upper else upper
            lower = mid - width if mid - width > lower or before < lower else lower
            side = (-1.0 if r.c <= upper else 1.0) if side < 0 else (1.0 if r.c >= lower else -1.0)
        before = r.c
        out = (lower if side > 0 else upper, side)


def _parabolic(start, offset, long, short, signed):
    """Parabolic stop and reverse; long and short are (initial, step, largest) acceleration."""
    r = yield None
    up = start >= 0
    sar, ep = (abs(start) if start else r.l), r.h if up else r.l
    af, before = (long if up else short)[0], r
    out = None
    while True:
        r = yield out
        first, step, most = long if up else short
        sar += af * (ep - sar)
        sar = min(sar, before.l, r.l) if up else max(sar, before.h, r.h)
        if (r.l <= sar) if up else (r.h >= sar):
            up = not up
            sar = ep - abs(ep) * offset if up else ep + abs(ep) * offset
            ep, af = (r.h if up else r.l), (long if up else short)[0]
        elif (r.h > ep) if up else (r.l < ep):
            ep, af = (r.h if up else r.l), min(af + step, most)
        before = r
        out = sar if up or not signed else -sar


@machine("psar", family=STOPS, af_start=0.02, af_step=0.02, af_max=0.2)
def _(af_start, af_step, af_max):
    a = (af_start, af_step, af_max)
    return _parabolic(0.0, 0.0, a, a, False)


@machine("sar_ext", family=STOPS, start_value=0.0, offset_on_reverse=0.0, long=(0.02, 0.02, 0.2), short=(0.02, 0.02, 0.2))
def _(start_value, offset_on_reverse, long, short):
    return _parabolic(start_value, offset_on_reverse, long, short, True)


@machine("qqe", "rsi_ma trailing_line", reads="scalar", family="momentum oscillators", rsi_period=14, smoothing=5, factor=4.236, needs={
    "ma": lambda s, p: s.ema(recursive.rsi(s, "x", p["rsi_period"]), p["smoothing"]),
    "dar": lambda s, p: (lambda e: f"{p['factor']} * {s.ema(s.ema(f'abs({e} - {s.lag(e)})', 2 * p['rsi_period'] - 1), 2 * p['rsi_period'] - 1)}")(s.ema(recursive.rsi(s, "x", p["rsi_period"]), p["smoothing"]))})
def _(rsi_period, smoothing, factor):
    out = low = high = before = None
    up = True
    while True:
        r = yield out
        if r.dar is None:
            before = r.ma
            continue
        a, b = r.ma - r.dar, r.ma + r.dar
        if low is None:
            low, high = a, b
        else:
            old_low, old_high = low, high
            low = max(low, a) if before > low and r.ma > low else a
            high = min(high, b) if before < high and r.ma < high else b
            up = True if before <= old_high < r.ma else False if before >= old_low > r.ma else up
        before = r.ma
        out = (r.ma, low if up else high)


# --- swings
Pivot = namedtuple("Pivot", "price side bar")
SWING, LEVEL = 0.05, 0.03


class Swings:
    """Confirms a swing when price turns by a share from the extreme; add() tells whether it just did."""

    def __init__(self, keep: int, share: float = SWING):
        self.pivots: deque[Pivot] = deque(maxlen=keep)
        self.share, self.side, self.extreme, self.at, self.bar = share, 1, None, 0, -1

    def add(self, r) -> bool:
        self.bar += 1
        ahead, behind = (r.h, r.l) if self.side > 0 else (r.l, r.h)
        if self.extreme is None or self.side * (ahead - self.extreme) > 0:
            self.extreme, self.at = ahead, self.bar
            return False
        if self.side * (behind - self.extreme * (1 - self.side * self.share)) > 0:
            return False
        self.pivots.append(Pivot(self.extreme, self.side, self.at))
        self.side, self.extreme, self.at = -self.side, behind, self.bar
        return True


def near(a: float, b: float, share: float = LEVEL) -> bool:
    return abs(a - b) <= share * max(abs(a), abs(b), 1e-300)


@machine("zig_zag", "swing direction", family=SWINGS, threshold=0.10)
def _(threshold):
    s, out = Swings(1, threshold), None
    while True:
        r = yield out
        out = (s.pivots[-1].price, float(s.pivots[-1].side)) if s.add(r) else None


def swing_pattern(name: str, keep: int, judge) -> None:
    """A pattern of the last pivots, judged on the bar that confirms the newest; 0 on other bars."""

    def make():
        s, out = Swings(keep), None
        while True:
            r = yield out
            fresh = s.add(r)
            out = None if len(s.pivots) < keep else float(judge(list(s.pivots))) if fresh else 0.0

    machine(name, family=SWINGS)(make)


def _cup(p):
    left, bowl, right, handle = p
    if not near(left.price, right.price):
        return 0
    inside = min(bowl.price, right.price) < handle.price < max(bowl.price, right.price)
    return (1 if handle.side < 0 and bowl.price < right.price else -1 if handle.side > 0 and bowl.price > right.price else 0) if inside else 0


def _shoulders(p):
    left, n1, head, n2, right = (x.price for x in p)
    framed = near(left, right) and near(n1, n2)
    side = p[-1].side
    return -side if framed and side * (head - left) > 0 and side * (head - right) > 0 else 0


def _legs(p):
    """Older and newer high, older and newer low, of the last four pivots."""
    highs, lows = [x.price for x in p if x.side > 0], [x.price for x in p if x.side < 0]
    return *highs, *lows


def _rectangle(p):
    h1, h2, l1, l2 = _legs(p)
    return -p[-1].side if near(h1, h2) and near(l1, l2) else 0


def _triangle(p):
    h1, h2, l1, l2 = _legs(p)
    rising, falling = l2 > l1 * (1 + LEVEL), h2 < h1 * (1 - LEVEL)
    return 1 if near(h1, h2) and rising else -1 if falling and near(l1, l2) else -p[-1].side if falling and rising else 0


def _wedge(p):
    h1, h2, l1, l2 = _legs(p)
    dh, dl = h2 - h1, l2 - l1
    return -1 if dl > dh > 0 else 1 if dh < dl < 0 else 0


def _flag(p):
    pole, back = abs(p[1].price - p[0].price), abs(p[2].price - p[1].price)
    return p[1].side if pole > 0 and back < 0.5 * pole else 0


swing_pattern("cup_and_handle", 4, _cup)
swing_pattern("double_top_bottom", 3, lambda p: -p[2].side if near(p[0].price, p[2].price) else 0)
swing_pattern("triple_top_bottom", 5, lambda p: -p[4].side if near(p[0].price, p[2].price) and near(p[2].price, p[4].price) else 0)
swing_pattern("head_and_shoulders", 5, _shoulders)
swing_pattern("rectangle_range", 4, _rectangle)
swing_pattern("triangle", 4, _triangle)
swing_pattern("wedge", 4, _wedge)
swing_pattern("flag_pennant", 3, _flag)


# The Fibonacci windows of the harmonic patterns, as (numerator, denominator, least, largest).
_HARMONIC = {
    "bat": [("ab", "xa", 0.382, 0.50), ("bc", "ab", 0.382, 0.886), ("cd", "bc", 1.618, 2.618), ("ad", "xa", 0.84, 0.93)],
    "butterfly": [("ab", "xa", 0.74, 0.84), ("bc", "ab", 0.382, 0.886), ("cd", "bc", 1.618, 2.618), ("ad", "xa", 1.27, 1.618)],
    "crab": [("ab", "xa", 0.382, 0.618), ("bc", "ab", 0.382, 0.886), ("cd", "bc", 2.24, 3.618), ("ad", "xa", 1.55, 1.65)],
    "cypher": [("ab", "xa", 0.382, 0.618), ("xc", "xa", 1.272, 1.414), ("cd", "xc", 0.74, 0.83)],
    "gartley": [("ab", "xa", 0.55, 0.70), ("bc", "ab", 0.382, 0.886), ("cd", "bc", 1.13, 1.618), ("ad", "xa", 0.74, 0.84)],
    "shark": [("ab", "xa", 1.13, 1.618), ("bc", "ab", 1.618, 2.24), ("cd", "bc", 0.382, 0.886), ("ad", "xa", 0.886, 1.13)],
}


def _within(legs: dict[str, float], rules) -> bool:
    return all(legs[b] > 0 and lo <= legs[a] / legs[b] <= hi for a, b, lo, hi in rules)


def _harmonic(rules):
    def judge(p):
        at = dict(zip("xabcd", (q.price for q in p), strict=True))
        legs = {m + n: abs(at[n] - at[m]) for m, n in ("xa", "ab", "bc", "cd", "ad", "xc")}
        return -p[-1].side if _within(legs, rules) else 0

    return judge


for _name, _rules in _HARMONIC.items():
    swing_pattern(_name, 5, _harmonic(_rules))


def _abcd(p):
    ab, bc, cd = (abs(n.price - m.price) for m, n in zip(p, p[1:], strict=False))
    fits = _within({"ab": ab, "bc": bc, "cd": cd}, [("bc", "ab", 0.382, 0.886), ("cd", "bc", 1.13, 2.618)])
    return -p[-1].side if fits and near(ab, cd, 0.10) else 0


def _drives(p):
    legs = [abs(n.price - m.price) for m, n in zip(p, p[1:], strict=False)]
    back, drive = legs[::2], legs[1::2]
    fits = all(b > 0 and 1.13 <= d / b <= 1.75 for b, d in zip(back, drive, strict=True))
    even = all(near(a, b, 0.20) for a, b in zip(drive, drive[1:], strict=False)) and all(near(a, b, 0.30) for a, b in zip(back, back[1:], strict=False))
    return -p[-1].side if fits and even else 0


swing_pattern("abcd", 4, _abcd)
swing_pattern("three_drives", 7, _drives)


def swing_levels(name: str, outputs: str, keep: int, least: int, make_levels) -> None:
    """Levels from the pivots at every bar, as soon as there are least of them."""

    def make():
        s, out = Swings(keep), None
        while True:
            r = yield out
            s.add(r)
            out = tuple(float(x) for x in make_levels(list(s.pivots), s.bar)) if len(s.pivots) >= least else None

    machine(name, outputs, family=SWINGS)(make)


_BACK, _ON, _FAN, _BEYOND = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0), (1.272, 1.414, 1.618, 2.0, 2.618), (0.382, 0.5, 0.618), (0.618, 1.0, 1.618, 2.618)
_BACK_NAMES = "level_0 level_236 level_382 level_500 level_618 level_786 level_1000"


def _retrace(a: Pivot, b: Pivot, ratios=_BACK) -> list[float]:
    return [b.price + r * (a.price - b.price) for r in ratios]


def _widest(p, _bar):
    legs = list(zip(p, p[1:], strict=False))
    return _retrace(*max(reversed(legs), key=lambda e: abs(e[0].price - e[1].price)))


def _arcs(p, bar):
    u = (bar - p[1].bar) / (p[1].bar - p[0].bar)
    curve = math.sqrt(max(0.0, 1 - u * u))
    return [p[1].price + (p[0].price - p[1].price) * r * curve for r in _FAN]


def _channel(p, bar):
    slope = (p[2].price - p[0].price) / (p[2].bar - p[0].bar)
    base = lambda at: p[0].price + slope * (at - p[0].bar)
    width = p[1].price - base(p[1].bar)
    return [base(bar), *(base(bar) + r * width for r in (0.618, 1.0, 1.618))]


def _confluence(p, _bar):
    levels = [x for a, b in zip(p, p[1:], strict=False) for x in _retrace(a, b, _FAN)]
    groups = [[x for x in levels if near(x, y)] for y in levels]
    best = max(reversed(groups), key=len)
    return sum(best) / len(best), len(best)


def _zones(p, bar):
    gone, a, b, on = bar - p[-1].bar, 1, 2, 0
    while a <= gone:
        on = on or a == gone
        a, b = b, a + b
    return on, a - gone


def _pocket(p, _bar):
    ends = sorted(_retrace(p[0], p[1], (0.618, 0.65)))
    return ends[0], (ends[0] + ends[1]) / 2, ends[1]


swing_levels("fib_retracement", _BACK_NAMES, 2, 2, lambda p, bar: _retrace(*p))
swing_levels("auto_fib", _BACK_NAMES, 6, 2, _widest)
swing_levels("fib_extension", "level_1272 level_1414 level_1618 level_2000 level_2618", 2, 2, lambda p, bar: [p[0].price + r * (p[1].price - p[0].price) for r in _ON])
swing_levels("fib_projection", "level_618 level_1000 level_1618 level_2618", 3, 3, lambda p, bar: [p[2].price + r * (p[1].price - p[0].price) for r in _BEYOND])
swing_levels("fib_fan", "fan_382 fan_500 fan_618", 2, 2, lambda p, bar: [p[0].price + r * (p[1].price - p[0].price) * (bar - p[0].bar) / (p[1].bar - p[0].bar) for r in _FAN])
swing_levels("fib_arcs", "arc_382 arc_500 arc_618", 2, 2, _arcs)
swing_levels("fib_channel", "base level_618 level_1000 level_1618", 3, 3, _channel)
swing_levels("fib_confluence", "price strength", 6, 3, _confluence)
swing_levels("fib_time_zones", "on_zone bars_to_next", 2, 1, _zones)
swing_levels("golden_pocket", "low mid high", 2, 2, _pocket)


def _turns(window, k: int) -> int:
    """1 if row k of the window is its only highest, -1 if its only lowest, 0 if neither or both."""
    up = all(i == k or r.h < window[k].h for i, r in enumerate(window))
    down = all(i == k or r.l > window[k].l for i, r in enumerate(window))
    return up - down


@machine("pivot_reversal", family=SWINGS, left=2, right=2)
def _(left, right):
    w, out, top, bottom = deque(maxlen=left + right + 1), None, None, None
    while True:
        r = yield out
        before = w[-1].c if w else None
        w.append(r)
        if len(w) < left + right + 1:
            continue
        top = w[left].h if all(i == left or x.h < w[left].h for i, x in enumerate(w)) else top
        bottom = w[left].l if all(i == left or x.l > w[left].l for i, x in enumerate(w)) else bottom
        out = 1.0 if top is not None and before <= top < r.c else 0.0
        out = -1.0 if bottom is not None and before >= bottom > r.c else out


def _fractal_pivots(strength: int):
    """Sent rows, yields the pivot that a row confirms, alternating sides: (is new side, list of pivots kept)."""
    w, pivots, n, out = deque(maxlen=2 * strength + 1), [], -1, (False, [])
    while True:
        r = yield out
        n += 1
        w.append(r)
        new = False
        side = _turns(w, strength) if len(w) == 2 * strength + 1 else 0
        if side:
            p = Pivot(w[strength].h if side > 0 else w[strength].l, side, n - strength)
            if pivots and pivots[-1].side == side:
                if side * (p.price - pivots[-1].price) > 0:
                    pivots[-1] = p
            else:
                pivots = [*pivots[-2:], p]
                new = True
        out = (new, pivots)


@machine("andrews_pitchfork", "median upper lower", family=SWINGS, strength=2)
def _(strength):
    source, out, n = _fractal_pivots(strength), None, -1
    next(source)
    while True:
        r = yield out
        n += 1
        _new, p = source.send(r)
        if len(p) < 3:
            continue
        slope = ((p[1].price + p[2].price) / 2 - p[0].price) / ((p[1].bar + p[2].bar) / 2 - p[0].bar)
        line = lambda at: p[0].price + slope * (at - p[0].bar)  # noqa: B023, E731
        off = sorted(q.price - line(q.bar) for q in p[1:])
        out = (line(n), line(n) + off[1], line(n) + off[0])


@machine("td_d_wave", family=COUNTS, strength=2)
def _(strength):
    source, out = _fractal_pivots(strength), None
    next(source)
    while True:
        r = yield out
        new, _p = source.send(r)
        if new:
            out = (out or 0.0) % 8 + 1.0


# --- DeMark counts
def _setups(lookback: int, target: int):
    """Sent rows, yields (signed count so far, rows of the run, completed side or 0); None before there are enough."""
    closes, run, side, out = deque(maxlen=lookback + 1), [], 0, None
    while True:
        r = yield out
        closes.append(r.c)
        if len(closes) <= lookback:
            continue
        now = (r.c < closes[0]) - (r.c > closes[0])
        run = [] if not now else [*run, r] if now == side else [r]
        side = now
        out = (side * min(len(run), target), run, side if side and len(run) >= target else 0)


def _countdowns(setup_lookback, setup_target, countdown_lookback, countdown_target, strict):
    rows, source, out, side, count = deque(maxlen=max(setup_lookback, countdown_lookback) + 1), _setups(setup_lookback, setup_target), None, 0, 0
    next(source)
    need = max(setup_lookback, countdown_lookback)
    while True:
        r = yield out
        rows.append(r)
        got = source.send(r)
        if len(rows) <= need or got is None:
            continue
        setup, _run, done = got
        if done and done != side:
            side, count = done, 0
        ref, before = rows[-1 - countdown_lookback], rows[-2]
        if side > 0:
            hit = r.c <= ref.l and (not strict or r.l <= before.l and r.c < before.c)
        else:
            hit = side < 0 and r.c >= ref.h and (not strict or r.h >= before.h and r.c > before.c)
        count = min(count + hit, countdown_target)
        out = (float(setup), float(side * count), float(side))


_TD = {"setup_lookback": 4, "setup_target": 9, "countdown_lookback": 2, "countdown_target": 13}


def _second(source):
    out = None
    next(source)
    while True:
        got = source.send((yield out))
        out = None if got is None else got[1]


@machine("td_sequential", "setup countdown direction", family=COUNTS, **_TD)
def _(**p):
    return _countdowns(**p, strict=False)


@machine("td_countdown", family=COUNTS, **_TD)
def _(**p):
    return _second(_countdowns(**p, strict=False))


@machine("td_combo", family=COUNTS, **_TD)
def _(**p):
    return _second(_countdowns(**p, strict=True))


@machine("td_lines", "resistance support", family=COUNTS, lookback=4, target=9)
def _(lookback, target):
    source, up, down, out = _setups(lookback, target), None, None, None
    next(source)
    while True:
        got = source.send((yield out))
        if got and got[2] > 0:
            up = max(x.h for x in got[1])
        elif got and got[2] < 0:
            down = min(x.l for x in got[1])
        out = None if up is None and down is None else (up, down)


@machine("td_risk_level", "buy_risk sell_risk", needs={"tr": lambda s, p: recursive.true_range(s)}, family=COUNTS, lookback=4, target=9)
def _(lookback, target):
    source, buy, sell, out = _setups(lookback, target), None, None, None
    next(source)
    while True:
        got = source.send((yield out))
        if got and got[2] > 0:
            x = min(got[1], key=lambda x: x.l)
            buy = x.l - x.tr
        elif got and got[2] < 0:
            x = max(got[1], key=lambda x: x.h)
            sell = x.h + x.tr
        out = None if buy is None and sell is None else (buy, sell)


@machine("three_line_break", family="charts", lines=3)
def _(lines):
    kept, out, side = deque(maxlen=lines), None, 0
    while True:
        r = yield out
        if not kept:
            kept.append(r.c)
            continue
        if side >= 0:
            new = 1 if r.c > kept[-1] else -1 if r.c < min(kept) else 0
        else:
            new = -1 if r.c < kept[-1] else 1 if r.c > max(kept) else 0
        if new:
            side = new
            kept.append(r.c)
        out = float(side) if side else None


@machine("vpin", reads="trade", family="microstructure", bucket_volume=10.0, num_buckets=2)
def _(bucket_volume, num_buckets):
    kept, filled, net, out = deque(maxlen=num_buckets), 0.0, 0.0, None
    while True:
        r = yield out
        left = r.size
        while left > 0:
            take = min(left, bucket_volume - filled)
            filled, net, left = filled + take, net + take * r.side, left - take
            if filled >= bucket_volume:
                kept.append(abs(net))
                filled = net = 0.0
        out = sum(kept) / (num_buckets * bucket_volume) if len(kept) == num_buckets else None


# --- alternative bars
def _gathering(done, extra=lambda state: ()):
    """OHLC of the rows since the last bar; done(row, state) tells when the bar is complete."""
    out, rows, state = (), None, {}
    while True:
        r = yield out
        rows = [r.o, r.h, r.l, r.c] if rows is None else [rows[0], max(rows[1], r.h), min(rows[2], r.l), r.c]
        out = ()
        if done(r, state):
            out = ((*rows, *extra(state)),)
            rows = None
            state = {k: v for k, v in state.items() if k.startswith("keep")}


@machine("tick_bars", "open high low close volume", bars=True, family=BARS, ticks=3)
def _(ticks):
    def done(r, s):
        s["n"], s["v"] = s.get("n", 0) + 1, s.get("v", 0.0) + r.v
        return s["n"] >= ticks

    return _gathering(done, lambda s: (s["v"],))


@machine("volume_bars", "open high low close volume", bars=True, family=BARS, volume_per_bar=100.0)
def _(volume_per_bar):
    def done(r, s):
        s["v"] = s.get("v", 0.0) + r.v
        return s["v"] >= volume_per_bar

    return _gathering(done, lambda s: (s["v"],))


@machine("dollar_bars", "open high low close volume dollar", bars=True, family=BARS, dollar_per_bar=1000.0)
def _(dollar_per_bar):
    def done(r, s):
        s["v"], s["d"] = s.get("v", 0.0) + r.v, s.get("d", 0.0) + r.c * r.v
        return s["d"] >= dollar_per_bar

    return _gathering(done, lambda s: (s["v"], s["d"]))


@machine("imbalance_bars", "open high low close imbalance direction", bars=True, family=BARS, threshold=3.0)
def _(threshold):
    def done(r, s):
        before = s.get("keep_c")
        if before is not None:
            s["keep_sign"] = (r.c > before) - (r.c < before) or s.get("keep_sign", 0)
            s["t"] = s.get("t", 0) + s["keep_sign"]
        s["keep_c"] = r.c
        return abs(s.get("t", 0)) >= threshold

    return _gathering(done, lambda s: (float(s["t"]), math.copysign(1.0, s["t"])))


@machine("run_bars", "open high low close length direction", bars=True, family=BARS, run_length=3)
def _(run_length):
    def done(r, s):
        before = s.get("keep_c")
        way = 0 if before is None else (r.c > before) - (r.c < before)
        s["keep_c"] = r.c
        if way and way != s.get("way", 0):
            s["way"], s["n"] = way, 1
        elif s.get("way", 0):
            s["n"] += 1
        return s.get("n", 0) >= run_length

    return _gathering(done, lambda s: (float(s["n"]), float(s["way"])))


@machine("range_bars", "open close direction", bars=True, family=BARS, size=1.0)
def _(size):
    at, out = None, ()
    while True:
        r = yield out
        at = r.c if at is None else at
        out = []
        way = 1.0 if r.c > at else -1.0
        while way * (r.c - at) >= size:
            out.append((at, at + way * size, way))
            at += way * size


@machine("renko_bars", "open close direction", bars=True, family=BARS, box_size=1.0)
def _(box_size):
    level, side, out = None, 0, ()
    while True:
        r = yield out
        level = r.c if level is None else level
        out = []
        while True:
            way = 1 if r.c > level else -1
            skip = box_size if side and way != side else 0.0  # a reversal leaves one box out
            if way * (r.c - level) < box_size + skip:
                break
            start = level + way * skip
            level, side = start + way * box_size, way
            out.append((start, level, float(way)))


@machine("kagi_bars", "start end direction", bars=True, family=BARS, reversal=2.0)
def _(reversal):
    start = extreme = None
    side, out = 0, ()
    while True:
        r = yield out
        out = ()
        if extreme is None:
            start = extreme = r.c
        elif not side:
            side, extreme = (r.c > extreme) - (r.c < extreme), r.c
        elif side * (r.c - extreme) > 0:
            extreme = r.c
        elif side * (extreme - r.c) >= reversal:
            out = ((start, extreme, float(side)),)
            start, side, extreme = extreme, -side, r.c


@machine("point_and_figure_bars", "direction high low", bars=True, family=BARS, box_size=1.0, reversal=3)
def _(box_size, reversal):
    top = bottom = None
    side, out = 0, ()
    while True:
        r = yield out
        out, box = (), math.floor(r.c / box_size) * box_size
        if top is None:
            top = bottom = box
        elif not side:
            side = 1 if box >= top + box_size else -1 if box <= bottom - box_size else 0
            top, bottom = max(top, box) if side > 0 else top, min(bottom, box) if side < 0 else bottom
        elif side > 0 and box > top:
            top = box
        elif side < 0 and box < bottom:
            bottom = box
        elif (side > 0 and box <= top - reversal * box_size) or (side < 0 and box >= bottom + reversal * box_size):
            out = ((float(side), top, bottom),)
            top, bottom = (top - box_size, box) if side > 0 else (box, bottom + box_size)
            side = -side


@machine("three_line_break_bars", "open close direction", bars=True, family=BARS, lines=3)
def _(lines):
    kept, seed, out = deque(maxlen=lines), None, ()
    while True:
        r = yield out
        out = ()
        if seed is None:
            seed = r.c
            continue
        at = kept[-1][1] if kept else seed
        side = kept[-1][2] if kept else 0
        if not side:
            way = (r.c > at) - (r.c < at)
        elif side > 0:
            way = 1 if r.c > at else -1 if r.c < min(min(x[:2]) for x in kept) else 0
        else:
            way = -1 if r.c < at else 1 if r.c > max(max(x[:2]) for x in kept) else 0
        if way:
            kept.append((at, r.c, float(way)))
            out = (kept[-1],)



