"""State machines of the source variants: stops, zigzags and adaptive averages as three public libraries compute them.

Stops work on mirrored prices: toward is what the position gains by, against what stops it, both times its side, so
that one set of rules serves long and short.
"""

from __future__ import annotations

import math
from collections import deque

from tapeworks.functions.variants import FAMILY, true_range
from tapeworks.operators.machines import machine


def _mirrored(r, side: float) -> tuple[float, float]:
    return (r.h, r.l) if side > 0 else (-r.l, -r.h)


@machine("talipp_parabolic_sar", "value trend ep accel_factor", family=FAMILY, af_start=0.02, af_step=0.02, af_max=0.2)
def _(af_start, af_step, af_max):
    """Starts long after five rows, at their least low."""
    rows, out, side, af = deque(maxlen=5), None, 1.0, af_start
    stop = best = None
    while True:
        r = yield out
        if stop is not None:
            toward, against = _mirrored(r, side)
            before, stop = best, min(stop + af * (best - stop), *(_mirrored(rows[-k], side)[1] for k in (1, 2)))
            if toward > best:
                best, af = toward, min(af + af_step, af_max)
            if stop > against:
                side, stop, best, af = -side, -max(before, toward), -against, af_start
        rows.append(r)
        if stop is None and len(rows) == 5:
            stop, best = min(x.l for x in rows), max(x.h for x in rows)
        out = None if stop is None else (side * stop, side, side * best, af)


@machine("pyta_psar", family=FAMILY, af_start=0.02, af_step=0.02, af_max=0.2)
def _(af_start, af_step, af_max):
    """The first two rows give their closes; the extreme starts at the first high."""
    rows, out, side, af, stop, best = deque(maxlen=2), None, 1.0, af_start, None, None
    while True:
        r = yield out
        if len(rows) < 2:
            stop, best = r.c, r.h if best is None else best
        else:
            toward, against = _mirrored(r, side)
            stop += af * (best - stop)
            if against < stop:
                side, stop, best, af = -side, -best, -against, af_step
            else:
                if toward > best:
                    best, af = toward, min(af + af_step, af_max)
                older, newer = (_mirrored(x, side)[1] for x in rows)
                stop = older if older < stop else min(stop, newer)
        rows.append(r)
        out = side * stop


@machine("ttr_sar", family=FAMILY, af_step=0.02, af_max=0.2)
def _(af_step, af_max):
    """Starts below the first row, by its range over the root of 2; extremes are those of two rows."""
    last, out, side, af, stop, best = None, None, 1.0, af_step, None, None
    while True:
        r = yield out
        if last is None:
            stop, best = r.l - (r.h - r.l) / math.sqrt(2), r.h
        else:
            pair = [_mirrored(x, side) for x in (last, r)]
            further = max(best, *(x[0] for x in pair))
            if pair[1][1] > stop:
                stop = min(stop + af * (best - stop), *(x[1] for x in pair))
                if further > best:
                    af = af_max if af == af_max else af + af_step
                best = further
            else:
                side, stop, best, af = -side, -further, -further, af_step
        last, out = r, side * stop


@machine("talipp_super_trend", "value direction", needs={"atr": lambda s, p: s.rma(true_range(s, True), p["atr_period"])}, family=FAMILY, atr_period=10, multiplier=3.0)
def _(atr_period, multiplier):
    """Bands and value start at 0, a row before the first average counts."""
    n, out, top, bottom, value, close = 0, None, 0.0, 0.0, 0.0, None
    while True:
        r = yield out
        n += 1
        if n > atr_period:
            was, half = (top, bottom), multiplier * r.atr
            upper, lower = (r.h + r.l) / 2 + half, (r.h + r.l) / 2 - half
            top = upper if upper < top or close > top else top
            bottom = lower if lower > bottom or close < bottom else bottom
            if value == was[0]:
                value = top if r.c <= top else bottom
            elif value == was[1]:
                value = bottom if r.c >= bottom else top
        close = r.c
        out = None if n < atr_period else (value, 1.0 if r.c > value else -1.0)


@machine("talipp_zig_zag", "open high low close volume type", family=FAMILY, threshold=0.1)
def _(threshold):
    """The row of the latest pivot; type 1 is a high. The first pivot is the first row, as a low."""
    out, at, side = None, None, -1.0
    while True:
        r = yield out
        if at is None:
            at = r
        elif side > 0:
            if r.l <= at.h * (1 - threshold):
                at, side = r, -1.0
            elif r.h >= at.h:
                at = r
        elif r.h >= at.l * (1 + threshold):
            at, side = r, 1.0
        elif r.l <= at.l:
            at = r
        out = (at.o, at.h, at.l, at.c, at.v, side)


@machine("ttr_zig_zag", family=FAMILY, threshold=0.1)
def _(threshold):
    """The pivot's price on rows that move it, else null; it starts at the middle of the second row."""
    out, point, side, n = None, None, 0, 0
    while True:
        r = yield out
        n += 1
        if n == 1:
            continue
        here = point is None
        point = (r.h + r.l) / 2 if here else point
        lower, upper, top, bottom = point * (1 - threshold), point * (1 + threshold), max(point, r.h), min(point, r.l)
        if side == 0:
            side = 1 if top >= upper else -1 if bottom <= lower else 0
        if side < 0:
            if r.l == bottom:
                point, here = r.l, True
            if r.h >= upper:
                point, here, side = r.h, True, 1
        elif side > 0:
            if r.h == top:
                point, here = r.h, True
            if r.l <= lower:
                point, here, side = r.l, True, -1
        out = point if here else None


def _kama(shows_first: bool):
    def make(er_period, fast, slow):
        quick, lazy = 2 / (fast + 1), 2 / (slow + 1)
        w, out, y = deque(maxlen=er_period + 1), None, None
        while True:
            r = yield out
            w.append(r.x)
            if len(w) == er_period:
                y = r.x
                out = y if shows_first else None
            elif len(w) > er_period:
                path = sum(abs(w[k + 1] - w[k]) for k in range(er_period))
                y += ((abs(w[-1] - w[0]) / path if path else 0.0) * (quick - lazy) + lazy) ** 2 * (r.x - y)
                out = y

    return make


for _source, _first in (("talipp", False), ("pyta", True)):
    machine(f"{_source}_kama", reads="scalar", family=FAMILY, er_period=10, fast=2, slow=30)(_kama(_first))


@machine("talipp_mcginley_dynamic", reads="scalar", needs={"mean": lambda s, p: s.avg("x", p["period"])}, family=FAMILY, period=10)
def _(period):
    """Starts at a mean; null for good once a step is too large for a number."""
    y = None
    gone = False
    while True:
        r = yield None if gone else y
        if y is None:
            y = r.mean
        elif not gone:
            square = (r.x / y) * (r.x / y) if y else 0.0
            step = period * square * square
            y = y + (r.x - y) / step if step else math.inf
            gone = not math.isfinite(y)


@machine("ttr_evwma", needs={"total": lambda s, p: s.sum("v", p["period"])}, family=FAMILY, period=20)
def _(period):
    """Starts at a close; null for good after a window without volume."""
    y = None
    gone = False
    while True:
        r = yield None if gone else y
        gone = gone or y is not None and not r.total
        if not gone and r.total is not None:
            y = r.c if y is None else ((r.total - r.v) * y + r.v * r.c) / r.total
