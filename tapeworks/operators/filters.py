"""Adaptive averages, two-pole filters and Hilbert-transform cycles, as state machines over ordered rows."""

from __future__ import annotations

import math
from collections import deque
from statistics import median

from tapeworks.functions.windows import TP
from tapeworks.operators.machines import machine

CYCLES, AVERAGES = "cycles and filters", "adaptive averages"
_EPS = 2.0**-52


def _scalar(name: str, outputs: str = "value", family: str = CYCLES, reads: str = "scalar", needs=None, **params):
    return machine(name, outputs, reads=reads, needs=needs, family=family, **params)


class Smoother:
    """Two-pole low pass; the first two values pass unchanged."""

    def __init__(self, period: float):
        w = math.sqrt(2) * math.pi / period
        a = math.exp(-w)
        self.c2, self.c3 = 2 * a * math.cos(w), -a * a
        self.c1 = 1 - self.c2 - self.c3
        self.seen: deque[tuple[float, float]] = deque(maxlen=2)

    def __call__(self, x: float) -> float:
        y = x if len(self.seen) < 2 else self.c1 * (x + self.seen[-1][0]) / 2 + self.c2 * self.seen[-1][1] + self.c3 * self.seen[-2][1]
        self.seen.append((x, y))
        return y


class Band:
    """Two-pole resonator; 0 for the first two values."""

    def __init__(self, period: float, width: float):
        self.beta = math.cos(2 * math.pi / period)
        g = 1 / math.cos(4 * math.pi * width / period)
        self.alpha = g - math.sqrt(g * g - 1)
        self.x: deque[float] = deque(maxlen=2)
        self.y1 = self.y2 = 0.0

    def __call__(self, x: float) -> float:
        y = 0.0 if len(self.x) < 2 else 0.5 * (1 - self.alpha) * (x - self.x[0]) + self.beta * (1 + self.alpha) * self.y1 - self.alpha * self.y2
        self.x.append(x)
        self.y1, self.y2 = y, self.y1
        return y


class Roof:
    """One-pole high pass, then the low pass."""

    def __init__(self, low: int, high: int):
        w = 2 * math.pi / high
        self.alpha = (math.cos(w) + math.sin(w) - 1) / math.cos(w)
        self.smooth, self.x, self.hp = Smoother(low), None, 0.0

    def __call__(self, x: float) -> float:
        self.hp = 0.0 if self.x is None else (1 - self.alpha / 2) * (x - self.x) + (1 - self.alpha) * self.hp
        self.x = x
        return self.smooth(self.hp)


def _mapped(f):
    """A machine that gives f of each value."""
    out = None
    while True:
        r = yield out
        out = f(r.x)


@_scalar("super_smoother", period=10)
def _(period):
    return _mapped(Smoother(period))


@_scalar("bandpass_filter", period=20, bandwidth=0.3)
def _(period, bandwidth):
    return _mapped(Band(period, bandwidth))


@_scalar("roofing_filter", lp_period=10, hp_period=48)
def _(lp_period, hp_period):
    return _mapped(Roof(lp_period, hp_period))


@_scalar("ehlers_stochastic", period=20)
def _(period):
    roof, w, before, out = Roof(10, 48), deque(maxlen=period), None, None
    while True:
        r = yield out
        w.append(roof(r.x))
        if len(w) < period:
            continue
        span = max(w) - min(w)
        raw = 2 * (w[-1] - min(w)) / span - 1 if span > 0 else 0.0
        out = raw if before is None else (raw + before) / 2
        before = raw


def _flex(period: int, slanted: bool):
    """How far the smoothed value lies from those before it, or from the line to the oldest, in its own units."""
    smooth, w, power, out = Smoother(period), deque(maxlen=period + 1), 0.0, None
    while True:
        r = yield out
        w.append(smooth(r.x))
        if len(w) <= period:
            continue
        slope = (w[0] - w[-1]) / period if slanted else 0.0
        mean = sum(w[-1] + k * slope - w[-1 - k] for k in range(1, period + 1)) / period
        power = 0.04 * mean * mean + 0.96 * power
        out = mean / math.sqrt(power) if power > 0 else 0.0


@_scalar("reflex", period=20)
def _(period):
    return _flex(period, True)


@_scalar("trendflex", period=20)
def _(period):
    return _flex(period, False)


@_scalar("universal_oscillator", period=20)
def _(period):
    smooth, x, peak, out = Smoother(period), deque(maxlen=2), 0.0, None
    while True:
        r = yield out
        if len(x) == 2:
            f = smooth((r.x - x[0]) / 2)
            peak = max(abs(f), 0.991 * peak)
            out = min(1.0, max(-1.0, f / peak)) if peak > 0 else 0.0
        x.append(r.x)


@_scalar("even_better_sinewave", hp_period=40, ssf_length=10)
def _(hp_period, ssf_length):
    w = 2 * math.pi / hp_period
    a, smooth, hp, before, f, out = (1 - math.sin(w)) / math.cos(w), Smoother(ssf_length), 0.0, None, deque(maxlen=3), None
    while True:
        r = yield out
        hp = 0.0 if before is None else (1 + a) / 2 * (r.x - before) + a * hp
        before = r.x
        f.append(smooth(hp))
        if len(f) == 3:
            power = sum(x * x for x in f) / 3
            out = min(1.0, max(-1.0, sum(f) / 3 / math.sqrt(power))) if power > 0 else 0.0


@_scalar("fisher_transform", period=10)
def _(period):
    w, s, out = deque(maxlen=period), 0.0, None
    while True:
        r = yield out
        w.append(r.x)
        if len(w) < period:
            continue
        span = max(w) - min(w)
        s = 0.33 * (2 * (r.x - min(w)) / span - 1 if span > 0 else 0.0) + 0.67 * s
        x = min(0.999, max(-0.999, s))
        out = 0.5 * math.log((1 + x) / (1 - x))


@_scalar("instantaneous_trendline", period=20)
def _(period):
    a, x, y, n, out = 2 / (period + 1), deque(maxlen=3), deque(maxlen=2), 0, None
    while True:
        r = yield out
        n += 1
        x.append(r.x)
        x0, x1, x2 = r.x, x[-2] if len(x) > 1 else r.x, x[-3] if len(x) > 2 else r.x
        if n >= 7:
            out = (a - a * a / 4) * x0 + a * a / 2 * x1 - (a - 0.75 * a * a) * x2 + 2 * (1 - a) * y[-1] - (1 - a) ** 2 * y[-2]
        else:
            out = (x0 + 2 * x1 + x2) / 4
        y.append(out)


@_scalar("cybernetic_cycle", period=10)
def _(period):
    a, x, s, y, out = 2 / (period + 1), deque(maxlen=4), deque(maxlen=3), deque(maxlen=2), None
    while True:
        r = yield out
        x.append(r.x)
        s.append((x[3] + 2 * x[2] + 2 * x[1] + x[0]) / 6 if len(x) == 4 else r.x)
        if len(s) == 3 and len(y) == 2:
            out = (1 - a / 2) ** 2 * (s[2] - 2 * s[1] + s[0]) + 2 * (1 - a) * y[1] - (1 - a) ** 2 * y[0]
        else:
            x1, x2 = x[-2] if len(x) > 1 else r.x, x[-3] if len(x) > 2 else r.x
            out = (r.x - 2 * x1 + x2) / 4
        y.append(out)


def hilbert():
    """Sent values, yields (in-phase, quadrature, smoothed value, period, smoothed period); None while it fills.

    Four taps, two rows apart, give a quarter-cycle shift; the phase of one row to the next gives the period,
    which is held within 6 to 50 rows and moves by a fifth.
    """
    x, detrended, quad, inph = (deque(maxlen=7) for _ in range(4))
    taps = lambda w: 0.0962 * w[6] + 0.5769 * w[4] - 0.5769 * w[2] - 0.0962 * w[0]
    i2 = q2 = re = im = period = slow = 0.0
    out = None
    while True:
        value = yield out
        x.append(value)
        if len(x) < 7:
            out = None
            continue
        smooth = (4 * x[6] + 3 * x[5] + 2 * x[4] + x[3]) / 10
        scale = 0.075 * min(max(period, 6.0), 50.0) + 0.54
        detrended.append((0.0962 * smooth + 0.5769 * x[4] - 0.5769 * x[2] - 0.0962 * x[0]) * scale)
        out = (None, None, smooth, period, slow)
        if len(detrended) < 7:
            continue
        q, i = taps(detrended) * scale, detrended[3]
        quad.append(q)
        inph.append(i)
        if len(quad) < 7:
            continue
        ni, nq = 0.2 * (i - taps(quad) * scale) + 0.8 * i2, 0.2 * (q + taps(inph) * scale) + 0.8 * q2
        re, im = 0.2 * (ni * i2 + nq * q2) + 0.8 * re, 0.2 * (ni * q2 - nq * i2) + 0.8 * im
        i2, q2 = ni, nq
        raw = 2 * math.pi / math.atan2(im, re) if abs(im) > _EPS and abs(re) > _EPS else period
        raw = min(50.0, max(6.0, max(min(raw, 1.5 * period), 0.67 * period)))
        period = 0.2 * raw + 0.8 * period
        slow = 0.33 * period + 0.67 * slow
        out = (i, q, smooth, period, slow)


def _cycle(judge, least: int = 50):
    """judge(value, in-phase, quadrature, smoothed value, period, smoothed period) of each filled row, from the least-th row on."""
    core, n, out = hilbert(), 0, None
    next(core)
    while True:
        r = yield out
        n += 1
        got = core.send(r.x)
        made = judge(r.x, *got) if got is not None and got[0] is not None else None
        out = made if n >= least else None


@_scalar("hilbert_dominant_cycle")
def _():
    return _cycle(lambda x, i, q, s, p, slow: slow)


@_scalar("adaptive_cycle")
def _():
    return _cycle(lambda x, i, q, s, p, slow: min(25.0, max(3.0, math.floor(slow / 2 + 0.5))))


@_scalar("ht_phasor", "inphase quadrature")
def _():
    return _cycle(lambda x, i, q, s, p, slow: (i, q), 0)


def _phase(kept: deque, slow: float) -> tuple[float, int]:
    """The phase in degrees of the dominant cycle over its own length, and that length."""
    n = min(max(int(slow + 0.5), 1), len(kept))
    angle = [2 * math.pi * k / n for k in range(n)]
    re, im = sum(math.sin(a) * kept[-1 - k] for k, a in enumerate(angle)), sum(math.cos(a) * kept[-1 - k] for k, a in enumerate(angle))
    deg = math.degrees(math.atan(re / im)) if abs(im) > 0.001 else -90.0 if re < 0 else 90.0
    deg += 90 + 360 / slow + (180 if im < 0 else 0)
    return deg - 360 if deg > 315 else deg, n


def _with_history(judge, least: int = 50):
    """As _cycle, with the last 50 smoothed values, which are kept from the start."""
    core, kept, n, out = hilbert(), deque(maxlen=50), 0, None
    next(core)
    while True:
        r = yield out
        n += 1
        got = core.send(r.x)
        made = None
        if got is not None:
            kept.append(got[2])
            if got[0] is not None:
                made = judge(got[2], got[4], kept)
        out = made if n >= least else None


@_scalar("ht_dc_phase")
def _():
    return _with_history(lambda s, slow, kept: _phase(kept, slow)[0])


@_scalar("ht_trend_mode")
def _():
    state = {"days": 0.0, "phase": 0.0, "sine": 0.0, "lead": 0.0, "means": deque([0.0] * 3, maxlen=3)}

    def judge(smooth, slow, kept):
        phase, n = _phase(kept, slow)
        sine, lead = math.sin(math.radians(phase)), math.sin(math.radians(phase + 45))
        mean = sum(list(kept)[-n:]) / n
        m = state["means"]
        line = (4 * mean + 3 * m[2] + 2 * m[1] + m[0]) / 10
        m.append(mean)
        crossed = sine > lead and state["sine"] <= state["lead"] or sine < lead and state["sine"] >= state["lead"]
        trend = 0.0 if crossed else 1.0
        state["days"] = (0.0 if crossed else state["days"]) + 1
        if state["days"] < 0.5 * slow:
            trend = 0.0
        if slow and 0.67 * 360 / slow < phase - state["phase"] < 1.5 * 360 / slow:
            trend = 0.0
        if line and abs((smooth - line) / line) >= 0.015:
            trend = 1.0
        state["phase"], state["sine"], state["lead"] = phase, sine, lead
        return trend

    return _with_history(judge)


def _adaptive_pair(fast_limit, slow_limit):
    """MAMA and FAMA: averages whose weight follows the rate of phase change."""
    core, n, out, mama, fama, last = hilbert(), 0, None, None, None, 0.0
    next(core)
    x = deque(maxlen=7)
    while True:
        r = yield out
        n += 1
        x.append(r.x)
        got = core.send(r.x)
        if 4 <= n < 7:
            mama = fama = (4 * x[-1] + 3 * x[-2] + 2 * x[-3] + x[-4]) / 10
        if got is None or got[0] is None:
            continue
        i, q = got[:2]
        phase = math.degrees(math.atan(q / i)) if abs(i) > _EPS else last
        alpha = max(slow_limit, fast_limit / max(1.0, last - phase))
        last = phase
        mama = alpha * r.x + (1 - alpha) * mama
        fama = alpha / 2 * mama + (1 - alpha / 2) * fama
        out = (mama, fama) if n >= 33 else None


@_scalar("mama", "mama fama", fast_limit=0.5, slow_limit=0.05)
def _(fast_limit, slow_limit):
    return _adaptive_pair(fast_limit, slow_limit)


@_scalar("fama", fast_limit=0.5, slow_limit=0.05)
def _(fast_limit, slow_limit):
    core, out = _adaptive_pair(fast_limit, slow_limit), None
    next(core)
    while True:
        got = core.send((yield out))
        out = None if got is None else got[1]


# --- adaptive averages
@_scalar("kama", family=AVERAGES, er_period=10, fast=2, slow=30)
def _(er_period, fast, slow):
    w, y = deque(maxlen=er_period + 1), None
    while True:
        r = yield y
        w.append(r.x)
        if len(w) <= er_period:
            continue
        path = sum(abs(b - a) for a, b in zip(w, list(w)[1:], strict=False))
        er = abs(w[-1] - w[0]) / path if path else 0.0
        c = (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
        y = (w[0] if y is None else y) + c * (r.x - (w[0] if y is None else y))


@_scalar("vidya", family=AVERAGES, needs={"cmo": lambda s, p: _cmo(s, p["cmo_period"])}, period=14, cmo_period=9)
def _(period, cmo_period):
    y = None
    while True:
        r = yield y
        if r.cmo is not None:
            a = 2 / (period + 1) * abs(r.cmo) / 100
            y = a * r.x + (1 - a) * (r.x if y is None else y)


def _cmo(s, n: int) -> str:
    from tapeworks.functions.windows import _cmo as of

    return of(s, n)


@_scalar("frama", family=AVERAGES, period=16)
def _(period):
    w, y, half = deque(maxlen=period), None, period // 2
    span = lambda v, n: (max(v) - min(v)) / n
    while True:
        r = yield y
        w.append(r.x)
        if len(w) < period:
            continue
        v = list(w)
        n1, n2, n3 = span(v[:half], half), span(v[half:], half), span(v, period)
        a = min(1.0, max(0.01, math.exp(-4.6 * (math.log((n1 + n2) / n3) / math.log(2) - 1)))) if min(n1, n2, n3) > 0 else 0.01
        y = a * r.x + (1 - a) * (r.x if y is None else y)


@_scalar("mcginley_dynamic", family=AVERAGES, needs={"mean": lambda s, p: s.avg("x", p["period"])}, period=10)
def _(period):
    y = None
    while True:
        r = yield y
        if y is None:
            y = r.mean
        elif y > 0 and r.x > 0:
            y += (r.x - y) / (0.6 * period * (r.x / y) ** 4)


@_scalar("jma", family=AVERAGES, period=14, phase=0.0, power=2)
def _(period, phase, power):
    beta = 0.45 * (period - 1) / (0.45 * (period - 1) + 2)
    a, ratio = beta**power, min(2.5, max(0.5, phase / 100 + 1.5))
    y, e0, e1, e2 = None, 0.0, 0.0, 0.0
    while True:
        r = yield y
        if y is None:
            y = e0 = r.x
            continue
        e0 = (1 - a) * r.x + a * e0
        e1 = (r.x - e0) * (1 - beta) + beta * e1
        e2 = (e0 + ratio * e1 - y) * (1 - a) ** 2 + a * a * e2
        y += e2


@_scalar("holt_winters", family=AVERAGES, alpha=0.2, beta=0.1)
def _(alpha, beta):
    out = level = trend = before = None
    while True:
        r = yield out
        if before is None:
            before = r.x
            continue
        if level is None:
            level, trend = r.x, r.x - before
        else:
            new = alpha * r.x + (1 - alpha) * (level + trend)
            level, trend = new, beta * (new - level) + (1 - beta) * trend
        out = level + trend


@machine("evwma", family=AVERAGES, needs={"total": lambda s, p: s.sum("v", p["period"])}, period=20)
def _(period):
    y = None
    while True:
        r = yield y
        if r.total is not None:
            y = r.c if y is None else ((r.total - r.v) * y + r.v * r.c) / r.total if r.total > 0 else y


@_scalar("adaptive_laguerre_filter", family=AVERAGES, period=13)
def _(period):
    w, stage, y, out, n = deque(maxlen=period), [0.0] * 4, None, None, 0
    while True:
        r = yield out
        n += 1
        w.append(0.0 if y is None else abs(r.x - y))
        span = max(w) - min(w)
        g = median((d - min(w)) / span for d in w) if span > 0 else 0.0
        new = [(1 - g) * r.x + g * stage[0]]
        for k in range(1, 4):
            new.append(-g * new[-1] + stage[k - 1] + g * stage[k])
        stage = new
        y = (stage[0] + 2 * stage[1] + 2 * stage[2] + stage[3]) / 6
        out = y if n >= period else None


def _efficiency(w) -> float:
    path = sum(abs(b - a) for a, b in zip(w, list(w)[1:], strict=False))
    return min(1.0, abs(w[-1] - w[0]) / path) if path > 0 else 0.0


def _weight(er: float) -> float:
    return (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2


@machine("adaptive_cci", family=CYCLES, needs={"tp": lambda s, p: TP}, period=20)
def _(period):
    w, mean, out = deque(maxlen=period), None, None
    while True:
        r = yield out
        w.append(r.tp)
        if len(w) < period:
            continue
        mean = sum(w) / period if mean is None else mean + _weight(_efficiency(w)) * (r.tp - mean)
        dev = sum(abs(v - mean) for v in w) / period
        out = (r.tp - mean) / (0.015 * dev) if dev > 0 else 0.0


@_scalar("adaptive_rsi", period=14)
def _(period):
    w, up, down, gains, out = deque(maxlen=period + 1), None, None, [], None
    while True:
        r = yield out
        w.append(r.x)
        if len(w) < 2:
            continue
        d = w[-1] - w[-2]
        if up is None:
            gains.append(d)
            if len(gains) < period:
                continue
            up, down = sum(max(x, 0) for x in gains) / period, sum(max(-x, 0) for x in gains) / period
        else:
            a = _weight(_efficiency(w))
            up, down = up + a * (max(d, 0) - up), down + a * (max(-d, 0) - down)
        out = 100 * up / (up + down) if up + down else 50.0


@machine("kalman_hedge_ratio", "hedge_ratio intercept spread", reads="pair", family="price statistics", delta=1e-2, observation_var=1e-3)
def _(delta, observation_var):
    b = a = 0.0
    p = [[0.0, 0.0], [0.0, 0.0]]
    out, first, drift = None, True, delta / (1 - delta)
    while True:
        r = yield out
        if not first:
            p[0][0] += drift
            p[1][1] += drift
        first = False
        gap = r.x - (b * r.y + a)
        h = (r.y * p[0][0] + p[1][0], r.y * p[0][1] + p[1][1])
        size = h[0] * r.y + h[1] + observation_var
        k = ((p[0][0] * r.y + p[0][1]) / size, (p[1][0] * r.y + p[1][1]) / size)
        b, a = b + k[0] * gap, a + k[1] * gap
        p = [[p[i][j] - k[i] * h[j] for j in range(2)] for i in range(2)]
        out = (b, a, gap)


@_scalar("stc", family="momentum oscillators", needs={"macd": lambda s, p: f"{s.ema('x', p['fast'])} - {s.ema('x', p['slow'])}"}, fast=3, slow=5, schaff_period=4, factor=0.5)
def _(fast, slow, schaff_period, factor):
    first, second, d, y, out = deque(maxlen=schaff_period), deque(maxlen=schaff_period), None, None, None
    place = lambda w: 100 * (w[-1] - min(w)) / (max(w) - min(w)) if max(w) > min(w) else 0.0
    while True:
        r = yield out
        if r.macd is None:
            continue
        first.append(r.macd)
        if len(first) < schaff_period:
            continue
        k = place(first)
        d = k if d is None else d + factor * (k - d)
        second.append(d)
        if len(second) < schaff_period:
            continue
        k = place(second)
        y = k if y is None else y + factor * (k - y)
        out = min(100.0, max(0.0, y))
