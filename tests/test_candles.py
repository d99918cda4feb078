"""Candlestick functions and prefilled methods against loops over plain lists, which share nothing with the SQL."""

import math
import random
import statistics

import pytest

from tapeworks.plans import columns, registered  # noqa: F401  registered fills OPERATORS

N = 400


@pytest.fixture(scope="module")
def bars():
    rng, out, c = random.Random(12), [], 100.0
    for _ in range(N):
        o = c + rng.choice([0, 0, 0.05, -0.05, 1.5, -1.5, 0.4, -0.4])
        c = o + rng.choice([0.0, 0.02, -0.02, 0.3, -0.3, 1.2, -1.2, 2.5, -2.5])
        h, low = max(o, c) + rng.choice([0, 0, 0.02, 0.5, 2.0]), min(o, c) - rng.choice([0, 0, 0.02, 0.5, 2.0])
        out.append((o, h, low, c, float(rng.randrange(0, 5))))
    return out


@pytest.fixture(scope="module")
def frame(spark, bars):
    return spark.createDataFrame([("s", k, *b, b[3]) for k, b in enumerate(bars)], "series string, at_ms long, o double, h double, l double, c double, v double, x double").cache()


def got(frame, name, **params):
    rows = columns.compute(frame, name, **params).orderBy("at_ms").collect()
    return [r[2] for r in rows] if len(rows[0]) == 3 else [tuple(r)[2:] for r in rows]


def settings(bars, k):
    """What the candle at k is compared with: averages over the candles before it."""
    body = lambda b: abs(b[3] - b[0])
    rng = lambda b: b[1] - b[2]
    mean = lambda f, n: sum(f(b) for b in bars[k - n : k]) / n
    return {"long": mean(body, 10), "short": mean(body, 10), "doji": mean(rng, 10) * 0.1, "tiny": mean(rng, 10) * 0.1, "near": mean(rng, 5) * 0.2, "equal": mean(rng, 5) * 0.05, "shadow": mean(lambda b: rng(b) - body(b), 10) / 2}


def test_patterns_by_loops(frame, bars):
    body = lambda b: abs(b[3] - b[0])
    sign = lambda b: 1 if b[3] >= b[0] else -1
    up, down = (lambda b: b[1] - max(b[0], b[3])), (lambda b: min(b[0], b[3]) - b[2])

    def marubozu(k):
        b, t = bars[k], settings(bars, k)
        return 100 * sign(b) if body(b) > t["long"] and up(b) < t["tiny"] and down(b) < t["tiny"] else 0

    def hammer(k):
        b, t, p = bars[k], settings(bars, k), settings(bars, k - 1)
        return 100 if body(b) < t["short"] and down(b) > body(b) and up(b) < t["tiny"] and min(b[0], b[3]) <= bars[k - 1][2] + p["near"] else 0

    def engulfing(k):
        (o1, _, _, c1, _), (o, _, _, c, _) = bars[k - 1], bars[k]
        if sign(bars[k]) == sign(bars[k - 1]):
            return 0
        lo, hi, lo1, hi1 = min(o, c), max(o, c), min(o1, c1), max(o1, c1)
        if lo <= lo1 and hi >= hi1 and (lo < lo1 or hi > hi1):
            return sign(bars[k]) * (100 if o != c1 and c != o1 else 80)
        return 0

    def evening_star(k):
        a, b, c = bars[k - 2], bars[k - 1], bars[k]
        star = body(a) > settings(bars, k - 2)["long"] and sign(a) > 0 and body(b) <= settings(bars, k - 1)["short"] and min(b[0], b[3]) > max(a[0], a[3])
        return -100 if star and body(c) > settings(bars, k)["short"] and sign(c) < 0 and c[3] < a[3] - body(a) * 0.3 else 0

    def long_line(k):
        b, t = bars[k], settings(bars, k)
        return 100 * sign(b) if body(b) > t["long"] and up(b) < t["shadow"] and down(b) < t["shadow"] else 0

    def tristar(k):
        limit, (a, b, c) = settings(bars, k - 2)["doji"], bars[k - 2 : k + 1]
        if max(map(body, (a, b, c))) > limit:
            return 0
        tops, bottoms = [max(x[0], x[3]) for x in (a, b, c)], [min(x[0], x[3]) for x in (a, b, c)]
        return -100 if bottoms[1] > tops[0] and tops[2] < tops[1] else 100 if tops[1] < bottoms[0] and bottoms[2] > bottoms[1] else 0

    for name, f, start in (("cdlmarubozu", marubozu, 10), ("cdlhammer", hammer, 11), ("cdlengulfing", engulfing, 1), ("cdleveningstar", evening_star, 12), ("cdllongline", long_line, 10), ("cdltristar", tristar, 12)):
        want = [None] * start + [f(k) for k in range(start, N)]
        assert got(frame, f"ta_{name}") == want, name
        assert name == "cdltristar" or any(want[start:]), name


def test_confirmations_by_a_state_machine(frame, bars):
    """The inside bar that breaks, remembered until a close of the next three goes back beyond it or another one comes."""
    want, held, at = [], 0, None
    for k in range(N):
        out = 0
        if k >= 2:
            a, b, c = bars[k - 2], bars[k - 1], bars[k]
            inside = b[1] < a[1] and b[2] > a[2]
            if inside and (c[1] < b[1] and c[2] < b[2] or c[1] > b[1] and c[2] > b[2]):
                held, at = (100 if c[1] < b[1] else -100), k
                out = held
            elif at is not None and k <= at + 3 and (held > 0 and c[3] > bars[at - 1][1] or held < 0 and c[3] < bars[at - 1][2]):
                out, at = 2 * held, None
        want.append(out)
    assert got(frame, "ta_cdlhikkake")[10:] == want[10:] and 200 in map(abs, want)


def test_prefilled_methods_by_loops(frame, bars):
    x = [b[3] for b in bars]

    def windows(n):
        for k in range(N):
            yield ([x[0]] * n + x[: k + 1])[-n:]

    ema = lambda values, n: [y := values[0]] + [y := y + 2 / (n + 1) * (v - y) for v in values[1:]]
    wma = lambda w: sum(v * (k + 1) for k, v in enumerate(w)) / (len(w) * (len(w) + 1) / 2)
    dev = lambda w: sum(abs(v - statistics.fmean(w)) for v in w) / len(w)
    cases = {
        "sma": [statistics.fmean(w) for w in windows(10)],
        "st_dev": [statistics.stdev(w) for w in windows(10)],
        "smm": [statistics.median(w) for w in windows(9)],
        "median_abs_dev": [sum(abs(v - statistics.median(w)) for v in w) / 9 for w in windows(9)],
        "mean_abs_dev": [dev(w) for w in windows(10)],
        "cci": [(w[-1] - statistics.fmean(w)) / dev(w) if dev(w) else 0 for w in windows(18)],
        "wma": [wma(w) for w in windows(10)],
        "swma": [sum(v * min(k + 1, 9 - k) for k, v in enumerate(w)) / 25 for w in windows(9)],
        "lin_reg": [(lambda r: r.intercept + r.slope * 9)(statistics.linear_regression(range(10), w)) for w in windows(10)],
        "highest_index": [min(k for k in range(10) if w[-1 - k] == max(w)) for w in windows(10)],
        "integral": [sum(w) for w in windows(10)],
        "derivative": [(w[-1] - w[0]) / 5 for w in windows(6)],
        "linear_volatility": [sum(abs(b - a) for a, b in zip(w, w[1:])) for w in windows(11)],
        "tma": ema(ema(ema(x, 10), 10), 10),
        "wsma": ema(x, 19),
    }
    for name, want in cases.items():
        assert got(frame, f"native_{name}") == pytest.approx(want, rel=2e-9, abs=2e-9), name
    peaks = [1 if k >= 2 and x[k - 2] >= max(x[max(0, k - 5) : k - 1]) and x[k - 2] > max(x[k - 1 : k + 1]) else 0 for k in range(N)]
    assert got(frame, "native_upper_reversal") == peaks


def test_default_profiles_by_loops(frame, bars):
    c = [b[3] for b in bars]
    ema = lambda values, n, y: [y := y + 2 / (n + 1) * (v - y) for v in values]
    line = [a - b for a, b in zip(ema(c, 12, c[0]), ema(c, 26, c[0]))]
    want = list(zip(line, ema(line, 9, line[0])))
    macd = got(frame, "profile_macd_default")
    assert macd[:255] == [(None, None)] * 255 and [x for r in macd[255:] for x in r] == pytest.approx([x for r in want[255:] for x in r], rel=2e-9, abs=2e-9)
    total, sums = 0.0, []
    for _, h, low, close, v in bars:
        total += (0 if h == low else ((close - low) - (h - close)) / (h - low)) * v
        sums.append(total)
    want = [a - b for a, b in zip(ema(sums, 3, 0.0), ema(sums, 10, 0.0))]
    assert got(frame, "profile_chaikin_default")[255:] == pytest.approx(want[255:], rel=2e-9, abs=2e-9)
    assert all(-1 <= x <= 1 for x in got(frame, "profile_cmo_default")[255:]) and math.isclose(got(frame, "profile_donchian_default")[-1][2], max(b[1] for b in bars[-20:]))
