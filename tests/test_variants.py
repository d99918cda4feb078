"""Source variants against plain Python loops that share nothing with their definitions."""

import math

import pytest

from tapeworks.operators.machines import run
from tapeworks.plans import columns, registered

XS = [100 + 9 * math.sin(i / 3) + (i * 7 % 13) for i in range(90)]


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= 2e-9 * (1 + abs(b))


def same(got, want):
    assert len(got) == len(want)
    for k, (a, b) in enumerate(zip(got, want, strict=True)):
        assert close(a, b), (k, a, b)


def column(df, name="value"):
    return [r[name] for r in df.orderBy("at_ms").collect()]


def series(spark, xs):
    return spark.createDataFrame([("a", 60_000 * (k + 1), float(x)) for k, x in enumerate(xs)], "series string, at_ms long, x double")


def bars(spark, rows):
    return spark.createDataFrame([("a", 60_000 * (k + 1), *map(float, r)) for k, r in enumerate(rows)], "series string, at_ms long, o double, h double, l double, c double, v double")


def some_bars(n=80):
    out = []
    for i in range(n):
        c = 100 + 8 * math.sin(i / 4) + i * 5 % 7
        out.append((c - 0.5 + i % 3, c + 2 + i % 2, c - 2 - i * 3 % 4, c, 50 + i * 11 % 17))
    return out


def averaged(xs, n, alpha, first):
    """A recursive average of the values that are there."""
    out, seen, y = [], [], None
    for x in xs:
        if x is None:
            out.append(None)
            continue
        seen.append(x)
        if first:
            y = x if y is None else y + alpha * (x - y)
        elif len(seen) >= n:
            y = sum(seen) / n if len(seen) == n else y + alpha * (x - y)
        out.append(y if len(seen) >= n else None)
    return out


@pytest.mark.parametrize("name, first", [("talipp_rsi", False), ("pyta_rsi", True), ("ttr_rsi", False)])
def test_rsi(spark, name, first):
    moves = [0 if first else None] + [b - a for a, b in zip(XS, XS[1:])]
    up, down = ([None if m is None else max(0, sign * m) for m in moves] for sign in (1, -1))
    a, b = averaged(up, 3, 1 / 3, first), averaged(down, 3, 1 / 3, first)
    want = [None if u is None else 100 * u / (u + d) for u, d in zip(a, b)]
    same(column(columns.compute(series(spark, XS), name)), want)
    flat = column(columns.compute(series(spark, [5] * 6), name))
    assert flat[-1] == (None if name == "ttr_rsi" else 100)


@pytest.mark.parametrize("source", ["talipp", "pyta"])
def test_macd(spark, source):
    first = source == "pyta"
    a, b = averaged(XS, 3, 0.5, first), averaged(XS, 6, 2 / 7, first)
    line = [None if y is None else x - y for x, y in zip(a, b)]
    got = columns.compute(series(spark, XS), f"{source}_macd")
    same(column(got, "macd"), line)
    same(column(got, "signal"), averaged(line, 3, 0.5, first))


def test_wilder_sum_and_zlema(spark):
    want, s = [], sum(XS[:4])
    for k, x in enumerate(XS):
        s = s * 4 / 5 + x if k >= 4 else s
        want.append(s if k >= 4 else None)
    same(column(columns.compute(series(spark, XS), "ttr_wilder_sum")), want)
    want, z = [], None
    for k in range(len(XS)):
        if k == 9:
            z = sum(XS[:10]) / 10
        elif k > 9:
            z = 2 / 11 * (2 * XS[k] - (XS[k - 6] + XS[k - 5]) / 2) + 9 / 11 * z
        want.append(z)
    same(column(columns.compute(series(spark, XS), "ttr_zlema")), want)


def test_aroon_counts_the_first_or_the_latest_of_equal_extremes(spark):
    rows = [(10, h, 5, 8, 1) for h in (11, 15, 12, 15, 11, 12, 13, 11)]
    assert column(columns.compute(bars(spark, rows), "pyta_aroon"), "up") == [None] * 5 + [20, 0, 20]
    assert column(columns.compute(bars(spark, rows), "ttr_aroon"), "up") == [None] * 4 + [80, 60, 40, 20]


def test_gaps_stay_or_pass(spark):
    rows = some_bars(30)
    rows[12] = (90, 90, 90, 90, 5)
    clv = [None if r[1] == r[2] else (2 * r[3] - r[1] - r[2]) / (r[1] - r[2]) * r[4] for r in rows]
    got = column(columns.compute(bars(spark, rows), "ttr_cmf", period=5))
    want = [None if k < 4 or k >= 12 else sum(clv[k - 4 : k + 1]) / sum(r[4] for r in rows[k - 4 : k + 1]) for k in range(30)]
    same(got, want)
    line, total = [], 0.0
    for x in clv:
        total += x or 0
        line.append(None if x is None else total)
    same(column(columns.compute(bars(spark, rows), "talipp_accu_dist")), line)
    fast, slow = averaged(line, 3, 0.5, False), averaged(line, 10, 2 / 11, False)
    same(column(columns.compute(bars(spark, rows), "talipp_chaikin_osc")), [None if s is None else f - s for f, s in zip(fast, slow)])


def test_kst_of_first_rows_by_the_mean_so_far(spark):
    terms, want, signal = ((1, 10, 10), (2, 15, 10), (3, 20, 10), (4, 30, 15)), [], []
    for i in range(len(XS)):
        m, lines = sum(XS[: i + 1]) / (i + 1), []
        for t in range(max(0, i - 8), i + 1):
            rates = lambda k: [(XS[u] / m if u < k else XS[u] / XS[u - k]) * 100 - 100 for u in range(t + 1)]  # noqa: B023, E731
            lines.append(None if t < 14 else sum(j * sum(rates(k)[-n:]) / n for j, k, n in terms))
        known = [x for x in lines if x is not None]
        want.append(lines[-1])
        signal.append(sum(known) / len(known) if known else None)
    got = columns.compute(series(spark, XS), "pyta_kst")
    same(column(got, "kst"), want)
    same(column(got, "signal"), signal)


def test_klinger_adds_ranges_between_turns(spark):
    rows, force = some_bars(), [None, None]
    span = side = 0.0
    for a, b in zip(rows[1:], rows[2:]):
        now = 1.0 if sum(b[1:4]) > sum(a[1:4]) else -1.0
        span = span + b[1] - b[2] if now == side else a[1] - a[2] + b[1] - b[2]
        side = now
        force.append(b[4] * abs(2 * ((b[1] - b[2]) / span - 1)) * side * 100)
    a, b = averaged(force, 5, 2 / 6, False), averaged(force, 9, 0.2, False)
    same(column(columns.compute(bars(spark, rows), "talipp_kvo", fast=5, slow=9)), [None if y is None else x - y for x, y in zip(a, b)])


def test_adx_shows_zeros_or_nulls_before_it_is_known(spark):
    made = {s: columns.compute(bars(spark, some_bars()), f"{s}_adx") for s in ("talipp", "pyta", "ttr")}
    assert [column(made[s], "adx")[:10].count(None) for s in made] == [9, 0, 9]
    assert column(made["pyta"], "adx")[:9] == [0] * 9 and column(made["pyta"], "plus_di")[:6] == [0] * 6
    assert all(0 <= x <= 100 for s in made for x in column(made[s], "adx")[10:])


def test_parabolic_stops(spark):
    rising = [(k, k + 1, k - 1, k, 1) for k in range(10, 22)]
    made = run(bars(spark, [*rising, (5, 6, 4, 5, 1)]), "talipp_parabolic_sar")
    values, trend = column(made), column(made, "trend")
    assert values[:5] == [None] * 4 + [9] and close(values[5], 9 + 0.02 * (15 - 9)) and trend[-2:] == [1, -1] and values[-1] == 22
    got = column(run(bars(spark, rising), "pyta_psar"))
    assert got[:2] == [10, 11] and close(got[2], 9)  # 11 + 0.02 * (11 - 11) is above the low of two rows before
    got = column(run(bars(spark, [*rising, (5, 6, 4, 5, 1)]), "ttr_sar"))
    assert close(got[0], 9 - 2 / math.sqrt(2)) and close(got[1], got[0] + 0.02 * (11 - got[0])) and got[-1] == 22


def test_zigzags(spark):
    rows = [(c, c + 1, c - 1, c, 1) for c in (100, 104, 112, 120, 115, 100, 98, 111)]
    made = run(bars(spark, rows), "talipp_zig_zag")
    assert column(made, "close") == [100, 100, 112, 120, 120, 100, 98, 111] and column(made, "type") == [-1, -1, 1, 1, 1, -1, -1, 1]
    assert column(run(bars(spark, rows), "ttr_zig_zag")) == [None, 104, None, 121, None, 99, 97, 112]


def test_adaptive_averages(spark):
    want, y = [None] * 10, XS[9]
    for k in range(10, len(XS)):
        path = sum(abs(XS[u] - XS[u - 1]) for u in range(k - 9, k + 1))
        y += (abs(XS[k] - XS[k - 10]) / path * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (XS[k] - y)
        want.append(y)
    same(column(run(series(spark, XS), "talipp_kama")), want)
    same(column(run(series(spark, XS), "pyta_kama")), [*want[:9], XS[9], *want[10:]])
    want, y = [None] * 9, sum(XS[:10]) / 10
    want.append(y)
    for x in XS[10:]:
        y += (x - y) / (10 * (x / y) ** 4)
        want.append(y)
    same(column(run(series(spark, XS), "talipp_mcginley_dynamic")), want)
    assert column(run(series(spark, [1, 1, 0, 5]), "talipp_mcginley_dynamic", period=2)) == [None, 1, None, None]
    rows = some_bars(30)
    want, y = [None] * 4, rows[4][3]
    want.append(y)
    for k in range(5, 30):
        total = sum(r[4] for r in rows[k - 4 : k + 1])
        y = ((total - rows[k][4]) * y + rows[k][4] * rows[k][3]) / total
        want.append(y)
    same(column(run(bars(spark, rows), "ttr_evwma", period=5)), want)


def test_super_trend_follows_its_bands(spark):
    made = run(bars(spark, [(k, k + 1, k - 1, k, 1) for k in range(10, 40)]), "talipp_super_trend", atr_period=3)
    # It begins on the upper band, 3 times the range of 2 above the first row that counts, and turns when a close passes it.
    same(column(made)[:13], [None, None, 0, *[19] * 7, 14, 15, 16])
    assert column(made, "direction")[2:12] == [1, *[-1] * 7, 1, 1]


def test_all_are_registered_and_take_empty_tables(spark):
    names = [n for n in registered.queries() if n.split("_")[0] in ("talipp", "pyta", "ttr")]
    assert len(names) == 112 and column(columns.compute(series(spark, []), "ttr_zlema")) == []
