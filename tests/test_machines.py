"""State machines and bar builders: hand cases, series kept apart, no look-ahead."""

import math

import pytest

from tapeworks.operators.machines import MACHINES, run


def bars(spark, closes, spread=0.5, names=("a",)):
    rows = [(n, 60_000 * (k + 1), float(c), c + spread, c - spread, float(c), 10.0) for n in names for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series string, at_ms long, o double, h double, l double, c double, v double")


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("series", "at_ms", *(["emit_seq"] if "emit_seq" in df.columns else [])).collect()]


def test_renko_needs_two_boxes_to_turn(spark):
    made = got(run(bars(spark, [10, 12.5, 11.2, 9.9]), "renko_bars"), "open", "close", "direction")
    assert made == [(10, 11, 1), (11, 12, 1), (11, 10, -1)]


def test_range_tick_and_volume_bars(spark):
    assert got(run(bars(spark, [10, 12, 11]), "range_bars"), "open", "close", "direction") == [(10, 11, 1), (11, 12, 1), (12, 11, -1)]
    assert got(run(bars(spark, [1, 5, 3, 4]), "tick_bars"), "open", "high", "low", "close", "volume") == [(1, 5.5, 0.5, 3, 30)]
    assert len(got(run(bars(spark, range(20)), "volume_bars"), "volume")) == 2


def test_kagi_and_line_break(spark):
    assert got(run(bars(spark, [10, 13, 12, 10.5, 9]), "kagi_bars"), "start", "end", "direction") == [(10, 13, 1)]
    assert got(run(bars(spark, [10, 11, 12, 13, 9]), "three_line_break_bars"), "open", "close", "direction") == [(10, 11, 1), (11, 12, 1), (12, 13, 1), (13, 9, -1)]


def test_stops_follow_and_flip(spark):
    values = got(run(bars(spark, [100, 110, 105, 120, 100]), "nrtr", pct=10), "value", "direction")
    assert [(round(v, 9), d) for v, d in values] == [(90, 1), (99, 1), (99, 1), (108, 1), (110, -1)]
    rising = got(run(bars(spark, [10 + k for k in range(30)]), "super_trend"), "value", "direction")
    assert rising[8] == (None, None) and all(d == 1 for _, d in rising[9:])
    sar = got(run(bars(spark, [10 + k for k in range(20)] + [5]), "psar"), "value")
    assert sar[0] == (None,) and sar[5][0] < 15 and sar[-1][0] > 5


def test_swings_and_their_patterns(spark):
    path = [100, 120, 100, 120.5, 100]
    zig = [z for z in got(run(bars(spark, path), "zig_zag"), "swing", "direction") if z[0] is not None]
    assert zig == [(120.5, 1), (99.5, -1), (121, 1)]
    assert got(run(bars(spark, path), "double_top_bottom"), "value")[-1] == (-1,)
    levels = got(run(bars(spark, [100, 120, 100, 121]), "fib_retracement"), "level_0", "level_500", "level_1000")[-1]
    assert levels == (99.5, 110, 120.5)


def test_setup_count_reaches_its_target(spark):
    rows = got(run(bars(spark, [50 - k for k in range(20)]), "td_sequential"), "setup", "countdown", "direction")
    assert rows[3] == (None, None, None) and rows[4][0] == 1 and rows[12] == (9, 1, 1) and rows[-1] == (9, 8, 1)


@pytest.mark.parametrize("name", sorted(n for n, m in MACHINES.items() if m.reads == "candle"))
def test_prefixes_and_series(name):
    """Directly on the generators that need no window columns: a prefix gives the same, and a fresh machine knows nothing."""
    from collections import namedtuple

    m = MACHINES[name]
    if m.needs:
        pytest.skip("needs window columns")
    row = namedtuple("row", "o h l c v")
    rows = [row(c, c + 1, c - 1, c, 10.0) for c in (100 + 12 * math.sin(i / 4) + i % 3 for i in range(120))]

    def play(part):
        g = m.make(**m.params)
        next(g)
        return [(lambda x: list(x) if m.bars else x)(g.send(r)) for r in part]

    whole = play(rows)
    assert repr(whole[:70]) == repr(play(rows[:70]))


def test_series_are_kept_apart(spark):
    one = got(run(bars(spark, [10, 12, 9, 14]), "range_bars"), "open", "close")
    two = got(run(bars(spark, [10, 12, 9, 14], names=("a", "b")), "range_bars"), "series", "open", "close")
    assert [x[1:] for x in two if x[0] == "b"] == one and run(bars(spark, [1]).limit(0), "psar").collect() == []
