"""The SQL operators against plain Python loops, hand vectors, and the no-look-ahead property."""

import math

import duckdb
import pytest

from tapeworks.operators.machines import MACHINES
from tapeworks.plans import columns, registered
from tapeworks.sources import market


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, (k + 1) * 60_000, float(x)) for k, x in enumerate(values)], "series string, at_ms long, x double")


def candles(spark, n=60, name="a"):
    rows = []
    for i in range(1, n + 1):
        c = 100 + 7 * math.sin(0.13 * i) + i / 23
        rows.append((name, 60_000 * i, c + 0.1, c + 2.0, c - 1.0, c, 100.0 + i % 7))
    return spark.createDataFrame(rows, "series string, at_ms long, o double, h double, l double, c double, v double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("series", "at_ms").collect()]


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= 2e-9 * (1 + abs(b))


def same(got, want):
    assert len(got) == len(want)
    for k, (a, b) in enumerate(zip(got, want)):
        assert close(a, b), (k, a, b)


def test_sma_hand_vector(spark):
    same(values(columns.compute(series(spark, [1, 2, 3, 4]), "sma_of", period=3)), [None, None, 2, 3])


def test_ema_is_seeded_by_the_mean(spark):
    same(values(columns.compute(series(spark, [1, 2, 3, 4, 8]), "ema", period=3)), [None, None, 2, 3, 5.5])


def test_rsi_of_a_rise_is_100_and_of_a_flat_series_50(spark):
    same(values(columns.compute(series(spark, [1, 2, 3, 4]), "rsi", period=3)), [None, None, None, 100])
    same(values(columns.compute(series(spark, [5] * 5), "rsi", period=3)), [None, None, None, 50, 50])


def test_ema_over_many_blocks_is_the_plain_recursion(spark):
    xs = [100 + 9 * math.sin(i / 5) + (i % 11) for i in range(3000)]
    want, y = [], None
    for i, x in enumerate(xs):
        y = None if i < 4 else sum(xs[:5]) / 5 if i == 4 else y + (x - y) / 3
        want.append(y)
    same(values(columns.compute(series(spark, xs), "ema", period=5)), want)


def test_atr_and_adx_by_loops(spark):
    bars = candles(spark)
    rows = bars.orderBy("at_ms").collect()
    tr = [rows[0].h - rows[0].l] + [max(b.h - b.l, abs(b.h - a.c), abs(b.l - a.c)) for a, b in zip(rows, rows[1:])]
    want, y = [], None
    for i, x in enumerate(tr):
        y = None if i < 4 else sum(tr[:5]) / 5 if i == 4 else (y * 4 + x) / 5
        want.append(y)
    same(values(columns.compute(bars, "atr", period=5)), want)
    adx = values(columns.compute(bars, "adx", period=5), "adx")
    assert adx[:9] == [None] * 9 and all(-1e-9 <= x <= 100 + 1e-9 for x in adx[9:])


@pytest.mark.parametrize("name, f", [
    ("variance", lambda w: sum((x - sum(w) / len(w)) ** 2 for x in w) / len(w)),
    ("skewness", lambda w: (lambda m: sum((x - m) ** 3 for x in w) / len(w) / (sum((x - m) ** 2 for x in w) / len(w)) ** 1.5)(sum(w) / len(w))),
    ("rolling_iqr", lambda w: (lambda s: (lambda q: q(0.75) - q(0.25))(lambda p: (lambda h: s[int(h)] + (h - int(h)) * (s[min(int(h) + 1, len(s) - 1)] - s[int(h)]))(p * (len(s) - 1))))(sorted(w))),
    ("linreg_slope", lambda w: (lambda n, m: sum((i - (n - 1) / 2) * (x - m) for i, x in enumerate(w)) / sum((i - (n - 1) / 2) ** 2 for i in range(n)))(len(w), sum(w) / len(w))),
])
def test_windows_by_loops(spark, name, f):
    n = columns.OPERATORS[name].params["period"]
    xs = [100 + 9 * math.sin(i / 3) + (i * 7 % 13) for i in range(50)]
    same(values(columns.compute(series(spark, xs), name)), [None if i + 1 < n else f(xs[i + 1 - n : i + 1]) for i in range(50)])


def test_neutral_values_of_constant_windows(spark):
    flat = series(spark, [7] * 25)
    for name, want in (("z_score", 0), ("percent_b", 0.5), ("skewness", 0), ("r_squared", 1), ("cmo", 0), ("rolling_min_max_scaler", 0.5)):
        assert values(columns.compute(flat, name))[-1] == want, name


@pytest.mark.parametrize("name", sorted(n for n, op in columns.OPERATORS.items() if op.reads in ("candle", "scalar")))
def test_later_rows_never_change_earlier_ones(name):
    """In DuckDB, which runs the same definitions: a prefix gives the same rows as the whole."""
    op = columns.OPERATORS[name]
    made = "SELECT 'a' AS series, 3600000 * i AS at_ms, {0} AS {1} FROM range(1, {2}) t(i)"
    c = "(100 + 7 * sin(0.13 * i) + i / 23.0)"
    cols = {"candle": f"{c} + 0.1 AS o, {c} + 2 AS h, {c} - 1 AS l, {c} AS c, 100e0 + i % 7 AS v", "scalar": f"{c} AS x"}[op.reads]
    run = lambda n: duckdb.sql(columns.query(name, f"(SELECT 'a' AS series, 3600000 * i AS at_ms, {cols} FROM range(1, {n}) t(i)) q", False) + " ORDER BY at_ms").fetchall()
    assert made and repr(run(161)[:120]) == repr(run(121))


def test_fused_equals_separate(spark):
    s = series(spark, [100 + 9 * math.sin(i / 3) for i in range(60)])
    both = columns.fused(s, {"a": ("ema", {"period": 4}), "b": ("z_score", {})})
    same(values(both, "a_value"), values(columns.compute(s, "ema", period=4)))
    same(values(both, "b_value"), values(columns.compute(s, "z_score")))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1, "one exchange for all"


def test_series_do_not_mix(spark):
    two = series(spark, range(10), "a").union(series(spark, range(100, 110), "b"))
    got = values(columns.compute(two, "sma_of", period=3))
    same(got, [None, None, *range(1, 9), None, None, *range(101, 109)])


def test_every_query_has_an_oracle_and_the_empty_table_works(spark):
    assert registered.queries().keys() - MACHINES.keys() == registered.oracle_sql().keys()
    assert values(columns.compute(series(spark, []), "ema")) == []


def test_ticks_of_one_millisecond_are_in_order_of_microseconds_and_number(spark, tmp_path):
    """kyles_lambda by a plain loop over ticks of which up to six share a millisecond, for rows stored in any order."""
    ticks = [(1_700_000_000_000_000 + (k // 6) * 1000 + (k % 6) // 2 * 150, (k * 7) % 240, 50.0 + (k * k) % 23) for k in range(240)]
    by_time = sorted(ticks)
    want, q, dm = [], [], []
    for (_, _, before), (_, n, mid) in zip(by_time, by_time[1:]):
        q, dm = [*q, (1 + n % 3) * (1 if n % 2 == 0 else -1)][-8:], [*dm, mid - before][-8:]
        mean_q, mean_dm = sum(q) / len(q), sum(dm) / len(dm)
        var = sum((a - mean_q) ** 2 for a in q)
        want.append(None if len(q) < 8 else 0.0 if var == 0 else sum((a - mean_q) * (b - mean_dm) for a, b in zip(q, dm)) / var)
    want = sorted(((us // 1000, x) for (us, _, _), x in zip(by_time, [None, *want])), key=repr)
    for k, stored in enumerate((by_time, by_time[::-1], ticks[1::2] + ticks[::2])):
        rows = ", ".join(f"({n}, timestamp_micros({us}), 'a', {mid}D)" for us, n, mid in stored)
        spark.sql(f"SELECT * FROM VALUES {rows} AS t(event_id, ts, event_type, value)").coalesce(1).write.parquet(f"{tmp_path}/{k}/events.parquet")
        got = sorted(((r.at_ms, r.value) for r in registered.queries()["kyles_lambda"](spark, f"{tmp_path}/{k}").collect()), key=repr)
        assert [t for t, _ in got] == [t for t, _ in want]
        assert all(a is None and b is None or abs(a - b) <= 1e-6 * (1 + abs(b)) for (_, a), (_, b) in zip(got, want))


def test_tick_bars(spark):
    ticks = spark.createDataFrame([("a", 10, 1, 5.0, 1.0), ("a", 20, 2, 7.0, 1.0), ("a", 59, 3, 4.0, 2.0), ("a", 60, 4, 9.0, 1.0), ("a", -1, 0, 2.0, 1.0)], "series string, at_ms long, seq long, price double, volume double")
    from tapeworks.operators.bars import tick_bars

    got = {r.at_ms: (r.open, r.high, r.low, r.close, r.volume) for r in tick_bars(ticks, 60).collect()}
    assert got == {0: (2, 2, 2, 2, 1), 60: (5, 7, 4, 4, 4), 120: (9, 9, 9, 9, 1)}
    assert market.HOUR_MS == 3_600_000


def test_entry_imports():
    import __spark_entry__ as entry

    assert "sma" in entry.queries() and "ema" in entry.oracle_sql()
