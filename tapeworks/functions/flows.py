"""Derivatives, market breadth, microstructure, and calendar sessions."""

from __future__ import annotations

from tapeworks.plans.columns import operator

D, B, M, S = "derivatives", "market breadth", "microstructure", "seasonality and session"


def _d(name: str, make, **params) -> None:
    operator(name, "derivative", make, D, **params)


_d("calendar_spread", lambda s: s.div("fut - mark", "mark"))
_d("estimated_leverage_ratio", lambda s: s.div("oi", "(longs + shorts)", "0e0"))
_d("funding_basis", lambda s: s.div("mark - idx", "idx"))
_d("funding_implied_apr", lambda s, intervals_per_year: f"funding * {intervals_per_year}", intervals_per_year=1095.0)
_d("funding_rate", lambda s: "funding")
_d("funding_rate_mean", lambda s, window: s.avg("funding", window), window=2)
_d("funding_rate_z_score", lambda s, window: s.div(f"funding - {s.avg('funding', window)}", s.sd("funding", window), "0e0"), window=2)
_d("liquidation_features", lambda s: {"longs_": "lliq", "shorts_": "sliq", "net": "lliq - sliq", "total": "lliq + sliq", "imbalance": s.div("lliq - sliq", "(lliq + sliq)", "0e0")})
_d("long_short_ratio", lambda s: s.div("longs", "shorts", "0e0"))
_d("open_interest_delta", lambda s: f"oi - {s.lag('oi')}")
_d("oi_price_divergence", lambda s, window: s.div(f"oi - {s.lag('oi', window)}", s.lag("oi", window), "0e0") + " - " + s.div(f"mark - {s.lag('mark', window)}", s.lag("mark", window)), window=1)
_d("oi_to_volume_ratio", lambda s: s.div("oi", "(tbuy + tsell)", "0e0"))
_d("oi_weighted", lambda s: s.div(s.cum("mark * oi"), s.cum("oi"), "mark"))
_d("open_interest_momentum", lambda s, period: s.div(f"100 * (oi - {s.lag('oi', period)})", s.lag("oi", period), "0e0"), period=5)
_d("perpetual_premium_index", lambda s: s.div("mark - idx", "idx"))
_d("taker_buy_sell_ratio", lambda s: s.div("tbuy", "tsell", "0e0"))
_d("term_structure_basis", lambda s: s.div("fut - idx", "idx"))


def _b(name: str, make, **params) -> None:
    operator(name, "section", make, B, **params)


_b("absolute_breadth_index", lambda s: "abs(adv - decl)")
_b("ad_volume_line", lambda s: s.cum("advvol - decvol"))
_b("advance_decline", lambda s: s.cum("adv - decl"))
_b("advance_decline_ratio", lambda s: "adv / greatest(decl, 1e0)")
_b("breadth_thrust", lambda s, period: s.avg("adv / greatest(adv + decl, 1e0)", period), period=2)
_b("bullish_percent_index", lambda s: "100 * buysig / members")
_b("cumulative_volume_index", lambda s: s.cum(s.let(s.div("advvol - decvol", "totvol", "0e0"))))
_b("high_low_index", lambda s, period: s.avg("100 * nhigh / greatest(nhigh + nlow, 1e0)", period), period=2)
_b("new_highs_new_lows", lambda s: "nhigh - nlow")
_b("percent_above_ma", lambda s: "100 * above / members")
_b("tick_index", lambda s: "adv - decl")
_b("trin", lambda s: "(adv / greatest(decl, 1e0)) / (greatest(advvol, 1e0) / greatest(decvol, 1e0))")
_b("up_down_volume_ratio", lambda s: "advvol / greatest(decvol, 1e0)")


def _m(name: str, reads: str, make, **params) -> None:
    operator(name, reads, make, M, **params)


def level(s, side: str, k: int, what: str) -> str:
    """A field of the k-th level (from 0) of a side of the book."""
    return f"{side}[{k}].{what}" if s.spark else f"{side}[{k + 1}].{what}"


def depth(s, side: str, levels: int | None = None) -> str:
    """The sizes of a side's levels (the best ones) together."""
    if s.spark:
        part = side if levels is None else f"slice({side}, 1, {levels})"
        return f"aggregate({part}, 0e0, (a_, e) -> a_ + e.size)"
    part = side if levels is None else f"{side}[1:{levels}]"
    return f"coalesce(list_sum(list_transform({part}, lambda e: e.size)), 0e0)"


def _imbalance(s, levels=None):
    a, b = s.let(depth(s, "bids", levels)), s.let(depth(s, "asks", levels))
    return f"(CASE WHEN {a} + {b} <= 0 THEN 0e0 ELSE ({a} - {b}) / nullif({a} + {b}, 0) END)"


_m("order_book_imbalance_full", "book", _imbalance)
_m("order_book_imbalance_top_n", "book", lambda s, levels: _imbalance(s, levels), levels=2)
_m("order_book_imbalance_top1", "book", lambda s: _imbalance(s, 1))


def _best(s) -> tuple[str, str, str, str]:
    return tuple(s.let(level(s, side, 0, what)) for side in ("bids", "asks") for what in ("price", "size"))


def _microprice(s):
    bp, bs, ap, asz = _best(s)
    return f"(CASE WHEN {bs} + {asz} <= 0 THEN ({bp} + {ap}) / 2 ELSE ({bp} * {asz} + {ap} * {bs}) / nullif({bs} + {asz}, 0) END)"


_m("microprice", "book", _microprice)
_m("quoted_spread", "book", lambda s: (lambda q: f"({q[2]} - {q[0]}) / (({q[0]} + {q[2]}) / 2) * 10000")(_best(s)))


def _flow(s, period):
    bp, bs, ap, asz = _best(s)
    pb, ps, pa, pz = (s.lag(x) for x in (bp, bs, ap, asz))
    event = s.let(f"CASE WHEN {pb} IS NOT NULL THEN CASE WHEN {bp} >= {pb} THEN {bs} ELSE 0e0 END - CASE WHEN {bp} <= {pb} THEN {ps} ELSE 0e0 END - CASE WHEN {ap} <= {pa} THEN {asz} ELSE 0e0 END + CASE WHEN {ap} >= {pa} THEN {pz} ELSE 0e0 END END")
    return s.sum(event, period)


_m("order_flow_imbalance", "book", _flow, period=20)


def _slope(s, side: str, mid: str, sign: int) -> str:
    """Least-squares slope of cumulative size by distance from the mid, over at most 8 levels of a side."""
    n = s.let(f"size({side})" if s.spark else f"len({side})")
    x = [s.let(f"CASE WHEN {n} > {k} THEN {sign} * ({'try_element_at(' + side + f', {k + 1})' if s.spark else f'{side}[{k + 1}]'}.price - {mid}) END") for k in range(8)]
    y = [s.let(f"CASE WHEN {n} > {k} THEN {depth(s, side, k + 1)} END") for k in range(8)]
    add = lambda terms: "(" + " + ".join(f"coalesce({e}, 0e0)" for e in terms) + ")"
    sx, sy = add(x), add(y)
    sxy, sxx = add(f"{a} * {b}" for a, b in zip(x, y, strict=True)), add(f"{a} * {a}" for a in x)
    return s.let(s.div(f"{n} * {sxy} - {sx} * {sy}", f"({n} * {sxx} - {sx} * {sx})", "0e0"))


def _depth_slope(s):
    bp, _, ap, _ = _best(s)
    mid = s.let(f"({bp} + {ap}) / 2")
    return f"({_slope(s, 'bids', mid, -1)} + {_slope(s, 'asks', mid, 1)}) / 2"


_m("depth_slope", "book", _depth_slope)
_m("signed_volume", "trade", lambda s: "size * side")
_m("cumulative_volume_delta", "trade", lambda s: s.cum("size * side"))
_m("pin", "trade", lambda s, window: f"abs({s.avg('side', window)})", window=20)
_m("trade_imbalance", "trade", lambda s, window: s.div(s.sum("size * side", window), s.sum("size", window), "0e0"), window=2)
_m("trade_sign_autocorrelation", "trade", lambda s, period: s.ready(period, s.avg(f"side * {s.lag('side')}", period - 1)), period=20)
_m("amihud_illiquidity", "trade", lambda s, period: s.avg(f"abs(ln(price / {s.lag('price')})) / (price * size)", period), period=20)


def _roll_measure(s, period):
    """The covariance of successive price changes in the window; a positive one gives no spread."""
    d = s.let(f"price - {s.lag('price')}")
    values = [s.lag(d, period - 1 - k) for k in range(period)]
    mean = s.avg(d, period)
    dev = [s.let(f"{x} - {mean}") for x in values]
    cov = s.let("(" + " + ".join(f"{dev[k]} * {dev[k - 1]}" for k in range(1, period)) + f") / {period - 1}")
    return f"(CASE WHEN {cov} IS NULL THEN NULL WHEN {cov} < 0 THEN 2 * sqrt(greatest(-{cov}, 0e0)) ELSE 0e0 END)"


_m("roll_measure", "trade", _roll_measure, period=20)
_m("effective_spread", "quote", lambda s: "2 * side * (price - mid) / mid * 10000")
_m("realized_spread", "quote", lambda s, horizon: f"2 * {s.lag('side', horizon)} * ({s.lag('price', horizon)} - mid) / {s.lag('mid', horizon)} * 10000", horizon=1)


def _kyle(s, window):
    q, dm = s.let(f"size * side + 0 * {s.lag('mid')}"), s.let(f"mid - {s.lag('mid')}")
    return s.div(s.roll2("covar_pop", q, dm, window), s.var(q, window), "0e0")


_m("kyles_lambda", "quote", _kyle, window=8)


# --- calendar: local time is at_ms shifted by a fixed offset
_DAY, _HOUR = 86_400_000, 3_600_000


def day_of(s, offset: int) -> str:
    return s.let(f"CAST(floor((at_ms + {offset * 60_000}) / {float(_DAY)!r}) AS BIGINT)")


def part_of(s, offset: int, buckets: int) -> str:
    """The part of the day, of so many equal ones."""
    minute = s.let(f"floor((at_ms + {offset * 60_000} - {day_of(s, offset)} * {_DAY}) / 60000e0)")
    return s.let(f"CAST(least(floor({minute} * {buckets} / 1440e0), {buckets - 1}) AS BIGINT)")


def _s(name: str, make, **params) -> None:
    operator(name, "candle", make, S, **params)


def _return(s) -> str:
    return s.let(s.div("c", s.lag("c"), "1e0") + " - 1")


def _per_bucket(s, key: str, n: int, make) -> dict:
    """One column per bucket: the bucket's running value at each row; 0 while it is empty."""
    return {f"bin_{k}": f"coalesce({make(f'CASE WHEN {key} = {k} THEN {{}} END')}, 0e0)" for k in range(n)}


def _mean_by(s, key: str, n: int, x: str, gate: str) -> dict:
    made = _per_bucket(s, key, n, lambda f: s.cum(s.let(f.format(x)), "avg"))
    return {k: f"(CASE WHEN {gate} THEN {v} END)" for k, v in made.items()}


_s("day_of_week_profile", lambda s, utc_offset_minutes: _mean_by(s, s.let(f"(({day_of(s, utc_offset_minutes)} + 3) % 7)"), 7, _return(s), f"{_return(s)} IS NOT NULL"), utc_offset_minutes=0)
_s("time_of_day_return_profile", lambda s, buckets, utc_offset_minutes: _mean_by(s, part_of(s, utc_offset_minutes, buckets), buckets, _return(s), f"{_return(s)} IS NOT NULL"), buckets=24, utc_offset_minutes=0)
_s("volume_by_time_profile", lambda s, buckets, utc_offset_minutes: _mean_by(s, part_of(s, utc_offset_minutes, buckets), buckets, "v", "TRUE"), buckets=24, utc_offset_minutes=0)


def _volatility_profile(s, buckets, utc_offset_minutes):
    made = _per_bucket(s, part_of(s, utc_offset_minutes, buckets), buckets, lambda f: s.cum(s.let(f.format(_return(s))), "stddev_samp"))
    return {k: f"(CASE WHEN {_return(s)} IS NOT NULL THEN {v} END)" for k, v in made.items()}


_s("intraday_volatility_profile", _volatility_profile, buckets=24, utc_offset_minutes=0)


def _seasonal(s, utc_offset_minutes):
    ret = _return(s)
    hour = part_of(s, utc_offset_minutes, 24)
    w = f"(PARTITION BY series, {hour} ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    n, mean, sd = (s.let(f"{f}({ret}) OVER {w}") for f in ("count", "avg", "stddev_samp"))
    return f"(CASE WHEN {n} < 2 OR {ret} IS NULL THEN NULL WHEN {sd} > 0 THEN ({ret} - {mean}) / nullif({sd}, 0) ELSE 0e0 END)"


_s("seasonal_z_score", _seasonal, utc_offset_minutes=0)
_s("session_high_low", lambda s, utc_offset_minutes: {"high": s.cum("h", "max", f"series, {day_of(s, utc_offset_minutes)}"), "low": s.cum("l", "min", f"series, {day_of(s, utc_offset_minutes)}")}, utc_offset_minutes=0)


def _session_vwap(s, utc_offset_minutes):
    keys = f"series, {day_of(s, utc_offset_minutes)}"
    return s.div(s.cum("(h + l + c) / 3 * v", keys=keys), s.cum("v", keys=keys), "(h + l + c) / 3")


_s("session_vwap", _session_vwap, utc_offset_minutes=0)


def _session_range(s, utc_offset_minutes):
    day, part = day_of(s, utc_offset_minutes), part_of(s, utc_offset_minutes, 3)
    keys = f"series, {day}"
    span = lambda k: f"coalesce({s.cum(s.let(f'CASE WHEN {part} = {k} THEN h END'), 'max', keys)} - {s.cum(s.let(f'CASE WHEN {part} = {k} THEN l END'), 'min', keys)}, 0e0)"
    return {"asia": span(0), "eu": span(1), "us": span(2)}


_s("session_range", _session_range, utc_offset_minutes=0)


def _gap(s, offset: int) -> str:
    new = s.let(f"CASE WHEN {s.lag('c')} IS NOT NULL AND {day_of(s, offset)} <> {s.lag(day_of(s, offset))} THEN {s.div('o', s.lag('c'), '1e0')} - 1 END")
    return s.held(new)


_s("overnight_gap", lambda s, utc_offset_minutes: _gap(s, utc_offset_minutes), utc_offset_minutes=0)


def _overnight_intraday(s, utc_offset_minutes):
    gap = _gap(s, utc_offset_minutes)
    first = s.let(f"first_value(o) OVER {s.over(keys=f'series, {day_of(s, utc_offset_minutes)}')}")
    return {"overnight": gap, "intraday": f"(CASE WHEN {gap} IS NOT NULL THEN {s.div('c', first, '1e0')} - 1 END)"}


_s("overnight_intraday_return", _overnight_intraday, utc_offset_minutes=0)


def _opening(s, period):
    early = lambda x: s.let(f"CASE WHEN {s.rn()} <= {period} THEN {x} END")
    return s.cum(early("h"), "max"), s.cum(early("l"), "min")


_s("initial_balance", lambda s, period: dict(zip(("high", "low"), _opening(s, period), strict=True)), period=3)
_s("opening_range", lambda s, period: (lambda e: {"high": e[0], "low": e[1], "breakout_distance": f"c - ({e[0]} + {e[1]}) / 2"})(_opening(s, period)), period=2)


def _daily_range(s, period, utc_offset_minutes):
    """The mean range of the last completed days: on a day's first row its own predecessor is complete."""
    day = day_of(s, utc_offset_minutes)
    keys = f"series, {day}"
    high, low = s.cum("h", "max", keys), s.cum("l", "min", keys)
    opens = s.let(f"CASE WHEN {s.lag(day)} IS NOT NULL AND {day} <> {s.lag(day)} THEN 1 ELSE 0 END")
    done = s.let(f"CASE WHEN {opens} = 1 THEN {s.lag(high)} - {s.lag(low)} END")
    number = s.cum(opens)
    total = s.cum(s.let(f"coalesce({done}, 0e0)"))
    back = s.let(f"max(CASE WHEN {opens} = 1 THEN {number} END) OVER {s.over()}")
    before = s.let(f"max(CASE WHEN {opens} = 1 THEN {total} END) OVER (PARTITION BY series ORDER BY {number} RANGE BETWEEN {period} PRECEDING AND {period} PRECEDING)")
    return f"(CASE WHEN {back} >= {period} THEN ({total} - coalesce({before}, 0e0)) / {period} END)"


_s("average_daily_range", _daily_range, period=2, utc_offset_minutes=0)
