"""Row-wise price measures and pivot levels."""

from __future__ import annotations

from tapeworks.plans.columns import operator

F = "prices"
_RANGE = "(h - l)"


def _simple(name: str, sql: str) -> None:
    operator(name, "candle", lambda s: sql, F)


_simple("avg_price", "(o + h + l + c) / 4")
_simple("median_price", "(h + l) / 2")
_simple("typical_price", "(h + l + c) / 3")
_simple("weighted_close", "(h + l + 2 * c) / 4")
operator("balance_of_power", "candle", lambda s: s.div("c - o", _RANGE, "0e0"), F)
operator("body_size_pct", "candle", lambda s: s.div("abs(c - o)", _RANGE, "0e0"), F)
operator("close_vs_open", "candle", lambda s: s.div("c - o", "o", "0e0"), F)
operator("high_low_range", "candle", lambda s: s.div("h - l", "c", "0e0"), F)
operator("wick_ratio", "candle", lambda s: s.div("(h - greatest(o, c)) - (least(o, c) - l)", _RANGE, "0e0"), F)
operator("intraday_intensity", "candle", lambda s: s.div("v * (2 * c - h - l)", _RANGE, "0e0"), F)
operator("market_facilitation_index", "candle", lambda s: s.div("h - l", "v"), F)
operator("true_range", "candle", lambda s: true_range(s), F)


def true_range(s) -> str:
    """The range, widened to the close before."""
    p = s.lag("c")
    return s.let(f"CASE WHEN {p} IS NULL THEN h - l ELSE greatest(h - l, abs(h - {p}), abs(l - {p})) END")


def _levels(**made):
    return lambda s: made


_PP = "(h + l + c) / 3"
operator("classic_pivots", "candle", _levels(pp=_PP, r1=f"2 * {_PP} - l", r2=f"{_PP} + (h - l)", r3=f"h + 2 * ({_PP} - l)", s1=f"2 * {_PP} - h", s2=f"{_PP} - (h - l)", s3=f"l - 2 * (h - {_PP})"), F)
operator("fibonacci_pivots", "candle", _levels(pp=_PP, **{f"{side}{k}": f"{_PP} {sign} {r} * (h - l)" for side, sign in (("r", "+"), ("s", "-")) for k, r in ((1, 0.382), (2, 0.618), (3, 1.0))}), F)
operator("camarilla", "candle", _levels(pp=_PP, **{f"{side}{k}": f"c {sign} (h - l) * 1.1 / {d}" for side, sign in (("r", "+"), ("s", "-")) for k, d in ((1, 12), (2, 6), (3, 4), (4, 2))}), F)
_W = "(h + l + 2 * c) / 4"
operator("woodie_pivots", "candle", _levels(pp=_W, r1=f"2 * {_W} - l", r2=f"{_W} + (h - l)", s1=f"2 * {_W} - h", s2=f"{_W} - (h - l)"), F)
_X = "(CASE WHEN c < o THEN h + 2 * l + c WHEN c > o THEN 2 * h + l + c ELSE h + l + 2 * c END)"
operator("demark_pivots", "candle", _levels(pp=f"{_X} / 4", r1=f"{_X} / 2 - l", s1=f"{_X} / 2 - h"), F)
_TC = f"(2 * {_PP} - (h + l) / 2)"
operator("central_pivot_range", "candle", _levels(pivot=_PP, tc=f"greatest({_TC}, (h + l) / 2)", bc=f"least({_TC}, (h + l) / 2)"), F)
operator("inverse_fisher_transform", "scalar", lambda s, scale: f"tanh({scale} * x)", F, scale=0.01)
