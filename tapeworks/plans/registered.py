"""The queries of the engine's own operators, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.functions import candles, extras, flows, native, orders, patterns, prices, recursive, variants, windows  # noqa: F401  they fill OPERATORS
from tapeworks.operators import analysis, filters, machines  # noqa: F401  filters fill MACHINES
from tapeworks.operators import variants as _machines_of_variants  # noqa: F401
from tapeworks.plans import columns
from tapeworks.sources import market, views

#: Digits of results: sums are taken in other orders in other engines.
DIGITS = 9


def _kind(op: columns.Operator) -> str:
    """Prices for most scalar operators, returns for ratios of returns, values around 0 for elementwise mathematics."""
    if op.reads == "scalar" and op.family == "mathematics":
        return "unit"
    if op.reads == "scalar" and op.family == "risk and performance" and op.name not in ("recovery_factor", "max_drawdown", "average_drawdown", "pain_index", "drawdown_duration"):
        return "return"
    return op.reads


def _query(op: columns.Operator) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: columns.compute(views.rows(spark, sf_dir, _kind(op)), op.name, DIGITS)


def _oracle(op: columns.Operator) -> str:
    return f"WITH {views.duck(_kind(op))} {columns.query(op.name, 'rows_ q', False, DIGITS)}"


def _sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: several operators in one pass over hourly candles."""
    bars = views.rows(spark, sf_dir, "scalar")
    return columns.fused(bars, {"sma5": ("sma_of", {"period": 5}), "bollinger": ("bollinger_bands", {"period": 20}), "zscore": ("z_score", {})}, DIGITS)


_SMA_PARTS = {
    "sma5_value": "CASE WHEN row_number() OVER w >= 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) END",
    "bollinger_upper": "m + 2 * d", "bollinger_middle": "m", "bollinger_lower": "m - 2 * d", "bollinger_stddev": "d",
    "zscore_value": "CASE WHEN d = 0 THEN 0 ELSE (close - m) / d END",
}
_SMA_SQL = f"""
WITH {market.CANDLES_SQL} SELECT series, at_ms, {", ".join(f"{columns.rounded(x, DIGITS)} AS {k}" for k, x in _SMA_PARTS.items())}
FROM (SELECT *, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS m, CASE WHEN row_number() OVER w >= 20 THEN stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS d
      FROM candles WINDOW w AS (PARTITION BY series ORDER BY at_ms)) z WINDOW w AS (PARTITION BY series ORDER BY at_ms)"""


def _machine(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: machines.run(views.rows(spark, sf_dir, machines.MACHINES[name].reads), name)


def _analysis(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: analysis.analyse(views.rows(spark, sf_dir, analysis.ANALYSES[name][0]), name, DIGITS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"sma": _sma} | {name: _query(op) for name, op in columns.OPERATORS.items()} | {name: _machine(name) for name in machines.MACHINES} | {name: _analysis(name) for name in analysis.ANALYSES}


def oracle_sql() -> dict[str, str]:
    analyses = {name: f"SELECT * FROM (WITH {views.duck(kind)} SELECT * FROM ({analysis.text(name, 'rows_', False, DIGITS)}) y) x" for name, (kind, *_) in analysis.ANALYSES.items()}
    return {"sma": _SMA_SQL} | {name: _oracle(op) for name, op in columns.OPERATORS.items()} | analyses
