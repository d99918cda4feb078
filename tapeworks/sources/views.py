"""Inputs of every kind made from candles and ticks, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeworks.plans.columns import TIES
from tapeworks.sources import market

#: SQL over candles(series, at_ms, open, high, low, close, volume), by kind of input.
FROM_CANDLES = {
    "candle": "SELECT series, at_ms, open AS o, high AS h, low AS l, close AS c, volume AS v FROM {candles}",
    "scalar": "SELECT series, at_ms, close AS x FROM {candles}",
    "return": "SELECT series, at_ms, x FROM (SELECT series, at_ms, close / lag(close) OVER (PARTITION BY series ORDER BY at_ms) - 1 AS x FROM {candles}) z WHERE x IS NOT NULL",
    "unit": "SELECT series, at_ms, 2 * (close - floor(close)) - 1 AS x FROM {candles}",
    "pair": "SELECT a.series, a.at_ms, a.close AS x, b.close AS y FROM {candles} a JOIN (SELECT at_ms, close FROM {candles} WHERE series = 'view') b ON a.at_ms = b.at_ms WHERE a.series <> 'view'",
    "derivative": "SELECT series, at_ms, 0.0001e0 + (CAST(volume AS BIGINT) % 3) * 0.00001e0 AS funding, close AS mark, close - 0.1e0 AS idx, close + 0.3e0 AS fut, 1000 + 10 * volume + close AS oi, 500 + high AS longs, 400 + low AS shorts, volume * 3e0 AS tbuy, volume * 2e0 + 1 AS tsell, high - close AS lliq, close - low AS sliq FROM {candles}",
    "book": "SELECT series, at_ms, {array}({book}(close - 0.1e0, volume), {book}(close - 0.2e0, volume + 2), {book}(close - 0.4e0, volume * 2)) AS bids, {array}({book}(close + 0.1e0, high - low + 1), {book}(close + 0.3e0, volume + 1)) AS asks FROM {candles}",
    "section": """
SELECT 'all' AS series, at_ms,
  sum(CASE WHEN change > 0 THEN 1e0 ELSE 0e0 END) AS adv, sum(CASE WHEN change < 0 THEN 1e0 ELSE 0e0 END) AS decl,
  sum(CASE WHEN change > 0 THEN volume ELSE 0e0 END) AS advvol, sum(CASE WHEN change < 0 THEN volume ELSE 0e0 END) AS decvol, sum(volume) AS totvol,
  sum(CASE WHEN close >= top THEN 1e0 ELSE 0e0 END) AS nhigh, sum(CASE WHEN close <= bottom THEN 1e0 ELSE 0e0 END) AS nlow,
  sum(CASE WHEN close > mean THEN 1e0 ELSE 0e0 END) AS above, sum(CASE WHEN close > open THEN 1e0 ELSE 0e0 END) AS buysig, sum(1e0) AS members
FROM (SELECT *, close - lag(close) OVER (PARTITION BY series ORDER BY at_ms) AS change,
        max(close) OVER (PARTITION BY series ORDER BY at_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS top,
        min(close) OVER (PARTITION BY series ORDER BY at_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS bottom,
        avg(close) OVER (PARTITION BY series ORDER BY at_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM {candles}) z
WHERE change IS NOT NULL GROUP BY at_ms""",
}
FROM_TICKS = {
    "trade": "SELECT series, at_ms, price, 1e0 + (seq % 5) AS size, CASE WHEN seq % 2 = 0 THEN 1e0 ELSE -1e0 END AS side FROM {ticks}",
    "quote": "SELECT series, at_ms, price + 0.02e0 AS price, 1e0 + (seq % 3) AS size, CASE WHEN seq % 2 = 0 THEN 1e0 ELSE -1e0 END AS side, price AS mid FROM {ticks}",
}
#: Ticks in DuckDB; the same as market.ticks, without us.
TICKS_SQL = "ticks AS (SELECT event_type AS series, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, value AS price, 1.0 AS volume FROM events WHERE value > 0)"


def rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The input rows of a kind, from the driver's events; those of ticks with the columns that order ticks of one at_ms."""
    if kind in FROM_TICKS:
        return spark.sql(FROM_TICKS[kind].replace(" FROM {ticks}", f", {', '.join(TIES)} FROM {{ticks}}"), ticks=market.ticks(spark, sf_dir))
    text = FROM_CANDLES[kind].replace("{array}", "array").replace("{book}", "_book")
    for _ in range(8):
        text = _named(text)
    return spark.sql(text, candles=market.candles(spark, sf_dir))


def _named(text: str) -> str:
    """One more call of _book(price, size) as a struct of these two."""
    import re

    return re.sub(r"_book\(([^,()]+), ([^()]+)\)", r"named_struct('price', \1, 'size', \2)", text, count=1)


def duck(kind: str) -> str:
    """WITH clauses in DuckDB that end in rows, the same input."""
    import re

    if kind in FROM_TICKS:
        return f"{TICKS_SQL}, rows_ AS ({FROM_TICKS[kind].format(ticks='ticks')})"
    text = re.sub(r"\{book\}\(([^,()]+), ([^()]+)\)", r"{'price': \1, 'size': \2}", FROM_CANDLES[kind]).replace("{array}", "list_value").replace("{candles}", "candles")
    return f"{market.CANDLES_SQL}, rows_ AS ({text})"
