"""Market-shaped views of the driver's tables: ticks, candles, pairs and cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, at_ms, us (microseconds within at_ms), seq, price, volume from events with a positive value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    at = F.col("ts").cast("timestamp")
    return e.select(F.col("event_type").alias("series"), F.unix_millis(at).alias("at_ms"), F.pmod(F.unix_micros(at), F.lit(1000)).alias("us"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def candles(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    """One bar per series and bucket, closed at the bucket's end."""
    from tapeworks.operators.bars import tick_bars

    return tick_bars(ticks(spark, sf_dir), bucket_ms)


#: The same candles in DuckDB.
CANDLES_SQL = """
candles AS (
  SELECT event_type AS series, ((epoch_us(ts) // 1000) // 3600000) * 3600000 + 3600000 AS at_ms,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*) * 1.0 AS volume
  FROM events WHERE value > 0 GROUP BY 1, 2)
"""
