"""Bar aggregation: ticks to candles, candles to longer candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, bucket_ms: int) -> DataFrame:
    """OHLCV bars of (series, at_ms, seq, price, volume); at_ms of a bar is its bucket's end.

    Buckets are floored towards minus infinity. Aggregation is partial before the one shuffle.
    """
    start = F.floor(F.col("at_ms") / bucket_ms).cast("long") * bucket_ms
    order = F.struct("at_ms", "seq")
    return ticks.groupBy("series", (start + bucket_ms).alias("bar_ms")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bar_ms", "at_ms")
