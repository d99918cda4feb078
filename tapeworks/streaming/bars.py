"""Streaming bars: the batch bars of tapeworks.operators.bars as a watermarked streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, bucket_ms: int, late: str = "1 hour") -> DataFrame:
    """OHLCV bars of a stream (series, at_ms, seq, price, volume); at_ms of a bar is its bucket's end.

    A bar is emitted, in append mode, when the watermark (the latest time less late) passes its end; ticks that
    come later than that are dropped. State is one partial aggregate per open bar, and the checkpoint of the
    query restores it.
    """
    timed = ticks.withColumn("__time", F.timestamp_millis("at_ms")).withWatermark("__time", late)
    order = F.struct("at_ms", "seq")
    made = timed.groupBy("series", F.window("__time", f"{bucket_ms} milliseconds")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    )
    return made.select("series", F.unix_millis("window.end").alias("at_ms"), "open", "high", "low", "close", "volume")


def distinct_ticks(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream without repeats of (series, seq) within the watermark."""
    return ticks.withColumn("__time", F.timestamp_millis("at_ms")).withWatermark("__time", late).dropDuplicatesWithinWatermark(["series", "seq"]).drop("__time")
