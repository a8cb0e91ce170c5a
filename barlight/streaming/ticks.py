"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, window: str = "1 minute", late: str = "10 minutes", time: str = "ts", price: str = "price", seq: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, open, high, low, close, n_ticks) of event-time windows, final once the watermark has passed them."""
    order = F.struct(time, seq)
    grouped = ticks.withWatermark(time, late).groupBy(*(keys or []), F.window(time, window).alias("w"))
    bars = grouped.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("n_ticks"))
    return bars.select(*(keys or []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "n_ticks")
