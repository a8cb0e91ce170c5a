"""Ticks to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ohlc(price: str, order: Column) -> list[Column]:
    return [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close")]


def ticks_to_ohlcv(ticks: DataFrame, bar_size: int, column: str = "price", step: str = "step", keys: list[str] | None = None, volume: bool = False, seed: int = 0) -> DataFrame:
    """(keys, bar, open, high, low, close[, volume]) of every bar_size ticks in order of step; an incomplete last bar goes.

    Steps number the ticks of a key from 0 without gaps. Volumes are drawn
    log-normally, each by its bar's own counter.
    """
    if bar_size < 1:
        raise ValueError("bar_size must be 1 or more")
    if column not in ticks.columns:
        raise ValueError(f"there is no column {column}")
    keys = keys or []
    bars = ticks.groupBy(*keys, F.floor(F.col(step) / bar_size).alias("bar")).agg(*_ohlc(column, F.col(step)), F.count("*").alias("_n")).where(F.col("_n") == bar_size).drop("_n")
    if volume:
        from ..functions.simulate import normal

        bars = bars.withColumn("volume", F.floor(F.exp(10 + normal(seed, *[F.col(k) for k in keys], F.col("bar")))).cast("long"))
    return bars


def numbered(ticks: DataFrame, order: list[str], keys: list[str], name: str = "step") -> DataFrame:
    """ticks with their number within a key."""
    return ticks.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def ticks_to_time_bars(ticks: DataFrame, period: str, time: str, price: str, seq: str, keys: list[str]) -> DataFrame:
    """(keys, date, open, high, low, close, n_ticks) by date_trunc of the time; seq breaks ties."""
    order = F.struct(time, seq)
    at = F.to_date(time) if period == "day" else F.date_trunc(period, time)
    return ticks.groupBy(*keys, at.alias("date")).agg(*_ohlc(price, order), F.count("*").alias("n_ticks"))
