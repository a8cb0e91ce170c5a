"""Bar order, and the window idioms built on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BarOrder:
    """Which columns separate instruments and put their bars in order; order columns must be unique per instrument."""

    date: str = "date"
    instrument: str | None = None
    seq: str | None = None

    @property
    def keys(self) -> list[str]:
        return [self.instrument] if self.instrument else []

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.date, *([self.seq] if self.seq else []))

    @property
    def upto(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(1 - n, 0)


def ffill(c: Column, upto: WindowSpec) -> Column:
    """The last value of c that is not null, at or before each row."""
    return F.last(c, ignorenulls=True).over(upto)


def sma(c: Column, n: int, order: BarOrder) -> Column:
    """Mean of the last n rows; null until there are n."""
    w = order.last(n)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def ema(df: DataFrame, column: str, n: int, order: BarOrder, name: str) -> DataFrame:
    """Exponential mean with weight 2 / (n + 1), seeded by the first value; a null keeps the mean before it.

    The recursion is a fold in Python per instrument, over Arrow batches.
    """
    import pandas as pd
    from pyspark.sql.types import DoubleType, StructField, StructType

    alpha, sort = 2 / (n + 1), [order.date, *([order.seq] if order.seq else [])]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(sort, kind="stable")
        frame[name] = frame[column].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        return frame

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return df.groupBy(*order.keys).applyInPandas(run, schema)


def macd(df: DataFrame, order: BarOrder, column: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """df with macd and macd_signal."""
    df = ema(ema(df, column, fast, order, "_fast"), column, slow, order, "_slow")
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ema(df, "macd", signal, order, "macd_signal")


def islands(df: DataFrame, flag: Column, order: BarOrder, name: str = "island") -> DataFrame:
    """Rows with a true flag, each run of them numbered."""
    # A run's rows share the number of rows with a false flag before them.
    gaps = F.sum(F.when(flag, 0).otherwise(1)).over(order.upto)
    return df.withColumn(name, gaps).where(flag)
