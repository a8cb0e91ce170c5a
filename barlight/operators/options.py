"""Options of a backtest: sides, costs, brackets, flattening and portfolio weights."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from enum import IntEnum
from typing import Any, Literal, Protocol

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F


class TradeSide(IntEnum):
    LONG = 1
    SHORT = -1


class Strategy(Protocol):
    def entry(self) -> Any: ...
    def exit(self) -> Any: ...


class InitStrategy(Strategy, Protocol):
    def init(self, df: DataFrame, w: WindowSpec) -> DataFrame: ...


def _number(name: str, x: Any, above: float | None = None) -> None:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise ValueError(f"{name} must be a finite number")
    if x < 0 or above is not None and x <= above:
        raise ValueError(f"{name} must be {'above 0' if above is not None else '0 or more'}")


@dataclass(frozen=True)
class Cost:
    """Basis points charged on each fill: commission, fixed slippage, and a column of more slippage."""

    commission_bps: float = 0.0
    slippage_bps: float = 0.0
    slippage_col: str | None = None

    def __post_init__(self) -> None:
        _number("commission_bps", self.commission_bps)
        _number("slippage_bps", self.slippage_bps)
        if self.slippage_col is not None and not isinstance(self.slippage_col, str):
            raise ValueError("slippage_col must be a column name")

    @property
    def flat_bps(self) -> float:
        return float(self.commission_bps + self.slippage_bps)

    def share(self) -> Column:
        """Cost of a fill on each bar as a share of the price."""
        bps = F.lit(self.flat_bps)
        return (bps + F.col(self.slippage_col).cast("double") if self.slippage_col else bps) / 1e4


@dataclass(frozen=True)
class Bracket:
    """Take-profit and stop-loss levels: a share of the entry fill, or a column of prices."""

    take_profit: float | str | None = None
    stop_loss: float | str | None = None
    both_touch: Literal["stop_first", "take_profit_first"] = "stop_first"
    anchor: Literal["position", "signal"] = "position"

    def __post_init__(self) -> None:
        if self.take_profit is None and self.stop_loss is None:
            raise ValueError("a bracket needs a take_profit or a stop_loss")
        for name in ("take_profit", "stop_loss"):
            leg = getattr(self, name)
            if leg is not None and not isinstance(leg, str):
                _number(name, leg, 0)
        if self.both_touch not in ("stop_first", "take_profit_first") or self.anchor not in ("position", "signal"):
            raise ValueError("unknown both_touch or anchor")

    def legs(self) -> list[tuple[str, float | str]]:
        """(kind, leg), the one that wins a bar touching both first."""
        both = [("sl", self.stop_loss), ("tp", self.take_profit)]
        return [x for x in (both if self.both_touch == "stop_first" else both[::-1]) if x[1] is not None]

    def level_columns(self) -> list[str]:
        return [leg for _, leg in self.legs() if isinstance(leg, str)]


class Weekday(IntEnum):
    MON, TUE, WED, THU, FRI, SAT, SUN = range(1, 8)


@dataclass(frozen=True)
class FlattenSchedule:
    """Forced closes before the end of sessions, and bars before it that open nothing."""

    days: str | Iterable[int] = "daily"
    minutes_before_close: int = 0
    block_entry_minutes_before_close: int | None = None

    def __post_init__(self) -> None:
        for x in (self.minutes_before_close, self.block_entry_minutes_before_close):
            if x is not None and (isinstance(x, bool) or not isinstance(x, int) or x < 0):
                raise ValueError("minutes must be whole numbers of 0 or more")
        if isinstance(self.days, str):
            if self.days not in ("daily", "weekly"):
                raise ValueError("days must be daily, weekly or a set of weekdays")
        else:
            days = frozenset(Weekday(d) for d in self.days)
            if not days:
                raise ValueError("a set of weekdays must not be empty")
            object.__setattr__(self, "days", days)

    @property
    def resolved_days(self) -> str | frozenset[Weekday]:
        return self.days

    @property
    def block_minutes(self) -> int:
        given = self.block_entry_minutes_before_close
        return self.minutes_before_close if given is None else given


def resolve_flatten(flatten: Any, flatten_eod: bool = False) -> FlattenSchedule | None:
    if flatten is not None and flatten is not False and flatten_eod:
        raise ValueError("flatten and flatten_eod exclude each other")
    if flatten_eod or flatten is True or flatten == "eod":
        return FlattenSchedule("daily")
    if flatten is None or flatten is False:
        return None
    if flatten == "eow":
        return FlattenSchedule("weekly")
    if isinstance(flatten, FlattenSchedule):
        return flatten
    raise ValueError(f"flatten does not take {flatten!r}")


class InvalidPortfolioWeights(ValueError):
    """Weights that break a rule of portfolio_weights."""


def portfolio_weights(spark: SparkSession, weights: Mapping[str, float] | DataFrame) -> DataFrame:
    """(instrument, weight) of a mapping or frame: not empty, no nulls or NaN, 0 or more, each instrument once, a positive sum."""
    if isinstance(weights, Mapping):
        rows = [(k, v) for k, v in weights.items()]
    elif isinstance(weights, DataFrame):
        if not {"instrument", "weight"} <= set(weights.columns):
            raise InvalidPortfolioWeights("columns instrument and weight are needed")
        rows = [tuple(r) for r in weights.select("instrument", "weight").collect()]
    else:
        raise TypeError("weights must be a mapping or a DataFrame")
    if not rows:
        raise InvalidPortfolioWeights("weights are empty")
    names = [r[0] for r in rows]
    if any(n is None for n in names) or len(set(names)) < len(names):
        raise InvalidPortfolioWeights("instruments must not be null and each occur once")
    if any(v is None or isinstance(v, bool) or not math.isfinite(v) or v < 0 for _, v in rows) or sum(v for _, v in rows) <= 0:
        raise InvalidPortfolioWeights("weights must be finite, 0 or more, with a positive sum")
    return spark.createDataFrame([(str(k), float(v)) for k, v in rows], "instrument string, weight double")
