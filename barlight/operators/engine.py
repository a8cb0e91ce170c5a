"""Backtests: conditions to positions, per-bar returns and trades, over a panel of bars.

A run is one plan of windows over (instrument ORDER BY date, seq): signals of
all instruments and both sides are columns of the same rows. Orders fill at the
next bar's open, except limits, brackets and forced closes, which fill on their
own bar.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.expr import Limit, as_condition, collect_entry_refs, walk
from ..functions.windows import BarOrder, ffill
from .entry_scan import with_realized
from .flatten import flatten_masks
from .options import Bracket, Cost, TradeSide, portfolio_weights, resolve_flatten


@dataclass(frozen=True)
class BacktestResult:
    """returns(date, return), trades and signals of one instrument; all three are lazy plans."""

    returns: DataFrame
    trades: DataFrame
    signals: DataFrame


class MultiBacktestResult:
    """Results of a panel: combined frames with the instrument first, or one instrument's by name."""

    def __init__(self, result: BacktestResult, instrument: str, weights: DataFrame | None = None):
        self._result, self._instrument, self._weights = result, instrument, weights
        self._symbols: list[str] | None = None

    @property
    def symbols(self) -> list[Any]:
        if self._symbols is None:
            self._symbols = [r[0] for r in self._result.signals.select(self._instrument).distinct().orderBy(self._instrument).collect()]
        return self._symbols

    def __len__(self) -> int:
        return len(self.symbols)

    def __iter__(self) -> Iterator[Any]:
        return iter(self.symbols)

    def __contains__(self, symbol: object) -> bool:
        return symbol in self.symbols

    def __getitem__(self, symbol: Any) -> BacktestResult:
        if symbol not in self.symbols:
            raise KeyError(symbol)
        pick = lambda df: df.where(F.col(self._instrument) == F.lit(symbol)).drop(self._instrument)
        return BacktestResult(pick(self._result.returns), pick(self._result.trades), pick(self._result.signals))

    def items(self) -> Iterator[tuple[Any, BacktestResult]]:
        return ((s, self[s]) for s in self.symbols)

    @property
    def returns(self) -> DataFrame:
        """All instruments' returns; with weights, the portfolio's."""
        return self._result.returns if self._weights is None else weighted_returns(self._result.returns, self._weights, self._instrument)

    @property
    def trades(self) -> DataFrame:
        return self._result.trades

    @property
    def signals(self) -> DataFrame:
        return self._result.signals


def weighted_returns(returns: DataFrame, weights: DataFrame, instrument: str = "instrument", date: str = "date") -> DataFrame:
    """(date, return): sum of return * weight over the sum of the weights of the instruments with a bar on that date."""
    w = F.broadcast(weights.select(F.col("instrument").alias(instrument), "weight"))
    joined = returns.join(w, instrument)
    total = F.sum("weight")
    return joined.groupBy(date).agg(F.try_divide(F.sum(F.col("return") * F.col("weight")), total).alias("return")).orderBy(date)


class _Side:
    """Column names of one side's plan."""

    def __init__(self, strategy: Any, side: TradeSide, suffix: str):
        self.strategy, self.default, self.suffix = strategy, side, suffix

    def __getattr__(self, name: str) -> str:
        return f"_{name}{self.suffix}"


def _guard(df: DataFrame, tests: list[tuple[Column, str]]) -> None:
    """One aggregate for all checks; raises the message of the first that any row fails."""
    if not tests:
        return
    row = df.agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(f"t{i}") for i, (t, _) in enumerate(tests)]).first()
    for bad, (_, message) in zip(row, tests, strict=True):
        if bad:
            raise ValueError(message)


def _signals(df: DataFrame, s: _Side, order: BarOrder, default: TradeSide, bracket: Bracket | None, cost: Cost | None, flat: bool) -> tuple[DataFrame, list[tuple[Column, str]]]:
    """df with this side's columns: entry, exit, position, side, fills and return; and the checks it needs."""
    w, upto, tests = order.w, order.upto, []
    entry, exit_ = as_condition(s.strategy.entry()), as_condition(s.strategy.exit())
    if isinstance(entry, Limit):
        raise NotImplementedError("limit entries are not supported")
    limit = exit_ if isinstance(exit_, Limit) else None
    if limit and bracket:
        raise NotImplementedError("a limit exit does not combine with a bracket")
    side = F.lit(int(entry.trade_side if entry.trade_side is not None else s.default))
    is_long = int(entry.trade_side if entry.trade_side is not None else s.default) == TradeSide.LONG
    fb, blocked = (F.col("_fb"), F.col("_blocked")) if flat else (F.lit(False), F.lit(False))

    df = df.withColumn(s.entry, entry.column(w))
    if flat:
        # An entry on a flatten bar waits for the next one; blocked bars open nothing.
        df = df.withColumn(s.entry, (F.col(s.entry) | F.coalesce(F.lag(F.col(s.entry) & fb & ~blocked).over(w), F.lit(False))) & ~blocked)
    refs = collect_entry_refs(exit_)
    if refs:
        df = with_realized(df, exit_, order, s.entry, "_fb" if flat else None, s.realized)
        df = df.withColumns({f"_entry_{r}": ffill(F.when(F.col(s.realized), F.col(r)), upto) for r in refs}).drop(s.realized)
    df = df.withColumn(s.exit, exit_.column(w))
    if flat:
        step = F.when(F.col(s.entry) & ~fb, 1).when(F.col(s.exit) | fb, 0)
    else:
        step = F.when(F.col(s.entry), 1).when(F.col(s.exit), 0)
    df = df.withColumn(s.position, F.coalesce(ffill(step, upto), F.lit(0)).cast("int"))
    lag0 = lambda c, n: F.coalesce(F.lag(c, n).over(w), F.lit(0))
    df = df.withColumns({s.d1: lag0(s.position, 1), s.d2: lag0(s.position, 2), s.pc: F.lag("close").over(w)})
    d1, d2, pc, pos = F.col(s.d1), F.col(s.d2), F.col(s.pc), F.col(s.position)
    df = df.withColumns({s.in_: (pos == 1) & (d1 == 0), s.out: (pos == 0) & (d1 == 1), s.ebar: (d1 == 1) & (d2 == 0), s.xbar: (d1 == 0) & (d2 == 1), s.side: (pos * side).cast("tinyint")})
    ebar, xbar, opened = F.col(s.ebar), F.col(s.xbar), F.col("open")

    price = F.lit(None).cast("double")
    fired = post = F.lit(False)
    if bracket:
        df = df.withColumn(s.block, F.sum(ebar.cast("int")).over(upto))
        live = (d1 == 1) & ~fb
        again = (F.col(s.entry) & (d1 == 1) & ~fb) if bracket.anchor == "signal" else F.lit(False)
        for kind, leg in bracket.legs():
            was_again = F.coalesce(F.lag(again).over(w), F.lit(False))
            if isinstance(leg, str):
                latch = F.when(F.lag(F.col(s.in_)).over(w) | was_again, F.lag(F.col(leg).cast("double")).over(w))
                tests.append((F.col(s.in_) & F.col(leg).isNull(), f"level column {leg} is null on an entry signal"))
                level = latch
            else:
                level = F.when(ebar | was_again, opened * (1 + leg * (1 if (kind == "tp") == is_long else -1)))
            df = df.withColumn(getattr(s, kind), ffill(level, upto))
        hits = {k: (F.col("high") >= F.col(getattr(s, k))) if (k == "tp") == is_long else (F.col("low") <= F.col(getattr(s, k))) for k, _ in bracket.legs()}
        fills = {k: F.greatest(opened, F.col(getattr(s, k))) if (k == "tp") == is_long else F.least(opened, F.col(getattr(s, k))) for k, _ in bracket.legs()}
        any_hit = F.lit(False)
        chosen = None
        for k, _ in bracket.legs():
            any_hit = any_hit | F.coalesce(hits[k], F.lit(False))
            chosen = F.when(hits[k], fills[k]) if chosen is None else chosen.when(hits[k], fills[k])
        df = df.withColumn(s.trigger, (live & any_hit).cast("int"))
        in_block = Window.partitionBy(*order.keys, s.block).orderBy(order.date, *([order.seq] if order.seq else []))
        df = df.withColumn(s.seen, F.sum(s.trigger).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
        first = (F.col(s.trigger) == 1) & (F.col(s.seen) == 1)
        df = df.withColumns({s.bexit: first, s.blevel: F.when(first, chosen), s.post: (F.col(s.seen) > 0) & ~first & ((d1 == 1) | xbar)})
        if bracket.anchor == "signal":
            unfired = F.col(s.seen) == 0
            tests += [(again & unfired & F.col(c).isNull(), f"level column {c} is null on a repeated entry signal") for c in bracket.level_columns()]
        fired, post = F.col(s.bexit), F.col(s.post)
        df = df.withColumn(s.out, fired | (F.col(s.out) & (F.col(s.seen) == 0)))
    limited = F.lit(False)
    if limit:
        limited = F.col(s.out) & F.coalesce(F.col(s.exit), F.lit(False)) & ~fb
        df = df.withColumns({s.lexit: limited})
        df = df.withColumn(s.lprice, F.when(F.col(s.lexit), limit.resolve_price(w).cast("double")))
        limited = F.col(s.lexit)
    c = cost.share() if cost else F.lit(0.0)
    if cost and cost.slippage_col:
        slip = F.col(cost.slippage_col)
        fill = ebar | xbar | limited | fired | (fb & (d1 == 1))
        tests.append((fill & (slip.isNull() | F.isnan(slip.cast("double")) | (slip < 0) | (F.abs(slip.cast("double")) == float("inf"))), f"{cost.slippage_col} must be finite and 0 or more on every fill"))

    div = F.try_divide
    ret = F.when(F.lit(False), F.lit(None).cast("double"))
    if bracket:
        lvl = F.col(s.blevel)
        ret = ret.when(post, 0.0).when(fired & ebar, side * div(lvl - opened, opened) - 2 * c).when(fired, side * div(lvl - pc, pc) - c)
    if limit:
        lvl = F.col(s.lprice)
        ret = ret.when(limited & ebar, side * div(lvl - opened, opened) - 2 * c).when(limited, side * div(lvl - pc, pc) - c)
        ret = ret.when(F.coalesce(F.lag(limited).over(w), F.lit(False)), 0.0)
    if flat:
        ret = F.when(F.coalesce(F.lag(fb).over(w), F.lit(False)), 0.0).otherwise(ret.when(fb & ebar, 0.0 - 2 * c).when(fb & (d1 == 1), side * div(opened - pc, pc) - c).otherwise(_held(ebar, xbar, d1, side, pc, opened, c)))
    else:
        ret = ret.otherwise(_held(ebar, xbar, d1, side, pc, opened, c))
    df = df.withColumn(s.ret, F.coalesce(ret.cast("double"), F.lit(0.0)))

    # Fills of the trade log: where a trade opens and closes, at which price, cost and bar.
    nxt = lambda x: F.lead(x).over(w)
    own = fired | limited | (fb & F.col(s.out))
    price = F.when(fired, F.col(s.blevel) if bracket else price).when(limited, F.col(s.lprice) if limit else price).when(fb, opened).otherwise(nxt("open"))
    df = df.withColumns({
        s.in_price: F.when(F.col(s.in_), nxt("open")), s.in_cost: F.when(F.col(s.in_), nxt(c)), s.in_at: F.when(F.col(s.in_), F.col("_idx") + 1),
        s.out_price: F.when(F.col(s.out), price), s.out_cost: F.when(F.col(s.out), F.when(own, c).otherwise(nxt(c))), s.out_at: F.when(F.col(s.out), F.col("_idx") + F.when(own, 0).otherwise(1)),
    })
    df = df.withColumns({s.in_k: F.sum(F.col(s.in_).cast("int")).over(upto), s.out_k: F.sum(F.col(s.out).cast("int")).over(upto)})
    return df, tests


def _held(ebar: Column, xbar: Column, d1: Column, side: Column, pc: Column, opened: Column, c: Column) -> Column:
    div = F.try_divide
    close = F.col("close")
    return F.when(ebar, side * div(close - opened, opened) - c).when(xbar, side * div(opened - pc, pc) - c).when(d1 == 1, side * (div(close, pc) - 1)).otherwise(0.0)


def _trades(df: DataFrame, s: _Side, order: BarOrder, default: int) -> DataFrame:
    keys = order.keys
    ins = df.where(F.col(s.in_)).select(*keys, F.col(s.in_k).alias("_k"), F.col(order.date).alias("entry_date"), F.col(s.in_price).alias("_ip"), F.col(s.in_cost).alias("_ic"), F.col(s.in_at).alias("_ia"))
    outs = df.where(F.col(s.out)).select(*keys, F.col(s.out_k).alias("_k"), F.col(order.date).alias("exit_date"), F.col(s.out_price).alias("_op"), F.col(s.out_cost).alias("_oc"), F.col(s.out_at).alias("_oa"))
    side = F.lit(default)
    pnl = side * (F.try_divide(F.col("_op"), F.col("_ip")) - 1) - (F.col("_ic") + F.col("_oc"))
    return ins.join(outs, [*keys, "_k"]).select(*keys, "entry_date", "exit_date", side.cast("tinyint").alias("side"), pnl.alias("pnl"), (F.col("_oa") - F.col("_ia")).cast("long").alias("bars_held"))


def _side_of(strategy: Any, default: TradeSide) -> int:
    entry = as_condition(strategy.entry())
    return int(entry.trade_side if entry.trade_side is not None else default)


def run(
    df: DataFrame,
    strategy: Any,
    *,
    short_strategy: Any = None,
    trade_side: TradeSide = TradeSide.LONG,
    calendar: Any = None,
    flatten: Any = None,
    flatten_eod: bool = False,
    cost: Cost | None = None,
    bracket: Bracket | None = None,
    bar_end_column: str | None = None,
    instrument_col: str | None = None,
    instrument_weights: Any = None,
    date_col: str = "date",
    seq_col: str | None = None,
    check: bool = True,
) -> BacktestResult | MultiBacktestResult:
    """Backtest of strategy over bars (date, open, close and what the conditions use; high and low for a bracket).

    Bars are ordered by date and, where dates repeat, by seq_col. check runs
    one aggregate over the plan for values that would give wrong numbers
    (null levels, bad slippage, overlapping sides). Without instrument_col the
    bars are one series, which Spark orders in a single task; panels spread by
    instrument.
    """
    if instrument_weights is not None and instrument_col is None:
        instrument_col = "instrument"
    if short_strategy is not None and trade_side != TradeSide.LONG:
        raise ValueError("trade_side applies to a single strategy")
    if bracket and short_strategy is not None:
        raise NotImplementedError("a bracket does not combine with short_strategy")
    schedule = resolve_flatten(flatten, flatten_eod)
    if schedule and calendar is None:
        raise ValueError("flattening needs a calendar")
    need = [date_col, "open", "close", *(["high", "low"] if bracket else []), *(bracket.level_columns() if bracket else []), *([instrument_col] if instrument_col else []), *([cost.slippage_col] if cost and cost.slippage_col else [])]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if cost and cost.slippage_col and not isinstance(df.schema[cost.slippage_col].dataType, NumericType):
        raise ValueError(f"{cost.slippage_col} must be numeric")
    order = BarOrder(date_col, instrument_col, seq_col)
    if calendar is not None:
        df = calendar.filter_market_hours(df, date_col, end_column=bar_end_column)
    given = list(df.columns)
    sides = [_Side(strategy, trade_side, "")] if short_strategy is None else [_Side(strategy, TradeSide.LONG, "_l"), _Side(short_strategy, TradeSide.SHORT, "_s")]
    for s in sides:
        if hasattr(s.strategy, "init"):
            df = s.strategy.init(df, order.w)
    df = df.withColumn("_idx", F.row_number().over(order.w) - 1)
    if schedule:
        df = flatten_masks(df, calendar, schedule, order)
    tests: list[tuple[Column, str]] = []
    for s in sides:
        df, more = _signals(df, s, order, s.default, bracket, cost, schedule is not None)
        tests += more
    if len(sides) == 2:
        tests.append(((F.col(sides[0].position) == 1) & (F.col(sides[1].position) == 1), "long and short positions overlap"))
    if check:
        _guard(df, tests)
    keys = order.keys
    refs = sorted({f"_entry_{n.name}" for s in sides for n in walk(as_condition(s.strategy.exit())) if type(n).__name__ == "EntryRef"})
    own = [c for c in df.columns if not c.startswith("_")]
    if len(sides) == 1:
        s = sides[0]
        total, trades = F.col(s.ret), _trades(df, s, order, _side_of(s.strategy, trade_side))
        shown = [F.col(s.entry), F.col(s.exit), F.col(s.position), F.col("_side")]
    else:
        a, b = sides
        total = F.col(a.ret) + F.col(b.ret)
        trades = _trades(df, a, order, _side_of(a.strategy, TradeSide.LONG)).withColumn("_leg", F.lit(0)).union(_trades(df, b, order, _side_of(b.strategy, TradeSide.SHORT)).withColumn("_leg", F.lit(1)))
        shown = [(F.col(a.entry) | F.col(b.entry)).alias("_entry"), (F.col(a.exit) | F.col(b.exit)).alias("_exit"), (F.col(a.position) + F.col(b.position)).alias("_position"), (F.col("_side_l") + F.col("_side_s")).cast("tinyint").alias("_side")]
    trades = trades.orderBy(*keys, "entry_date", *(["_leg"] if len(sides) == 2 else [])).drop("_leg")
    returns = df.select(*keys, date_col, total.alias("return"))
    signals = df.select(*[c for c in own if c in given or c not in keys], *shown, *[F.col(r) for r in refs])
    result = BacktestResult(returns, trades, signals)
    if instrument_col is None:
        return result
    weights = None
    if instrument_weights is not None:
        weights = portfolio_weights(df.sparkSession, instrument_weights)
        if check:
            lost = returns.select(F.col(instrument_col).cast("string").alias("instrument")).distinct().join(F.broadcast(weights), "instrument", "left_anti").limit(5).collect()
            if lost:
                raise ValueError(f"instruments without a weight: {', '.join(r[0] for r in lost)}")
    return MultiBacktestResult(result, instrument_col, weights)


class MacdCrossover:
    """Long from macd crossing above its signal until it crosses below."""

    def entry(self) -> Any:
        from ..functions.expr import Crossover

        return Crossover("macd", "macd_signal")

    def exit(self) -> Any:
        from ..functions.expr import Crossunder

        return Crossunder("macd", "macd_signal")


class MacdCrossoverShort:
    """Short from macd crossing below its signal until it crosses above."""

    def entry(self) -> Any:
        from ..functions.expr import Crossunder

        out = Crossunder("macd", "macd_signal")
        out.trade_side = TradeSide.SHORT
        return out

    def exit(self) -> Any:
        from ..functions.expr import Crossover

        return Crossover("macd", "macd_signal")
