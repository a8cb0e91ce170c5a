"""Return and trade metrics as aggregate columns, usable in any groupBy().agg()."""

from __future__ import annotations

import math
from collections.abc import Callable
from enum import Enum
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import BarOrder, islands


class Metric(Enum):
    CUMULATIVE_RETURN = "cumulative_return"
    CAGR = "cagr"
    VOLATILITY = "volatility"
    MAX_DRAWDOWN = "max_drawdown"
    AVG_DRAWDOWN = "avg_drawdown"
    LONGEST_DRAWDOWN = "longest_drawdown_days"
    SHARPE = "sharpe"
    SORTINO = "sortino"
    CALMAR = "calmar"
    ROMAD = "romad"
    OMEGA = "omega"
    VAR = "var"
    CVAR = "cvar"
    WIN_RATE = "win_rate"
    PAYOFF_RATIO = "payoff_ratio"
    PROFIT_FACTOR = "profit_factor"
    KELLY = "kelly"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _over(a: Column, b: Column, none: Column | None = None) -> Column:
    """a / b, or `none` (0 by default) where b is 0 or missing."""
    return F.when((b == 0) | b.isNull() | a.isNull(), F.lit(0.0) if none is None else none).otherwise(F.try_divide(a, b))


def cumulative_return(r: Column, compounded: bool = True) -> Column:
    return _zero(F.product(1 + r) - 1 if compounded else F.sum(r))


def cagr(r: Column, ppy: float = 252, compounded: bool = True) -> Column:
    total, n = cumulative_return(r, compounded), F.count(r)
    return F.when((n == 0) | (total <= -1), 0.0).otherwise(F.pow(F.greatest(1 + total, F.lit(0.0)), F.try_divide(F.lit(float(ppy)), n)) - 1)


def volatility(r: Column, ppy: float = 252) -> Column:
    return _zero(F.stddev_samp(r)) * math.sqrt(ppy)


def sharpe(r: Column, ppy: float = 252, rf: float = 0.0) -> Column:
    return F.when(F.count(r) < 2, 0.0).otherwise(_over(F.avg(r - rf / ppy), F.stddev_samp(r)) * math.sqrt(ppy))


def sortino(r: Column, ppy: float = 252, rf: float = 0.0) -> Column:
    x = r - rf / ppy
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))
    return F.when(F.count(r) < 2, 0.0).otherwise(_over(F.avg(x), down) * math.sqrt(ppy))


def omega(r: Column, ppy: float = 252, rf: float = 0.0) -> Column:
    x = r - rf / ppy
    gain, loss = F.sum(F.greatest(x, F.lit(0.0))), F.sum(F.greatest(-x, F.lit(0.0)))
    return _over(gain, loss, F.when(gain > 0, float("inf")).otherwise(0.0))


def max_drawdown(dd: Column) -> Column:
    return _zero(F.min(dd))


def avg_drawdown(dd: Column) -> Column:
    return _zero(F.avg(F.when(dd < 0, dd)))


def calmar(r: Column, dd: Column, ppy: float = 252, compounded: bool = True) -> Column:
    return _over(cagr(r, ppy, compounded), F.abs(F.min(dd)))


def romad(r: Column, dd: Column, compounded: bool = True) -> Column:
    return _over(cumulative_return(r, compounded), F.abs(F.min(dd)))


def var_historical(r: Column, alpha: float = 0.05) -> Column:
    return _zero(F.percentile(r, alpha))


def _moments(r: Column) -> tuple[Column, Column]:
    log = F.log1p(r)
    return F.avg(log), _zero(F.stddev_samp(log))


def var_gaussian(r: Column, alpha: float = 0.05, horizon: int = 1) -> Column:
    """Quantile of the horizon's return if log returns are normal."""
    mean, std = _moments(r)
    return _zero(F.expm1(mean * horizon + std * math.sqrt(horizon) * NormalDist().inv_cdf(alpha)))


def cvar_gaussian(r: Column, alpha: float = 0.05, horizon: int = 1) -> Column:
    mean, std = _moments(r)
    tail = NormalDist().pdf(NormalDist().inv_cdf(alpha)) / alpha
    return _zero(F.expm1(mean * horizon - std * math.sqrt(horizon) * tail))


def cvar_historical(df: DataFrame, r: str = "return", alpha: float = 0.05, keys: list[str] | None = None, name: str = "cvar") -> DataFrame:
    """(keys, name): mean of the returns at or below the quantile; two aggregations, joined on the keys."""
    keys = keys or []
    level = df.groupBy(*keys).agg(F.percentile(r, alpha).alias("_level"))
    joined = df.join(F.broadcast(level), keys) if keys else df.crossJoin(F.broadcast(level))
    tail = F.avg(F.when(F.col(r) <= F.col("_level"), F.col(r)))
    return joined.groupBy(*keys).agg(F.coalesce(tail, F.max("_level"), F.lit(0.0)).alias(name))


def win_rate(r: Column) -> Column:
    return _zero(F.avg((r > 0).cast("double")))


def payoff_ratio(r: Column) -> Column:
    return _over(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r))))


def profit_factor(r: Column) -> Column:
    gain, loss = _zero(F.sum(F.when(r > 0, r))), _zero(F.abs(F.sum(F.when(r < 0, r))))
    return _over(gain, loss, F.when(gain > 0, float("inf")).otherwise(0.0))


def kelly(r: Column) -> Column:
    win, payoff = win_rate(r), payoff_ratio(r)
    return F.when(payoff == 0, 0.0).otherwise(win - F.try_divide(1 - win, payoff))


def drawdown(df: DataFrame, order: BarOrder, r: str = "return", compounded: bool = True, name: str = "drawdown") -> DataFrame:
    """df with the wealth's fall from its highest value so far; the start's capital is no such value."""
    wealth = F.product(1 + F.col(r)).over(order.upto) if compounded else 1 + F.sum(r).over(order.upto)
    df = df.withColumn("_wealth", wealth)
    return df.withColumn(name, F.try_divide(F.col("_wealth"), F.max("_wealth").over(order.upto)) - 1).drop("_wealth")


def cumulative_returns(df: DataFrame, order: BarOrder, r: str = "return", compounded: bool = True, name: str = "cumulative") -> DataFrame:
    out = F.product(1 + F.col(r)).over(order.upto) - 1 if compounded else F.sum(r).over(order.upto)
    return df.withColumn(name, out)


def rolling_volatility(df: DataFrame, order: BarOrder, r: str = "return", n: int = 126, ppy: float = 252, name: str = "rolling_volatility") -> DataFrame:
    w = order.last(n)
    return df.withColumn(name, F.when(F.count(r).over(w) == n, F.stddev_samp(r).over(w) * math.sqrt(ppy)))


def rolling_sharpe(df: DataFrame, order: BarOrder, r: str = "return", n: int = 126, ppy: float = 252, name: str = "rolling_sharpe") -> DataFrame:
    w = order.last(n)
    return df.withColumn(name, F.when(F.count(r).over(w) == n, F.try_divide(F.avg(r).over(w), F.stddev_samp(r).over(w)) * math.sqrt(ppy)))


def longest_drawdown_days(df: DataFrame, order: BarOrder, dd: str = "drawdown") -> DataFrame:
    """(keys, longest_drawdown_days): days from the first to the last date of the longest run below the peak."""
    runs = islands(df, F.col(dd) < 0, order).groupBy(*order.keys, "island").agg(F.datediff(F.max(order.date), F.min(order.date)).alias("days"))
    longest = runs.groupBy(*order.keys).agg(F.max("days").alias("days"))
    if not order.keys:
        return longest.select(F.coalesce("days", F.lit(0)).cast("long").alias("longest_drawdown_days"))
    return df.select(*order.keys).distinct().join(longest, order.keys, "left").select(*order.keys, F.coalesce("days", F.lit(0)).cast("long").alias("longest_drawdown_days"))


def max_consecutive(df: DataFrame, order: BarOrder, pnl: str = "pnl") -> DataFrame:
    """(keys, max_wins, max_losses): longest runs of wins and of losses; a zero ends both."""
    sign = F.signum(F.col(pnl))
    runs = df.withColumn("_sign", sign).withColumn("_new", F.when(F.coalesce(F.lag("_sign").over(order.w) != F.col("_sign"), F.lit(True)), 1).otherwise(0))
    runs = runs.withColumn("_run", F.sum("_new").over(order.upto)).groupBy(*order.keys, "_run", "_sign").agg(F.count("*").alias("n"))
    return runs.groupBy(*order.keys).agg(F.coalesce(F.max(F.when(F.col("_sign") > 0, F.col("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(F.col("_sign") < 0, F.col("n"))), F.lit(0)).alias("max_losses"))


def period_returns(df: DataFrame, keys: list[str], by: str, r: str = "return", date: str = "date", compounded: bool = True) -> DataFrame:
    """(keys, year[, month], <by>ly_return) with by = month or year."""
    parts = [F.year(date).alias("year"), *([F.month(date).cast("tinyint").alias("month")] if by == "month" else [])]
    return df.groupBy(*keys, *parts).agg(cumulative_return(F.col(r), compounded).alias(f"{by}ly_return"))


def daily_returns(df: DataFrame, keys: list[str] | None = None, r: str = "return", date: str = "date") -> DataFrame:
    """(keys, date, return): returns compounded within each day; a null return is an error."""
    strict = F.when(F.col(r).isNull(), F.raise_error(F.lit("a return is null")).cast("double")).otherwise(F.col(r))
    return df.groupBy(*(keys or []), F.to_date(date).alias("date")).agg((F.product(1 + strict) - 1).alias("return"))


def to_date_returns(df: DataFrame, keys: list[str], r: str = "return", date: str = "date") -> DataFrame:
    """(keys, mtd, ytd, one_year): compounded returns of the last date's month, year, and the twelve months before it."""
    if keys:
        last = df.withColumn("_last", F.max(date).over(Window.partitionBy(*keys)))
    else:
        last = df.crossJoin(F.broadcast(df.agg(F.max(date).alias("_last"))))
    within = lambda test: _zero(F.product(F.when(test, 1 + F.col(r)).otherwise(F.lit(1.0))) - 1)
    d, end = F.col(date), F.col("_last")
    return last.groupBy(*keys).agg(within(F.trunc(d, "month") == F.trunc(end, "month")).alias("mtd"), within(F.year(d) == F.year(end)).alias("ytd"), within(F.to_date(d) > F.add_months(end, -12)).alias("one_year"))


def beta(r: Column, b: Column) -> Column:
    return F.when(F.count(r) < 2, 0.0).otherwise(_over(F.covar_samp(r, b), F.var_samp(b)))


def alpha(r: Column, b: Column, ppy: float = 252, rf: float = 0.0) -> Column:
    """Annual mean return beyond what beta explains."""
    return (F.avg(r) - rf / ppy - beta(r, b) * (F.avg(b) - rf / ppy)) * ppy


def r_squared(r: Column, b: Column) -> Column:
    flat = (F.stddev_samp(r) == 0) | (F.stddev_samp(b) == 0)
    return _zero(F.when(~flat, F.pow(F.corr(r, b), 2)))


def information_ratio(r: Column, b: Column, ppy: float = 252) -> Column:
    return _over(F.avg(r - b) * ppy, F.stddev_samp(r - b) * math.sqrt(ppy))


def align_benchmark(returns: DataFrame, benchmark: DataFrame, date: str = "date", r: str = "return") -> DataFrame:
    """(date, return, benchmark): rows paired by position, up to the shorter one, not by date."""
    w = Window.orderBy(date)
    a = returns.select(date, r, F.row_number().over(w).alias("_k"))
    b = benchmark.select(F.col(r).alias("benchmark"), F.row_number().over(w).alias("_k"))
    return a.join(b, "_k").drop("_k")


def metric_columns(ppy: float = 252, rf: float = 0.0, compounded: bool = True, alpha: float = 0.05, r: str = "return", dd: str = "drawdown") -> list[Column]:
    """All metrics that one aggregation gives, named by Metric; dd as by drawdown()."""
    x, d = F.col(r), F.col(dd)
    made: list[tuple[Metric, Column]] = [
        (Metric.CUMULATIVE_RETURN, cumulative_return(x, compounded)), (Metric.CAGR, cagr(x, ppy, compounded)), (Metric.VOLATILITY, volatility(x, ppy)), (Metric.MAX_DRAWDOWN, max_drawdown(d)),
        (Metric.AVG_DRAWDOWN, avg_drawdown(d)), (Metric.SHARPE, sharpe(x, ppy, rf)), (Metric.SORTINO, sortino(x, ppy, rf)), (Metric.CALMAR, calmar(x, d, ppy, compounded)), (Metric.ROMAD, romad(x, d, compounded)),
        (Metric.OMEGA, omega(x, ppy, rf)), (Metric.VAR, var_historical(x, alpha)), (Metric.WIN_RATE, win_rate(x)), (Metric.PAYOFF_RATIO, payoff_ratio(x)), (Metric.PROFIT_FACTOR, profit_factor(x)), (Metric.KELLY, kelly(x)),
    ]
    return [c.alias(m.value) for m, c in made]


def calculate_metrics(df: DataFrame, order: BarOrder, **options: float) -> DataFrame:
    """(keys, every Metric), one row per instrument."""
    df = drawdown(df, order, compounded=bool(options.get("compounded", True)))
    every = df.groupBy(*order.keys).agg(*metric_columns(**options))
    parts = [cvar_historical(df, alpha=options.get("alpha", 0.05), keys=order.keys), longest_drawdown_days(df, order)]
    for p in parts:
        every = every.join(p, order.keys, "left") if order.keys else every.crossJoin(F.broadcast(p))
    return every


def calculate_metric(metric: Metric, df: DataFrame, order: BarOrder | None, **options: float) -> float:
    """One metric of one series; the longest drawdown needs an order with dates."""
    if order is None:
        if metric is Metric.LONGEST_DRAWDOWN:
            raise ValueError("the longest drawdown needs dates")
        order = BarOrder()
    return calculate_metrics(df, order, **options).first()[metric.value]


_TRADE: dict[str, Callable[[Column], Column]] = {"mean_pnl": F.avg, "best": F.max, "worst": F.min}


def trade_metrics(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, 17 trade metrics): profits of trades with a known pnl, durations of all; no losses give infinite ratios."""
    keys = keys or []
    raw = F.col("pnl")
    p = F.when(raw.isNotNull() & ~F.isnan(raw), raw)
    days = F.datediff("exit_date", "entry_date")
    n, wins, losses = F.count(p), F.count(F.when(p > 0, p)), F.count(F.when(p < 0, p))
    mean_win, mean_loss = F.avg(F.when(p > 0, p)), F.abs(F.avg(F.when(p < 0, p)))
    payoff = F.when(wins == 0, 0.0).when(losses == 0, float("inf")).otherwise(F.try_divide(mean_win, mean_loss))
    factor = F.when(losses == 0, F.when(wins > 0, float("inf")).otherwise(0.0)).otherwise(F.try_divide(_zero(F.sum(F.when(p > 0, p))), F.abs(F.sum(F.when(p < 0, p)))))
    rate = _over(wins.cast("double"), n.cast("double"))
    span = F.datediff(F.max("exit_date"), F.min("entry_date"))
    per_year = _over(F.count("*").cast("double"), span / F.lit(365.25))
    agg = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), rate.alias("win_rate"), payoff.alias("payoff_ratio"), factor.alias("profit_factor"),
        F.when((payoff == 0) | (payoff == float("inf")), rate).otherwise(rate - F.try_divide(1 - rate, payoff)).alias("kelly"),
        *[_zero(f(p)).alias(name) for name, f in _TRADE.items()], _zero(mean_win).alias("mean_win"), _zero(-mean_loss).alias("mean_loss"), _zero(F.sum(p)).alias("total_pnl"),
        F.when(n < 2, 0.0).otherwise(_over(F.avg(p), F.stddev_samp(p))).alias("sharpe"), F.when(losses < 2, 0.0).otherwise(_over(F.avg(p), F.stddev_samp(F.when(p < 0, p)))).alias("sortino"),
        _zero(F.avg(days)).alias("avg_bars_held"), F.coalesce(F.max(days), F.lit(0)).alias("longest_trade"), F.coalesce(F.min(days), F.lit(0)).alias("shortest_trade"), per_year.alias("trades_per_year"),
    )
    return agg
