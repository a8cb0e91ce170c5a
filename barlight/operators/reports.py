"""Summary reports: metrics of a return series, and an HTML page drawn with inline SVG.

Everything is aggregated in Spark; only rows of the size of the report (bins,
months, points of a line) reach the driver.
"""

from __future__ import annotations

import html as _html
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, TimestampNTZType, TimestampType

from ..functions import metrics as M
from ..functions.simulate import Innovations, fitted_paths, percentile_bands
from ..functions.windows import BarOrder


@dataclass(frozen=True)
class ReportConfig:
    title: str = "Strategy report"
    periods_per_year: float = 252
    compounded: bool = True
    rf: float = 0.0
    rolling: int = 126


@dataclass(frozen=True)
class MonteCarloConfig:
    n_simulations: int = 10_000
    horizon: int = 21
    alpha: float = 0.05
    seed: int = 0
    innovations: Innovations = Innovations.GAUSSIAN
    max_paths: int = 500


@dataclass(frozen=True)
class DrawdownInfo:
    depth: float
    date: Any
    longest_days: int


@dataclass(frozen=True)
class MetricsResult:
    values: dict[str, Any]
    drawdown: DrawdownInfo
    trades: dict[str, Any] | None = None
    monte_carlo: dict[str, float] | None = None
    extra: dict[str, Any] = field(default_factory=dict)


def coerce_returns(spark: SparkSession, data: Any) -> DataFrame:
    """(date, return) by day of a DataFrame, pandas frame or pandas series: the first date-like and the first floating column.

    A series without dates gets business days from 2000-01-03.
    """
    if isinstance(data, pd.Series):
        if not isinstance(data.index, pd.DatetimeIndex):
            data = data.set_axis(pd.bdate_range("2000-01-03", periods=len(data)))
        data = pd.DataFrame({"date": data.index.to_pydatetime(), "return": data.to_numpy(dtype=float)})
    if isinstance(data, pd.DataFrame):
        if isinstance(data.index, pd.DatetimeIndex) and not any(pd.api.types.is_datetime64_any_dtype(t) for t in data.dtypes):
            data = data.rename_axis("date").reset_index()
        data = spark.createDataFrame(data)
    dates = [f.name for f in data.schema if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]
    floats = [f.name for f in data.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    if not dates or not floats:
        raise ValueError("returns need a date and a floating column")
    return M.daily_returns(data.select(F.col(dates[0]).alias("date"), F.col(floats[0]).cast("double").alias("return")))


def metrics(spark: SparkSession, returns: Any, benchmark: Any = None, trades: DataFrame | None = None, config: ReportConfig = ReportConfig(), mc: MonteCarloConfig | None = None) -> MetricsResult:
    """Every metric of a return series, with those against a benchmark, of trades, and simulated ones if asked for."""
    daily, order = coerce_returns(spark, returns), BarOrder()
    options = {"ppy": config.periods_per_year, "rf": config.rf, "compounded": config.compounded}
    values = M.calculate_metrics(daily, order, **options).crossJoin(M.to_date_returns(daily, [])).first().asDict()
    falls = M.drawdown(daily, order, compounded=config.compounded)
    low = falls.agg(F.min_by("date", F.struct("drawdown", "date"))).first()[0]
    values |= {"gaussian_var": daily.agg(M.var_gaussian(F.col("return"))).first()[0], "gaussian_cvar": daily.agg(M.cvar_gaussian(F.col("return"))).first()[0]}
    if benchmark is not None:
        pair = M.align_benchmark(daily, coerce_returns(spark, benchmark))
        r, b, ppy = F.col("return"), F.col("benchmark"), config.periods_per_year
        values |= pair.agg(M.beta(r, b).alias("beta"), M.alpha(r, b, ppy, config.rf).alias("alpha"), M.r_squared(r, b).alias("r_squared"), M.information_ratio(r, b, ppy).alias("information_ratio")).first().asDict()
    info = DrawdownInfo(values["max_drawdown"], low, values["longest_drawdown_days"])
    of_trades = M.trade_metrics(trades).first().asDict() if trades is not None else None
    return MetricsResult(values, info, of_trades, _simulated(daily, mc) if mc else None)


def _simulated(daily: DataFrame, mc: MonteCarloConfig) -> dict[str, float]:
    ends = fitted_paths(daily, mc.n_simulations, mc.horizon, mc.seed, innovations=mc.innovations).where(F.col("step") == mc.horizon).select((F.col("price") - 1).alias("return"))
    return {"mc_var": ends.agg(F.percentile("return", mc.alpha)).first()[0], "mc_cvar": M.cvar_historical(ends, alpha=mc.alpha).first()[0]}


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n").orderBy("bin")


def monthly_matrix(daily: DataFrame, compounded: bool = True) -> DataFrame:
    """A row for each year with columns 1 to 12; null for months without returns."""
    by_month = M.period_returns(daily, [], "month", compounded=compounded)
    return by_month.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("monthly_return")).orderBy("year")


def format_value(x: Any) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "—"
    if isinstance(x, float) and math.isinf(x):
        return "∞" if x > 0 else "-∞"
    return f"{x:.4f}" if isinstance(x, float) else str(x)


_W, _H = 640, 180


def _svg(body: str, title: str) -> str:
    return f'<figure><figcaption>{_html.escape(title)}</figcaption><svg viewBox="0 0 {_W} {_H}" width="100%" role="img" aria-label="{_html.escape(title)}">{body}</svg></figure>'


def line_chart(points: list[tuple[Any, float | None]], title: str, fill: bool = False) -> str:
    known = [(i, y) for i, (_, y) in enumerate(points) if y is not None and math.isfinite(y)]
    if not known:
        return _svg("", title)
    low, high = min(y for _, y in known), max(y for _, y in known)
    place = [f"{_W * i / max(1, len(points) - 1):.1f},{_H - 4 - (_H - 8) * (y - low) / ((high - low) or 1):.1f}" for i, y in known]
    area = f'<polygon fill="#c9d8ee" points="0,4 {" ".join(place)} {_W},4"/>' if fill else ""
    return _svg(f'{area}<polyline fill="none" stroke="#2a5ea8" points="{" ".join(place)}"/>', title)


def bar_chart(bars: list[tuple[str, float]], title: str) -> str:
    top = max((abs(y) for _, y in bars), default=0) or 1
    step, zero = _W / max(1, len(bars)), _H / 2 if any(y < 0 for _, y in bars) else _H - 4
    span = zero - 4
    return _svg("".join(f'<rect x="{i * step:.1f}" y="{zero - max(y, 0) / top * span:.1f}" width="{step * 0.8:.1f}" height="{abs(y) / top * span:.1f}" fill="{"#2a5ea8" if y >= 0 else "#b8433a"}"><title>{_html.escape(name)}: {y:.4g}</title></rect>' for i, (name, y) in enumerate(bars)), title)


def scatter_chart(points: list[tuple[Any, float]], title: str) -> str:
    top = max((abs(y) for _, y in points), default=0) or 1
    return _svg("".join(f'<circle cx="{_W * i / max(1, len(points) - 1):.1f}" cy="{_H / 2 - y / top * (_H / 2 - 4):.1f}" r="1.5" fill="#2a5ea8"/>' for i, (_, y) in enumerate(points)), title)


def heatmap(rows: list[tuple], title: str) -> str:
    cell = lambda v: "<td></td>" if v is None else f'<td style="background:{"#dbe9d8" if v >= 0 else "#f1d9d6"}">{v:.2%}</td>'
    head = "".join(f"<th>{m}</th>" for m in range(1, 13))
    return f"<table><caption>{title}</caption><tr><th></th>{head}</tr>" + "".join(f"<tr><th>{r[0]}</th>{''.join(map(cell, r[1:]))}</tr>" for r in rows) + "</table>"


def bands_chart(paths: DataFrame, mc: MonteCarloConfig) -> str:
    rows = percentile_bands(paths, mc.alpha).collect()
    out = "".join(line_chart([(r["step"], r[c]) for r in rows], f"Simulated paths, {c}") for c in ("low", "median", "high"))
    some = paths.where(F.col("simulation") < mc.max_paths).groupBy("simulation").agg(F.max_by("price", "step").alias("end"))
    return out + scatter_chart([(r["simulation"], r["end"] - 1) for r in some.orderBy("simulation").collect()], "Ends of sampled paths")


def html(spark: SparkSession, returns: Any, benchmark: Any = None, trades: DataFrame | None = None, output: str | None = None, config: ReportConfig = ReportConfig(), mc: MonteCarloConfig | None = None, extra_metrics: dict[str, Any] | None = None, extra_charts: list[str] | None = None, template: Callable[[str, str], str] | None = None) -> str:
    """The report as a page; written to output if given. template(title, body) replaces the page around the body."""
    daily, order = coerce_returns(spark, returns).cache(), BarOrder()
    result = metrics(spark, daily, benchmark, trades, config, mc)
    line = lambda df, c: [(r[0], r[1]) for r in df.select("date", c).orderBy("date").collect()]
    ppy, n = config.periods_per_year, config.rolling
    bins = lambda df, c, k: [(f"{r.low:.4f}", float(r.n)) for r in histogram(df, c, k).collect()]
    charts = [
        line_chart(line(M.cumulative_returns(daily, order, compounded=config.compounded), "cumulative"), "Cumulative return"),
        line_chart(line(M.drawdown(daily, order, compounded=config.compounded), "drawdown"), "Drawdown", fill=True),
        bar_chart([(str(r.year), r.yearly_return) for r in M.period_returns(daily, [], "year", compounded=config.compounded).orderBy("year").collect()], "Return by year"),
        heatmap([tuple(r) for r in monthly_matrix(daily, config.compounded).collect()], "Return by month"),
        line_chart(line(M.rolling_sharpe(daily, order, n=n, ppy=ppy), "rolling_sharpe"), "Rolling Sharpe ratio"),
        line_chart(line(M.rolling_volatility(daily, order, n=n, ppy=ppy), "rolling_volatility"), "Rolling volatility"),
        scatter_chart(line(daily, "return"), "Daily returns"),
        bar_chart(bins(daily, "return", 50), "Distribution of returns"),
    ]
    if mc:
        charts.append(bands_chart(fitted_paths(daily, mc.n_simulations, mc.horizon, mc.seed, innovations=mc.innovations), mc))
    if trades is not None:
        charts += [bar_chart(bins(trades.where("pnl <> 0"), "pnl", 30), "Distribution of trade profits"), scatter_chart([(r[0], r[1]) for r in trades.where("pnl is not null").select("exit_date", "pnl").orderBy("exit_date").collect()], "Trade profits")]
    cards = {"Returns": result.values, "Drawdown": asdict(result.drawdown), "Trades": result.trades, "Simulation": result.monte_carlo, "More": extra_metrics}
    table = lambda v: "".join(f"<tr><td>{_html.escape(k)}</td><td>{_html.escape(format_value(x))}</td></tr>" for k, x in v.items())
    body = "".join(f"<section><h2>{name}</h2><table>{table(v)}</table></section>" for name, v in cards.items() if v) + "".join(charts + (extra_charts or []))
    page = template(config.title, body) if template else f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{_html.escape(config.title)}</title></head><body><h1>{_html.escape(config.title)}</h1>{body}</body></html>'
    daily.unpersist()
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(page)
    return page
