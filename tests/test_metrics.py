"""Edge values of metrics, rates, simulation, reports and streaming."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlight.functions import metrics as M
from barlight.functions.simulate import Innovations, Process, fitted_paths, monte_carlo, percentile_bands, simulate_metric
from barlight.functions.windows import BarOrder, sma
from barlight.operators.bars import ticks_to_ohlcv
from barlight.operators.reports import MonteCarloConfig, coerce_returns, format_value, html
from barlight.sources import treasury as T
from barlight.streaming.ticks import tick_bars


def series(spark, values):
    return spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "date date, return double")


def value(spark, values, f):
    return series(spark, values).agg(f(F.col("return"))).first()[0]


def ratios(x):
    """Omega, payoff ratio, profit factor and Kelly share of a series, written out with numpy."""
    won, lost = x[x > 0], -x[x < 0]
    payoff = won.mean() / lost.mean()
    chance = len(won) / (len(won) + len(lost))
    return won.sum() / lost.sum(), payoff, won.sum() / lost.sum(), chance - (1 - chance) / payoff


@pytest.mark.parametrize("seed", range(3))
def test_ratios_and_drawdowns_of_random_series(spark, seed):
    x = np.random.default_rng(seed).normal(0.001, 0.02, 40)
    r = x.tolist()
    assert [value(spark, r, f) for f in (M.omega, M.payoff_ratio, M.profit_factor, M.kelly)] == pytest.approx(ratios(x))
    wealth = np.cumprod(1 + x)
    want = wealth / np.maximum.accumulate(wealth) - 1
    falls = M.drawdown(series(spark, r), BarOrder())
    assert [f.drawdown for f in falls.orderBy("date").collect()] == pytest.approx(want.tolist())
    assert falls.agg(M.avg_drawdown(F.col("drawdown"))).first()[0] == pytest.approx(want[want < 0].mean())


def test_empty_and_flat(spark):
    for f in (M.cumulative_return, M.cagr, M.volatility, M.sharpe, M.sortino, M.omega, M.var_historical, M.win_rate, M.payoff_ratio, M.kelly, M.profit_factor):
        assert value(spark, [], f) == 0, f
    assert value(spark, [0.01], M.sharpe) == 0 and value(spark, [0.01] * 3, M.sharpe) == pytest.approx(0, abs=1e30)
    assert value(spark, [0.01, 0.02], M.omega) == math.inf and value(spark, [0.01, 0.02], M.profit_factor) == math.inf
    assert value(spark, [-1.0, 0.5], M.cagr) == 0
    with pytest.raises(ValueError):
        M.calculate_metric(M.Metric.LONGEST_DRAWDOWN, series(spark, [0.1]), None)
    all_of = M.calculate_metrics(series(spark, [0.01, -0.02, 0.03, -0.04, 0.01]), BarOrder()).first().asDict()
    assert set(all_of) == {m.value for m in M.Metric} and all_of["cvar"] <= all_of["var"]


def test_trades(spark):
    x = np.random.default_rng(7).normal(0.002, 0.03, 25)
    rows = [(date(2024, 1, 1) + timedelta(days=i), date(2024, 1, 3) + timedelta(days=i + i % 4), 1, p, 1) for i, p in enumerate(x.tolist())]
    t = spark.createDataFrame(rows, "entry_date date, exit_date date, side int, pnl double, bars_held long")
    m = M.trade_metrics(t).first()
    _, payoff, factor, kelly = ratios(x)
    assert (m.payoff_ratio, m.profit_factor, m.kelly, m.mean_pnl, m.avg_bars_held) == pytest.approx((payoff, factor, kelly, x.mean(), np.mean([(r[1] - r[0]).days for r in rows])))
    assert M.trade_metrics(t.where("pnl > 0")).first().profit_factor == math.inf and M.trade_metrics(t.where("pnl < 0")).first().payoff_ratio == 0


def test_ticks(spark):
    ticks = spark.range(105).select(F.col("id").alias("step"), (F.col("id") * 1.0).alias("price"))
    assert ticks_to_ohlcv(ticks, 10).count() == 10 and ticks_to_ohlcv(ticks.where("step < 31"), 10, volume=True).count() == 3
    with pytest.raises(ValueError):
        ticks_to_ohlcv(ticks, 0)
    with pytest.raises(ValueError):
        ticks_to_ohlcv(ticks, 5, "none")
    s = ticks.withColumnRenamed("step", "date").select("date", sma(F.col("price"), 3, BarOrder("date")).alias("m")).orderBy("date").take(4)
    assert [r.m for r in s] == [None, None, 1.0, 2.0]


def test_rates(spark, tmp_path):
    xml = '<feed xmlns="a"><entry><content><m:properties xmlns:m="b" xmlns:d="c"><d:NEW_DATE>2024-01-02T00:00:00</d:NEW_DATE><d:BC_3MONTH>5.40</d:BC_3MONTH><d:BC_10YEAR/></m:properties></content></entry></feed>'
    rows = T.parse_feed(xml)
    assert rows == [{"date": date(2024, 1, 2), "BC_3MONTH": pytest.approx(0.054)}]
    folder = str(tmp_path / "rates")
    T.save_year(folder, 2024, [*rows, {"date": date(2024, 1, 3), "BC_3MONTH": 0.05, "BC_10YEAR": 0.04}])
    rates = T.load_rates(spark, folder)
    assert len(rates.columns) == 16 and rates.count() == 2
    assert T.risk_free_rate(rates, "2024-01-01", "2024-01-31") == pytest.approx(0.052) and T.risk_free_rate(rates, "2024-06-01", "2024-06-30") == pytest.approx(0.05) and T.risk_free_rate(rates, "2030-01-01", "2030-02-01") == 0
    assert T.treasury_rates(rates, "2024-01-01", "2024-01-31", T.TreasuryRate.Y10).count() == 1 and T.treasury_rates(rates, "2024-01-01", "2024-01-31", T.TreasuryRate.Y5).count() == 0
    assert T.treasury_spread_matrix(rates, "2024-01-01", "2024-01-31").columns[1] == "spread_1_5month_1month"
    assert T.schema_matrix(rates).count() == 2 and not T.is_stale(f"{folder}/2024.csv", 2024, date(2026, 1, 1))
    T.clear_cache(folder)
    assert T.load_rates(spark, folder).count() == 0


def test_simulation(spark):
    a = monte_carlo(spark, Process.GBM, 400, 253, seed=1, drift=0.1, vol=0.2)
    log = F.log(F.col("price") / 100)
    end = a.where("step = 252").agg(F.avg(log), F.stddev(log)).first()
    assert end[0] == pytest.approx(0.08, abs=0.04) and end[1] == pytest.approx(0.2, abs=0.03)
    assert sorted(a.repartition(3).collect()) == sorted(monte_carlo(spark, Process.GBM, 400, 253, seed=1, drift=0.1, vol=0.2).collect())
    ou = monte_carlo(spark, Process.OU, 300, 400, seed=2, theta=20.0, mu=1.0, sigma=0.5, x0=1.0).where("step = 399").agg(F.avg("value"), F.stddev("value")).first()
    assert ou[0] == pytest.approx(1, abs=0.03) and ou[1] == pytest.approx(0.5 / math.sqrt(40), abs=0.02)
    walk = monte_carlo(spark, Process.FRW, 300, 65, seed=3, hurst=0.8).where("step = 64").agg(F.stddev("price")).first()[0]
    assert walk == pytest.approx(64**0.8, rel=0.2)
    with pytest.raises(NotImplementedError):
        monte_carlo(spark, Process.OU, 1, 5, innovations=Innovations.STUDENT_T)
    r = series(spark, [0.01, -0.01, 0.02, -0.015, 0.003] * 20)
    for kind in Innovations:
        assert fitted_paths(r, 50, 5, innovations=kind).where("step = 0").agg(F.max("price")).first()[0] == 1.0
    assert simulate_metric("cvar", r, 500) <= simulate_metric("var", r, 500) < 0
    assert percentile_bands(fitted_paths(r, 50, 5)).count() == 6


def test_reports(spark, tmp_path):
    r = pd.Series([0.01, -0.02, 0.03] * 60)
    assert coerce_returns(spark, r).count() == 180
    trades = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 3), 0.02), (date(2024, 1, 5), date(2024, 1, 9), -0.01)], "entry_date date, exit_date date, pnl double")
    out = tmp_path / "report.html"
    page = html(spark, r, benchmark=r * 0.5, trades=trades, output=str(out), mc=MonteCarloConfig(50, 5), extra_metrics={"mine": math.inf})
    assert out.read_text() == page and "∞" in page and page.count("<svg") >= 9 and "beta" in page
    assert format_value(None) == "—" and html(spark, r, template=lambda t, b: t) == "Strategy report"


def test_stream(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(id * 10) ts, id seq, cast(id as double) price from range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = tick_bars(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n_ticks for r in spark.table("bars").collect()) == [6] * 5
