"""Hand-computed bars, a bar-by-bar loop as a second engine, and independence of partitioning."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.functions.expr import Col, Crossover, Crossunder, EntryRef, Limit, Pct, ValueGT, ValueGTE, ValueLTE
from barlight.operators.engine import MultiBacktestResult, run
from barlight.operators.options import Bracket, Cost, FlattenSchedule, InvalidPortfolioWeights, TradeSide, portfolio_weights, resolve_flatten
from barlight.plans.artifact import combined_strategy_artifact, strategy_artifact
from barlight.plans.venues import get_calendar
from barlight.queries import Crossing


def frame(spark, rows, names="date date, open double, high double, low double, close double, fast double, slow double"):
    return spark.createDataFrame(rows, names)


def daily(spark):
    fast, slow = [1, 1, 3, 3, 3, 1, 1, 1], [2] * 8
    opens, closes = [100, 101, 102, 103.5, 105, 103, 99.5, 101], [101, 102, 103, 105, 104, 100, 99, 102]
    rows = [(date(2024, 1, 1) + timedelta(days=i), float(o), max(o, c) + 1.0, min(o, c) - 1.0, float(c), float(f), float(s)) for i, (o, c, f, s) in enumerate(zip(opens, closes, fast, slow))]
    return frame(spark, rows)


def random_bars(spark, n=160, seed=3, name=None):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    opens = close * np.exp(rng.normal(0, 0.01, n))
    high, low = np.maximum(opens, close) * 1.01, np.minimum(opens, close) * 0.99
    fast, slow = (np.array([np.nan if i < k - 1 else close[i - k + 1 : i + 1].mean() for i in range(n)]) for k in (3, 8))
    rows = [(date(2024, 1, 1) + timedelta(days=i), float(opens[i]), float(high[i]), float(low[i]), float(close[i]), None if math.isnan(fast[i]) else float(fast[i]), None if math.isnan(slow[i]) else float(slow[i])) for i in range(n)]
    return rows


def loop(rows, exit_at, side=1, cost=0.0, tp=None, sl=None):
    """Returns and trades by walking the bars; exit_at(i, entry signal bar) tells whether the exit fires."""
    n = len(rows)
    o, h, l, c, f, s = ([r[k] for r in rows] for k in range(1, 7))
    entry = [i > 0 and None not in (f[i], s[i], f[i - 1], s[i - 1]) and f[i] > s[i] and f[i - 1] <= s[i - 1] for i in range(n)]
    returns, trades, held, want, opened, signal, stopped = [0.0] * n, [], False, False, None, None, False
    for i in range(n):
        wanted = want
        if wanted and not held:
            held, fill, opened, stopped, ref = True, o[i], i, False, o[i]
            returns[i] = side * (c[i] - o[i]) / o[i] - cost
        elif held and not wanted:
            held = False
            if not stopped:
                returns[i] = side * (o[i] - c[i - 1]) / c[i - 1] - cost
                trades.append((signal, i - 1, side * (o[i] / fill - 1) - 2 * cost, i - opened))
        elif held and not stopped:
            returns[i] = side * (c[i] / c[i - 1] - 1)
        if held and not stopped and (tp or sl):
            up, down = fill * (1 + side * tp) if tp else None, fill * (1 - side * sl) if sl else None
            hit = None
            if down is not None and (l[i] <= down if side > 0 else h[i] >= down):
                hit = min(o[i], down) if side > 0 else max(o[i], down)
            elif up is not None and (h[i] >= up if side > 0 else l[i] <= up):
                hit = max(o[i], up) if side > 0 else min(o[i], up)
            if hit is not None:
                stopped = True
                base = o[i] if i == opened else c[i - 1]
                returns[i] = side * (hit - base) / base - (2 * cost if i == opened else cost)
                trades.append((signal, i, side * (hit / fill - 1) - 2 * cost, i - opened))
        if entry[i]:
            if not want:
                signal = i
            want = True
        elif want and exit_at(i, signal):
            want = False
            if i == n - 1 and held and not stopped:
                trades.append((signal, i, None, n - opened))
    return returns, trades


def crossed_down(rows):
    return lambda i, _: None not in (rows[i][5], rows[i][6], rows[i - 1][5], rows[i - 1][6]) and rows[i][5] < rows[i][6] and rows[i - 1][5] >= rows[i - 1][6]


def compare(result, rows, expected):
    got = [r["return"] for r in result.returns.orderBy("date").collect()]
    assert got == pytest.approx(expected[0], abs=1e-12)
    days = [r[0] for r in rows]
    trades = [(days.index(t.entry_date), days.index(t.exit_date), t.pnl, t.bars_held) for t in result.trades.orderBy("entry_date").collect()]
    assert [t[:2] + t[3:] for t in trades] == [t[:2] + t[3:] for t in expected[1]]
    assert [t[2] for t in trades] == pytest.approx([t[2] for t in expected[1]])


def test_eight_bars(spark):
    result = run(daily(spark), Crossing())
    got = [r["return"] for r in result.returns.orderBy("date").collect()]
    assert got == pytest.approx([0, 0, 0, (105 - 103.5) / 103.5, 104 / 105 - 1, 100 / 104 - 1, (99.5 - 100) / 100, 0])
    (trade,) = result.trades.collect()
    assert (trade.entry_date, trade.exit_date, trade.side, trade.bars_held) == (date(2024, 1, 3), date(2024, 1, 6), 1, 3)
    assert trade.pnl == pytest.approx(99.5 / 103.5 - 1)
    assert [r._position for r in result.signals.orderBy("date").collect()] == [0, 0, 1, 1, 1, 0, 0, 0]


def test_edges(spark):
    bars = daily(spark)
    assert run(bars.where("date <= '2024-01-03'"), Crossing()).trades.count() == 0
    last = run(bars.where("date <= '2024-01-06'"), Crossing()).trades.collect()
    assert len(last) == 1 and last[0].pnl is None
    assert run(bars.limit(0), Crossing()).returns.count() == 0
    assert [r["return"] for r in run(bars.where("date = '2024-01-01'"), Crossing()).returns.collect()] == [0.0]


@pytest.mark.parametrize("side", [1, -1])
@pytest.mark.parametrize("levels", [(None, None), (0.03, None), (None, 0.02), (0.03, 0.02)])
def test_loop_agrees(spark, side, levels):
    rows = random_bars(spark)
    tp, sl = levels
    bracket = Bracket(tp, sl) if tp or sl else None
    result = run(frame(spark, rows), Crossing(), trade_side=TradeSide(side), cost=Cost(3, 2), bracket=bracket)
    compare(result, rows, loop(rows, crossed_down(rows), side, 0.0005, tp, sl))


def test_entry_ref_agrees(spark):
    rows = random_bars(spark, 300, 9)
    exit_ = ValueGTE("close", Pct(EntryRef("close"), 3)) | ValueLTE("close", EntryRef("close") - (Col("high") - Col("low")))
    test = lambda i, j: rows[i][4] >= rows[j][4] * 1.03 or rows[i][4] <= rows[j][4] - (rows[i][2] - rows[i][3])
    compare(run(frame(spark, rows), Crossing(exit=exit_)), rows, loop(rows, test))
    crossing = ValueGTE("close", Pct(EntryRef("close"), 3)) | Crossunder("fast", "slow")
    down = crossed_down(rows)
    compare(run(frame(spark, rows), Crossing(exit=crossing)), rows, loop(rows, lambda i, j: rows[i][4] >= rows[j][4] * 1.03 or down(i, j)))


def test_panel_equals_single_runs_whatever_the_partitions(spark):
    parts = [frame(spark, random_bars(spark, 80, seed)).withColumn("instrument", F.lit(f"I{seed}")) for seed in (1, 2, 3)]
    panel = parts[0].union(parts[1]).union(parts[2])
    single = {f"I{seed}": sorted(map(tuple, run(p.drop("instrument"), Crossing(), bracket=Bracket(0.03)).returns.collect())) for seed, p in zip((1, 2, 3), parts)}
    for n in (1, 7):
        result = run(panel.orderBy(F.rand(n)).repartition(n), Crossing(), bracket=Bracket(0.03), instrument_col="instrument")
        assert isinstance(result, MultiBacktestResult) and result.symbols == ["I1", "I2", "I3"] and len(result) == 3
        for name, one in result.items():
            assert sorted(map(tuple, one.returns.collect())) == single[name]
    weighted = run(panel, Crossing(), instrument_weights={"I1": 1, "I2": 1, "I3": 2}).returns
    assert weighted.columns == ["date", "return"] and weighted.count() == 80
    with pytest.raises(ValueError, match="without a weight"):
        run(panel, Crossing(), instrument_weights={"I1": 1})


def test_options_are_checked(spark):
    bars = daily(spark)
    with pytest.raises(NotImplementedError):
        run(bars, Crossing(entry=Limit(ValueGT("close", "open"))))
    with pytest.raises(NotImplementedError):
        run(bars, Crossing(exit=Limit(ValueGT("close", "open"))), bracket=Bracket(0.1))
    with pytest.raises(ValueError):
        run(bars, Crossing(), short_strategy=Crossing(), trade_side=TradeSide.SHORT)
    with pytest.raises(ValueError, match="overlap"):
        run(bars, Crossing(), short_strategy=Crossing())
    with pytest.raises(ValueError, match="calendar"):
        run(bars, Crossing(), flatten="eod")
    with pytest.raises(ValueError, match="null on an entry"):
        run(bars.withColumn("lvl", F.lit(None).cast("double")), Crossing(), bracket=Bracket(take_profit="lvl"))
    with pytest.raises(ValueError, match="slip"):
        run(bars.withColumn("slip", F.lit(-1.0)), Crossing(), cost=Cost(slippage_col="slip"))
    for bad in (dict(), dict(take_profit=-1), dict(take_profit=True), dict(stop_loss=math.inf)):
        with pytest.raises(ValueError):
            Bracket(**bad)
    with pytest.raises(ValueError):
        Cost(-1)
    with pytest.raises(ValueError):
        resolve_flatten("eod", True)
    for bad in ({}, {"A": -1}, {"A": math.nan}, {"A": 0}):
        with pytest.raises(InvalidPortfolioWeights):
            portfolio_weights(spark, bad)
    with pytest.raises(TypeError):
        portfolio_weights(spark, [1])


def test_limit_fills_on_its_own_bar(spark):
    result = run(daily(spark), Crossing(exit=Limit(ValueGTE("high", Col("slow") * 52.7))))
    (trade,) = result.trades.collect()
    assert trade.pnl == pytest.approx(105.4 / 103.5 - 1)
    got = [r["return"] for r in result.returns.orderBy("date").collect()]
    assert got[3] == pytest.approx((105.4 - 103.5) / 103.5) and got[4] == 0


def test_flatten_holds_nothing_over_the_close(spark):
    start = datetime(2024, 11, 27, 9, 30)
    rows = [(start + timedelta(minutes=30 * i), 100.0 + i % 5, 100.0 + i % 7) for i in range(48 * 6)]
    bars = spark.createDataFrame(rows, "date timestamp_ntz, open double, close double")
    result = run(bars, Crossing(ValueGT("close", 100), ValueGT(0, 1)), calendar=get_calendar("NYSE"), flatten=FlattenSchedule("daily", 30))
    rows = result.signals.orderBy("date").collect()
    last = {}
    for r in rows:
        last[r.date.date()] = r
    assert date(2024, 11, 28) not in last and last[date(2024, 11, 29)].date.hour == 12
    assert all(r._position == 0 for r in last.values() if r.date.time() <= (datetime(2024, 1, 1, 15, 30)).time())


def test_artifacts():
    a, b = strategy_artifact(Crossing()), strategy_artifact(Crossing(Crossover("slow", "fast")))
    assert a == strategy_artifact(Crossing()) and a != b and len(a) == 16
    assert combined_strategy_artifact(Crossing(), Crossing()) != a
