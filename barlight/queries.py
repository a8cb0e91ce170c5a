"""Queries of the market-analytics engine over the test tables, with their SQL for DuckDB.

Daily bars come from lineitem (an instrument for each return flag) and from
orders; intraday bars are the ticks of events. Numbers are rounded to 9 places
on both sides, as sums may differ in the last place.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions.expr import Col, Crossover, Crossunder, EntryRef, IsFalling, IsRising, Limit, Pct, ValueGT, ValueGTE, ValueLT, ValueLTE
from .functions.simulate import Process, monte_carlo, simulate_metric
from .functions.windows import BarOrder, sma
from .operators.bars import numbered, ticks_to_ohlcv, ticks_to_time_bars
from .operators.engine import MacdCrossover, run, weighted_returns
from .operators.options import Bracket, Cost, FlattenSchedule, TradeSide, portfolio_weights
from .plans.venues import get_calendar
from .sources.treasury import MeanMethod, TreasuryRate, mean_treasury_rate, treasury_rates, treasury_spread, treasury_spread_matrix

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
ORDER = BarOrder("date", "instrument")


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Inputs.

def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, date, open, high, low, close, fast, slow, slip) by return flag and ship date."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    order = F.struct("l_orderkey", "l_linenumber", "q", "p")
    bars = t.groupBy(F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("date")).agg(F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.avg("q").alias("slip"))
    return bars.withColumns({"fast": sma(F.col("close"), 3, ORDER), "slow": sma(F.col("close"), 8, ORDER)})


_BARS = """bars AS (SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS date,
  first(CAST(l_extendedprice AS DOUBLE) ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS open, max(CAST(l_extendedprice AS DOUBLE)) AS high, min(CAST(l_extendedprice AS DOUBLE)) AS low,
  last(CAST(l_extendedprice AS DOUBLE) ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS close, avg(CAST(l_quantity AS DOUBLE)) AS slip FROM lineitem GROUP BY 1, 2),
ind AS (SELECT *, CASE WHEN count(close) OVER w3 = 3 THEN avg(close) OVER w3 END AS fast, CASE WHEN count(close) OVER w8 = 8 THEN avg(close) OVER w8 END AS slow, row_number() OVER w - 1 AS idx
  FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date), w3 AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""
_W = "WINDOW w AS (PARTITION BY instrument ORDER BY date), u AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_UP = "fast > slow AND lag(fast) OVER w <= lag(slow) OVER w"
_DOWN = "fast < slow AND lag(fast) OVER w >= lag(slow) OVER w"


class Crossing:
    """fast above slow; conditions can be replaced."""

    def __init__(self, entry: Any = None, exit: Any = None, side: TradeSide | None = None):
        self._entry, self._exit, self._side = entry or Crossover("fast", "slow"), exit or Crossunder("fast", "slow"), side

    def entry(self) -> Any:
        if self._side is not None:
            self._entry.trade_side = self._side
        return self._entry

    def exit(self) -> Any:
        return self._exit


def _sql(entry: str = _UP, exit: str = _DOWN, side: int = 1, cost: str = "0.0::double", tp: float | str | None = None, sl: float | str | None = None, stop_first: bool = True, again: bool = False, limit: str | None = None, what: str = "returns", realized: bool = False) -> str:
    """The engine's rules as SQL, written as a chain of window steps."""
    steps = [_BARS, f"sig AS (SELECT *, ({entry}) AS en, ({exit}) AS ex FROM ind {_W})" if not realized else entry]
    steps.append(f"pos AS (SELECT *, coalesce(last_value(CASE WHEN en THEN 1 WHEN ex THEN 0 END IGNORE NULLS) OVER u, 0) AS p, {cost} AS c FROM sig {_W})")
    steps.append(f"lagged AS (SELECT *, coalesce(lag(p) OVER w, 0) AS d1, coalesce(lag(p, 2) OVER w, 0) AS d2, lag(close) OVER w AS pc, lead(open) OVER w AS no, lead(c) OVER w AS nc FROM pos {_W})")
    steps.append(f"latch AS (SELECT *, coalesce(lag(en AND d1 = 1) OVER w, false) AS again FROM lagged {_W})")
    steps.append("bar AS (SELECT *, d1 = 1 AND d2 = 0 AS ebar, d1 = 0 AND d2 = 1 AS xbar, p = 1 AND d1 = 0 AS ins, p = 0 AND d1 = 1 AS outs FROM latch)")
    ladder, out, price, own, src = "", "outs", "no", "false", "bar"
    if tp is not None or sl is not None:
        base = "CASE WHEN ebar THEN open END" if not again else "CASE WHEN ebar OR again THEN open END"
        latched = "".join(f", last_value({base.replace('open', f'was_{x}')} IGNORE NULLS) OVER u AS at_{x}" for x in (tp, sl) if isinstance(x, str))
        was = "".join(f", lag({x}) OVER w AS was_{x}" for x in (tp, sl) if isinstance(x, str))
        steps.append(f"old AS (SELECT *{was} FROM bar {_W})")
        steps.append(f"blk AS (SELECT *, sum(CASE WHEN ebar THEN 1 ELSE 0 END) OVER u AS blk, last_value({base} IGNORE NULLS) OVER u AS fill{latched} FROM old {_W})")
        up = side == 1
        level = lambda x, sign: f"at_{x}" if isinstance(x, str) else f"fill * {1 + sign * x}::double"
        legs = {"sl": sl and (level(sl, -side), "low <= {0}" if up else "high >= {0}", "least(open, {0})" if up else "greatest(open, {0})"), "tp": tp and (level(tp, side), "high >= {0}" if up else "low <= {0}", "greatest(open, {0})" if up else "least(open, {0})")}
        names = [k for k in (("sl", "tp") if stop_first else ("tp", "sl")) if legs[k]]
        hit = " OR ".join(legs[k][1].format(legs[k][0]) for k in names)
        lvl = "CASE " + " ".join(f"WHEN {legs[k][1].format(legs[k][0])} THEN {legs[k][2].format(legs[k][0])}" for k in names) + " END"
        steps.append(f"hit AS (SELECT *, CASE WHEN d1 = 1 AND ({hit}) THEN 1 ELSE 0 END AS h, {lvl} AS lvl FROM blk)")
        steps.append("cnt AS (SELECT *, sum(h) OVER (PARTITION BY instrument, blk ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM hit)")
        steps.append("fin AS (SELECT *, h = 1 AND n = 1 AS fired, n > 0 AND NOT (h = 1 AND n = 1) AND (d1 = 1 OR xbar) AS post FROM cnt)")
        ladder = f"WHEN post THEN 0 WHEN fired AND ebar THEN {side} * (lvl - open) / open - 2 * c WHEN fired THEN {side} * (lvl - pc) / pc - c "
        out, price, own, src = "(fired OR (outs AND n = 0))", "CASE WHEN fired THEN lvl ELSE no END", "fired", "fin"
    if limit:
        steps.append(f"lim AS (SELECT *, outs AND coalesce(ex, false) AS le, {limit} AS lp FROM bar)")
        steps.append(f"fin AS (SELECT *, coalesce(lag(le) OVER w, false) AS after FROM lim {_W})")
        ladder = f"WHEN le AND ebar THEN {side} * (lp - open) / open - 2 * c WHEN le THEN {side} * (lp - pc) / pc - c WHEN after THEN 0 "
        price, own, src = "CASE WHEN le THEN lp ELSE no END", "le", "fin"
    if what == "position":
        return f"WITH {', '.join(steps)} SELECT instrument, date, en AS _entry, ex AS _exit, CAST(p AS INTEGER) AS _position, CAST(p * {side} AS TINYINT) AS _side FROM bar"
    if what == "returns":
        ret = f"CASE {ladder}WHEN ebar THEN {side} * (close - open) / open - c WHEN xbar THEN {side} * (open - pc) / pc - c WHEN d1 = 1 THEN {side} * (close / pc - 1) ELSE 0 END"
        return f"WITH {', '.join(steps)} SELECT instrument, date, round(coalesce({ret}, 0), 9) AS \"return\" FROM {src}"
    steps.append(f"t AS (SELECT *, {out} AS o, {price} AS op, CASE WHEN {own} THEN c ELSE nc END AS oc, idx + CASE WHEN {own} THEN 0 ELSE 1 END AS oa FROM {src})")
    steps.append("a AS (SELECT instrument, date AS entry_date, no AS ip, nc AS ic, idx + 1 AS ia, row_number() OVER (PARTITION BY instrument ORDER BY date) AS k FROM t WHERE ins)")
    steps.append("b AS (SELECT instrument, date AS exit_date, op, oc, oa, row_number() OVER (PARTITION BY instrument ORDER BY date) AS k FROM t WHERE o)")
    return f"WITH {', '.join(steps)} SELECT instrument, entry_date, exit_date, CAST({side} AS TINYINT) AS side, round({side} * (op / ip - 1) - (ic + oc), 9) AS pnl, CAST(oa - ia AS BIGINT) AS bars_held FROM a JOIN b USING (instrument, k)"


def _run(what: str, strategy: Any = None, **options: Any) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        options.setdefault("instrument_col", "instrument")
        result = run(lineitem_bars(spark, sf_dir), strategy() if strategy else Crossing(), **({"check": False} | options))
        if what == "position":
            return result.signals.select("instrument", "date", "_entry", "_exit", "_position", "_side")
        return rounded(getattr(result, what))

    return query


# Bars and conditions.

def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(F.col("event_type").alias("instrument"), "ts", "event_id", (100 + F.col("value")).alias("price"))


_add("ohlcv_daily", lambda s, d: rounded(ticks_to_time_bars(_ticks(s, d), "day", "ts", "price", "event_id", ["instrument"])),
     "SELECT event_type AS instrument, CAST(ts AS DATE) AS date, round(arg_min(100 + value, (ts, event_id)), 9) AS open, round(max(100 + value), 9) AS high, round(min(100 + value), 9) AS low, round(arg_max(100 + value, (ts, event_id)), 9) AS close, count(*) AS n_ticks FROM events GROUP BY 1, 2")
_add("ohlcv_count_bars", lambda s, d: rounded(ticks_to_ohlcv(numbered(_ticks(s, d), ["ts", "event_id"], ["instrument"]), 10, keys=["instrument"])),
     "WITH t AS (SELECT event_type AS instrument, 100 + value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events) SELECT instrument, step // 10 AS bar, round(arg_min(price, step), 9) AS open, round(max(price), 9) AS high, round(min(price), 9) AS low, round(arg_max(price, step), 9) AS close FROM t GROUP BY 1, 2 HAVING count(*) = 10")
_add("sma", lambda s, d: rounded(lineitem_bars(s, d).select("instrument", "date", "fast", "slow")), f"WITH {_BARS} SELECT instrument, date, round(fast, 9) AS fast, round(slow, 9) AS slow FROM ind")


def _condition(c: Any) -> Query:
    return lambda s, d: lineitem_bars(s, d).select("instrument", "date", c.column(ORDER.w).alias("flag"))


for _name, _cond, _text in (
    ("crossover_signals", Crossover("fast", "slow"), _UP), ("crossunder_signals", Crossunder("fast", "slow"), _DOWN),
    ("is_rising", IsRising("close", 2), "close > lag(close, 2) OVER w"), ("is_falling", IsFalling("close"), "close < lag(close) OVER w"),
    ("cond_and_or_not", (ValueGT("fast", "slow") & ~IsRising("close")) | ValueLTE("close", Col("open") * 0.9), "(fast > slow AND NOT (close > lag(close) OVER w)) OR close <= open * 0.9::double"),
    ("pct_threshold", ValueGTE("close", Pct("open", 2.5)), "close >= open * 1.025::double"), ("arithmetic", (Col("close") - Col("open")) / Col("open") > -Col("slip") % 7 / 100, "(close - open) / open > ((0 - slip) - floor((0 - slip) / 7) * 7) / 100"),
    ("value_less", ValueLT("close", "open"), "close < open"),
):
    _add(_name, _condition(_cond), f"WITH {_BARS} SELECT instrument, date, ({_text}) AS flag FROM ind {_W}")

# Positions, returns, trades.
_add("position", _run("position"), _sql(what="position"))
_add("returns_long", _run("returns"), _sql())
_add("returns_short", _run("returns", trade_side=TradeSide.SHORT), _sql(side=-1))
_add("trades", _run("trades"), _sql(what="trades"))
_add("trades_short", _run("trades", trade_side=TradeSide.SHORT), _sql(side=-1, what="trades"))
_add("returns_cost", _run("returns", cost=Cost(2, 1.5)), _sql(cost="0.00035::double"))
_add("trades_cost", _run("trades", cost=Cost(2, 1.5)), _sql(cost="0.00035::double", what="trades"))
_add("trades_slippage_col", _run("trades", cost=Cost(1, 0, "slip")), _sql(cost="(1.0::double + slip) / 1e4", what="trades"))
_add("limit_exit", _run("returns", lambda: Crossing(exit=Limit(ValueGT("high", Col("slow") * 1.2)))), _sql(exit="high > slow * 1.2::double", limit="slow * 1.2::double"))
_add("limit_exit_trades", _run("trades", lambda: Crossing(exit=Limit(ValueGT("high", Col("slow") * 1.2)))), _sql(exit="high > slow * 1.2::double", limit="slow * 1.2::double", what="trades"))
for _name, _bracket, _args in (
    ("bracket_tp", Bracket(take_profit=0.25), {"tp": 0.25}), ("bracket_sl", Bracket(stop_loss=0.2), {"sl": 0.2}), ("bracket_both_stop_first", Bracket(0.25, 0.2), {"tp": 0.25, "sl": 0.2}),
    ("bracket_both_tp_first", Bracket(0.25, 0.2, "take_profit_first"), {"tp": 0.25, "sl": 0.2, "stop_first": False}), ("bracket_anchor_signal", Bracket(0.5, 0.5, anchor="signal"), {"tp": 0.5, "sl": 0.5, "again": True}),
):
    _add(_name, _run("returns", bracket=_bracket), _sql(**_args))
    _add(f"{_name}_trades", _run("trades", bracket=_bracket), _sql(what="trades", **_args))
_add("bracket_short", _run("returns", bracket=Bracket(0.25, 0.2), trade_side=TradeSide.SHORT), _sql(tp=0.25, sl=0.2, side=-1))
# Levels from columns: the high and the low of the bar that signals, with the engine's guards.
for _name, _bracket, _args in (("bracket_columns", Bracket("high", "low"), {"tp": "high", "sl": "low"}), ("bracket_columns_signal", Bracket("high", 0.3, anchor="signal"), {"tp": "high", "sl": 0.3, "again": True})):
    _add(_name, _run("returns", bracket=_bracket, check=True), _sql(**_args))
    _add(f"{_name}_trades", _run("trades", bracket=_bracket, check=True), _sql(what="trades", **_args))

# Exits that refer to the entry: the oracle walks the bars by recursion.
_REALIZED = f"""e AS (SELECT *, coalesce(({_UP}), false) AS en0 FROM ind {_W}),
walk(instrument, idx, p, anchor) AS (SELECT instrument, idx, CASE WHEN en0 THEN 1 ELSE 0 END, CASE WHEN en0 THEN close END FROM e WHERE idx = 0
  UNION ALL SELECT e.instrument, e.idx, CASE WHEN en0 THEN 1 WHEN p = 1 AND ({{}}) THEN 0 ELSE p END, CASE WHEN en0 AND p = 0 THEN e.close ELSE anchor END FROM walk JOIN e ON e.instrument = walk.instrument AND e.idx = walk.idx + 1),
sig AS (SELECT e.*, en0 AS en, walk.p = 0 AS ex FROM e JOIN walk USING (instrument, idx))"""


def _recursive(test: str, what: str) -> str:
    return "WITH RECURSIVE" + _sql(entry=_REALIZED.format(test), realized=True, what=what).removeprefix("WITH")


_TP_SL = "e.close >= anchor * 1.02::double OR e.close <= anchor * 0.99::double"
_tp_sl = lambda: Crossing(exit=ValueGTE("close", Pct(EntryRef("close"), 2)) | ValueLTE("close", Pct(EntryRef("close"), -1)))
_add("entry_ref_tp_sl", _run("returns", _tp_sl), _recursive(_TP_SL, "returns"))
_add("entry_ref_tp_sl_trades", _run("trades", _tp_sl), _recursive(_TP_SL, "trades"))
_add("entry_ref_moving", _run("returns", lambda: Crossing(exit=ValueLT("close", EntryRef("close") - (Col("high") - Col("low")) * 0.1))), _recursive("e.close < anchor - (e.high - e.low) * 0.1::double", "returns"))

# Both sides, panels and portfolios.

def _raw(sql: str) -> str:
    """The returns of _sql before rounding."""
    return sql.replace("round(coalesce(", "(coalesce(").replace(', 0), 9) AS "return"', ', 0)) AS "return"')


_SHORT = _raw(_sql(entry=_DOWN, exit=_UP, side=-1))
_add("dual_long_short", _run("returns", short_strategy=Crossing(Crossunder("fast", "slow"), Crossover("fast", "slow"))), f'SELECT a.instrument, a.date, round(a."return" + b."return", 9) AS "return" FROM ({_raw(_sql())}) a JOIN ({_SHORT}) b USING (instrument, date)')
_add("dual_trades", _run("trades", short_strategy=Crossing(Crossunder("fast", "slow"), Crossover("fast", "slow"))), f"{_sql(what='trades')} UNION ALL ({_sql(entry=_DOWN, exit=_UP, side=-1, what='trades')})")


def _weighted(weights: dict[str, float]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = run(lineitem_bars(spark, sf_dir), Crossing(), instrument_col="instrument", check=False)
        return rounded(weighted_returns(result.returns, portfolio_weights(spark, weights)))

    return query


_WEIGHTED = 'SELECT date, round(sum("return" * weight) / sum(weight), 9) AS "return" FROM ({}) JOIN (VALUES {}) v(instrument, weight) USING (instrument) GROUP BY date'
_RAW = _raw(_sql())
_add("portfolio_weighted", _weighted({"A": 0.5, "N": 0.3, "R": 0.2}), _WEIGHTED.format(_RAW, "('A', 0.5::double), ('N', 0.3::double), ('R', 0.2::double)"))
_add("portfolio_missing_symbol", _weighted({"A": 0.6, "R": 0.4}), _WEIGHTED.format(_RAW, "('A', 0.6::double), ('R', 0.4::double)"))

# What the engine refuses, and what it lets pass.

def _guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = lineitem_bars(spark, sf_dir).withColumns({"gap": F.when(F.lit(False), F.col("open")), "below": -F.col("slip")})
    limit = Limit(ValueGT("high", Col("slow") * 1.2))
    cases: dict[str, tuple[Any, dict[str, Any]]] = {
        "level column without gaps": (Crossing(), {"bracket": Bracket("high")}), "level column with gaps": (Crossing(), {"bracket": Bracket("gap")}),
        "slippage of 0 or more": (Crossing(), {"cost": Cost(1, 0, "slip")}), "negative slippage": (Crossing(), {"cost": Cost(1, 0, "below")}), "null slippage": (Crossing(), {"cost": Cost(1, 0, "gap")}),
        "sides that exclude each other": (Crossing(), {"short_strategy": Crossing(Crossunder("fast", "slow"), Crossover("fast", "slow"))}), "sides that overlap": (Crossing(), {"short_strategy": Crossing()}),
        "limit entry": (Crossing(limit), {}), "limit exit with a bracket": (Crossing(exit=limit), {"bracket": Bracket(0.1)}), "bracket with two sides": (Crossing(), {"bracket": Bracket(0.1), "short_strategy": Crossing()}),
        "missing column": (Crossing(), {"bracket": Bracket("nowhere")}), "flattening without a calendar": (Crossing(), {"flatten_eod": True}), "weights of all": (Crossing(), {"instrument_weights": {"A": 0.5, "N": 0.3, "R": 0.2}}), "weights of some": (Crossing(), {"instrument_weights": {"A": 1.0}}),
    }
    out = []
    for name, (strategy, options) in cases.items():
        try:
            run(bars, strategy, instrument_col="instrument", **options)
            out.append((name, None))
        except (ValueError, NotImplementedError) as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "guard string, error string")


_add("engine_guards", _guards, """SELECT * FROM (VALUES ('level column without gaps', NULL), ('level column with gaps', 'ValueError'), ('slippage of 0 or more', NULL), ('negative slippage', 'ValueError'), ('null slippage', 'ValueError'),
  ('sides that exclude each other', NULL), ('sides that overlap', 'ValueError'), ('limit entry', 'NotImplementedError'), ('limit exit with a bracket', 'NotImplementedError'), ('bracket with two sides', 'NotImplementedError'),
  ('missing column', 'ValueError'), ('flattening without a calendar', 'ValueError'), ('weights of all', NULL), ('weights of some', 'ValueError')) v(guard, error)""")

# Metrics over daily changes of the mean order price, by priority.

def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("date")).agg(F.max(F.col("o_totalprice").cast("double")).alias("x"))
    # Bounded changes, so that products over thousands of days stay finite.
    return t.withColumn("was", F.lag("x").over(ORDER.w)).where("was is not null").select("instrument", "date", ((F.col("x") - F.col("was")) / (F.col("x") + F.col("was")) / 20).alias("return"))


_R = """t AS (SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS date, max(CAST(o_totalprice AS DOUBLE)) AS x FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(x) OVER (PARTITION BY instrument ORDER BY date) AS was FROM t), r AS (SELECT instrument, date, (x - was) / (x + was) / 20 AS r FROM l WHERE was IS NOT NULL),
wl AS (SELECT *, product(1 + r) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM r),
dd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM wl)"""


def _metric(name: str, column: Callable[[Column, Column], Column], text: str) -> None:
    """column gets the returns and the drawdowns."""
    _add(name, lambda s, d: rounded(M.drawdown(_returns(s, d), ORDER).groupBy("instrument").agg(column(F.col("return"), F.col("drawdown")).alias("value"))), f"WITH {_R} SELECT instrument, round({text}, 9) AS value FROM dd GROUP BY 1")



_CUM, _MDD, _N = "(product(1 + r) - 1)", "abs(min(dd))", "count(r)"
_CAGR = f"(pow(product(1 + r), 252.0::double / {_N}) - 1)"


def _register_metrics() -> None:
    wins, losses = "avg(CASE WHEN r > 0 THEN r END)", "abs(avg(CASE WHEN r < 0 THEN r END))"
    rate = "avg(CASE WHEN r > 0 THEN 1.0::double ELSE 0 END)"
    for name, column, text in (
        ("cumulative_return", lambda r, dd: M.cumulative_return(r), _CUM), ("cagr", lambda r, dd: M.cagr(r), _CAGR), ("volatility", lambda r, dd: M.volatility(r), "stddev_samp(r) * sqrt(252)"), ("max_drawdown", lambda r, dd: M.max_drawdown(dd), "min(dd)"), ("avg_drawdown", lambda r, dd: M.avg_drawdown(dd), "avg(CASE WHEN dd < 0 THEN dd END)"),
        ("sharpe", lambda r, dd: M.sharpe(r, rf=0.02), "avg(r - 0.02::double / 252) / stddev_samp(r) * sqrt(252)"), ("sortino", lambda r, dd: M.sortino(r), "avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(252)"), ("omega", lambda r, dd: M.omega(r), "sum(greatest(r, 0)) / sum(greatest(-r, 0))"),
        ("calmar", lambda r, dd: M.calmar(r, dd), f"{_CAGR} / {_MDD}"), ("romad", lambda r, dd: M.romad(r, dd), f"{_CUM} / {_MDD}"), ("var_hist", lambda r, dd: M.var_historical(r), "quantile_cont(r, 0.05)"),
        ("var_gaussian", lambda r, dd: M.var_gaussian(r, 0.05, 10), "exp(avg(ln(1 + r)) * 10 + stddev_samp(ln(1 + r)) * sqrt(10) * -1.6448536269514722::double) - 1"),
        ("cvar_gaussian", lambda r, dd: M.cvar_gaussian(r, 0.05, 10), "exp(avg(ln(1 + r)) * 10 - stddev_samp(ln(1 + r)) * sqrt(10) * 2.0627128075074284::double) - 1"),
        ("win_rate", lambda r, dd: M.win_rate(r), rate), ("payoff", lambda r, dd: M.payoff_ratio(r), f"{wins} / {losses}"), ("profit_factor", lambda r, dd: M.profit_factor(r), "sum(CASE WHEN r > 0 THEN r END) / abs(sum(CASE WHEN r < 0 THEN r END))"),
        ("kelly", lambda r, dd: M.kelly(r), f"{rate} - (1 - {rate}) / ({wins} / {losses})"),
    ):
        _metric(name, column, text)


_add("drawdown", lambda s, d: rounded(M.drawdown(_returns(s, d), ORDER).select("instrument", "date", "drawdown")), f"WITH {_R} SELECT instrument, date, round(dd, 9) AS drawdown FROM dd")
_add("cumulative_returns", lambda s, d: rounded(M.cumulative_returns(_returns(s, d), ORDER).select("instrument", "date", "cumulative")), f"WITH {_R} SELECT instrument, date, round(wealth - 1, 9) AS cumulative FROM wl")
_add("cvar_hist", lambda s, d: rounded(M.cvar_historical(_returns(s, d), keys=["instrument"])), f"WITH {_R}, q AS (SELECT instrument, quantile_cont(r, 0.05) AS q FROM r GROUP BY 1) SELECT instrument, round(avg(r), 9) AS cvar FROM r JOIN q USING (instrument) WHERE r <= q GROUP BY 1")
_ISLANDS = f"WITH {_R}, g AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY date) AS g FROM dd) SELECT instrument, max(days) AS longest_drawdown_days FROM (SELECT instrument, g, CAST(max(date) - min(date) AS BIGINT) AS days FROM g WHERE dd < 0 GROUP BY 1, 2) GROUP BY 1"
_add("longest_drawdown", lambda s, d: M.longest_drawdown_days(M.drawdown(_returns(s, d), ORDER), ORDER), _ISLANDS)
_add("monthly_returns", lambda s, d: rounded(M.period_returns(_returns(s, d), ["instrument"], "month")), f"WITH {_R} SELECT instrument, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS TINYINT) AS month, round(product(1 + r) - 1, 9) AS monthly_return FROM r GROUP BY 1, 2, 3")
_add("yearly_returns", lambda s, d: rounded(M.period_returns(_returns(s, d), ["instrument"], "year")), f"WITH {_R} SELECT instrument, CAST(year(date) AS INTEGER) AS year, round(product(1 + r) - 1, 9) AS yearly_return FROM r GROUP BY 1, 2")
_add("daily_collapse", lambda s, d: rounded(M.daily_returns(_ticks(s, d).select("instrument", F.col("ts").alias("date"), ((F.col("price") - 345) / 10000).alias("return")), ["instrument"])),
     'SELECT event_type AS instrument, CAST(ts AS DATE) AS date, round(product(1 + (100 + value - 345) / 10000) - 1, 9) AS "return" FROM events GROUP BY 1, 2')
_add("mtd_ytd_1y", lambda s, d: rounded(M.to_date_returns(_returns(s, d), ["instrument"])), f"WITH {_R}, m AS (SELECT *, max(date) OVER (PARTITION BY instrument) AS e FROM r) SELECT instrument, round(product(CASE WHEN date_trunc('month', date) = date_trunc('month', e) THEN 1 + r ELSE 1 END) - 1, 9) AS mtd, round(product(CASE WHEN year(date) = year(e) THEN 1 + r ELSE 1 END) - 1, 9) AS ytd, round(product(CASE WHEN date > e - INTERVAL 12 MONTH THEN 1 + r ELSE 1 END) - 1, 9) AS one_year FROM m GROUP BY 1")
_ROLL = f"WITH {_R} SELECT instrument, date, round(CASE WHEN count(r) OVER w = 126 THEN {{}} END, 9) AS {{}} FROM r WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"
_add("rolling_sharpe", lambda s, d: rounded(M.rolling_sharpe(_returns(s, d), ORDER).drop("return")), _ROLL.format("avg(r) OVER w / stddev_samp(r) OVER w * sqrt(252)", "rolling_sharpe"))
_add("rolling_vol", lambda s, d: rounded(M.rolling_volatility(_returns(s, d), ORDER).drop("return")), _ROLL.format("stddev_samp(r) OVER w * sqrt(252)", "rolling_volatility"))


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _returns(spark, sf_dir)
    pick = lambda name: t.where(F.col("instrument") == name)
    pair = M.align_benchmark(pick("1-URGENT"), pick("2-HIGH"))
    r, b = F.col("return"), F.col("benchmark")
    return rounded(pair.agg(M.beta(r, b).alias("beta"), M.alpha(r, b).alias("alpha"), M.r_squared(r, b).alias("r_squared"), M.information_ratio(r, b).alias("information_ratio")))


_add("beta_alpha_r2_ir", _pair, f"WITH {_R}, a AS (SELECT r, row_number() OVER (ORDER BY date) AS k FROM r WHERE instrument = '1-URGENT'), b AS (SELECT r AS b, row_number() OVER (ORDER BY date) AS k FROM r WHERE instrument = '2-HIGH') SELECT round(covar_samp(r, b) / var_samp(b), 9) AS beta, round((avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252, 9) AS alpha, round(pow(corr(r, b), 2), 9) AS r_squared, round(avg(r - b) * 252 / (stddev_samp(r - b) * sqrt(252)), 9) AS information_ratio FROM a JOIN b USING (k)")
_T = _sql(what="trades").replace("round(1 * (op / ip - 1) - (ic + oc), 9) AS pnl", "1 * (op / ip - 1) - (ic + oc) AS pnl")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lineitem_bars(spark, sf_dir), Crossing(), instrument_col="instrument", check=False).trades


_PAY = "(avg(CASE WHEN pnl > 0 THEN pnl END) / abs(avg(CASE WHEN pnl < 0 THEN pnl END)))"
_WR = "(count(CASE WHEN pnl > 0 THEN 1 END)::double / count(pnl))"
_add("trade_metrics", lambda s, d: rounded(M.trade_metrics(_trades(s, d), ["instrument"]).select("instrument", "n_trades", "win_rate", "payoff_ratio", "profit_factor", "kelly", "mean_pnl", "best", "worst", "total_pnl", "sharpe", "sortino", "avg_bars_held", "trades_per_year")),
     f"SELECT instrument, count(*) AS n_trades, round({_WR}, 9) AS win_rate, round({_PAY}, 9) AS payoff_ratio, round(sum(CASE WHEN pnl > 0 THEN pnl END) / abs(sum(CASE WHEN pnl < 0 THEN pnl END)), 9) AS profit_factor, round({_WR} - (1 - {_WR}) / {_PAY}, 9) AS kelly, round(avg(pnl), 9) AS mean_pnl, round(max(pnl), 9) AS best, round(min(pnl), 9) AS worst, round(sum(pnl), 9) AS total_pnl, round(avg(pnl) / stddev_samp(pnl), 9) AS sharpe, round(avg(pnl) / stddev_samp(CASE WHEN pnl < 0 THEN pnl END), 9) AS sortino, round(avg(exit_date - entry_date), 9) AS avg_bars_held, round(count(*) / ((max(exit_date) - min(entry_date)) / 365.25::double), 9) AS trades_per_year FROM ({_T}) GROUP BY 1")
_add("max_consecutive", lambda s, d: M.max_consecutive(_trades(s, d), BarOrder("entry_date", "instrument")),
     f"WITH t AS (SELECT *, sign(pnl) AS sg FROM ({_T})), n AS (SELECT *, CASE WHEN coalesce(lag(sg) OVER (PARTITION BY instrument ORDER BY entry_date) <> sg, true) THEN 1 ELSE 0 END AS nw FROM t), g AS (SELECT *, sum(nw) OVER (PARTITION BY instrument ORDER BY entry_date) AS g FROM n), c AS (SELECT instrument, g, sg, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT instrument, coalesce(max(CASE WHEN sg > 0 THEN n END), 0) AS max_wins, coalesce(max(CASE WHEN sg < 0 THEN n END), 0) AS max_losses FROM c GROUP BY 1")

# Calendars. The oracle has the closed weekdays of the exchange in 2024 as a list.
_CLOSED = "('2024-01-01'), ('2024-01-15'), ('2024-02-19'), ('2024-03-29'), ('2024-05-27'), ('2024-06-19'), ('2024-07-04'), ('2024-09-02'), ('2024-11-28'), ('2024-12-25')"
_SESSIONS = f"c AS (SELECT CAST(x AS DATE) AS x FROM (VALUES {_CLOSED}) v(x)), s AS (SELECT CAST(d AS DATE) AS date, CASE WHEN CAST(d AS DATE) IN (DATE '2024-07-03', DATE '2024-11-29', DATE '2024-12-24') THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END AS close FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT x FROM c))"
_add("valid_days", lambda s, d: s.createDataFrame([(x,) for x in get_calendar("XNYS").valid_days("2024-01-01", "2024-12-31")], "date date"), f"WITH {_SESSIONS} SELECT date FROM s")
_add("schedule", lambda s, d: get_calendar("XNYS").schedule_frame(s, "2024-01-01", "2024-12-31").select("date", "open_local", "close_local"), f"WITH {_SESSIONS} SELECT date, date + INTERVAL 570 MINUTE AS open_local, date + close AS close_local FROM s")
_add("early_closes", lambda s, d: get_calendar("XNYS").schedule_frame(s, "2024-01-01", "2024-12-31").where("hour(close_local) < 16").select("date", "close_local"), f"WITH {_SESSIONS} SELECT date, date + close AS close_local FROM s WHERE close < INTERVAL 16 HOUR")
_add("session_navigation", lambda s, d: s.createDataFrame([(x, get_calendar("XNYS").is_session(x), get_calendar("XNYS").next_session(x), get_calendar("XNYS").previous_session(x)) for x in (date(2024, 2, 1) + timedelta(days=i) for i in range(300))], "date date, is_session boolean, following date, preceding date"),
     f"WITH {_SESSIONS} SELECT d.date, d.date IN (SELECT date FROM s) AS is_session, (SELECT min(s.date) FROM s WHERE s.date > d.date) AS following, (SELECT max(s.date) FROM s WHERE s.date < d.date) AS preceding FROM (SELECT DATE '2024-02-01' + CAST(i AS INTEGER) AS date FROM range(300) r(i)) d")


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = get_calendar("XNYS")
    plain = lambda t: t.replace(tzinfo=None)
    times = [datetime(2024, 6, 28, 0, 15) + timedelta(hours=i) for i in range(240)]
    return spark.createDataFrame([(t, c.is_open_on_minute(t), c.minute_to_session(t), *[plain(f(t)) for f in (c.next_open, c.next_close, c.previous_open, c.previous_close)]) for t in times], "minute_at timestamp_ntz, is_open boolean, session date, next_open timestamp_ntz, next_close timestamp_ntz, previous_open timestamp_ntz, previous_close timestamp_ntz")


_add("session_minutes", _minutes, f"""WITH {_SESSIONS}, k AS (SELECT date, date + INTERVAL 570 MINUTE AS o, date + close AS c FROM s), t AS (SELECT TIMESTAMP '2024-06-28 00:15:00' + to_hours(CAST(i AS INTEGER)) AS minute_at FROM range(240) r(i))
SELECT minute_at, EXISTS (SELECT 1 FROM k WHERE o <= minute_at AND minute_at < c) AS is_open, (SELECT date FROM k WHERE o <= minute_at AND minute_at < c) AS session, (SELECT min(o) FROM k WHERE o > minute_at) AS next_open, (SELECT min(c) FROM k WHERE c > minute_at) AS next_close, (SELECT max(o) FROM k WHERE o < minute_at) AS previous_open, (SELECT max(c) FROM k WHERE c < minute_at) AS previous_close FROM t""")

# Closed weekdays and early closes of 2024 by exchange, with the minutes of the day at which it opens (of the day before, if negative) and closes.
_VENUES_2024: dict[str, tuple[int, int, str, dict[str, str]]] = {
    "XNAS": (570, 960, "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25", {"13:00": "07-03 11-29 12-24"}),
    "XCBO": (570, 975, "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25", {"13:00": "11-29"}),
    "XCME": (570, 975, "01-01 03-29 12-25", {"13:00": "01-15 02-19 05-27 07-04 09-02 11-28 11-29 12-24"}),
    "GLBX": (-360, 1020, "01-01 03-29 12-25", {"13:00": "01-15 02-19 05-27 07-04 09-02 11-28 11-29 12-24"}),
    "CMES": (-420, 1020, "", {}),
    "XLON": (480, 990, "01-01 03-29 04-01 05-06 05-27 08-26 12-25 12-26", {"12:30": "12-24 12-31"}),
    "XPAR": (540, 1050, "01-01 03-29 04-01 05-01 12-25 12-26", {"14:05": "12-24 12-31"}),
    "XETR": (540, 1050, "01-01 03-29 04-01 05-01 12-24 12-25 12-26 12-31", {"14:00": "12-30"}),
    "XTSE": (570, 960, "01-01 02-19 03-29 05-20 07-01 08-05 09-02 10-14 12-25 12-26", {"13:00": "12-24"}),
    "XTKS": (540, 900, "01-01 01-02 01-03 01-08 02-12 02-23 03-20 04-29 05-03 05-06 07-15 08-12 09-16 09-23 10-14 11-04 12-31", {}),
    "XHKG": (570, 960, "01-01 02-12 02-13 03-29 04-01 04-04 05-01 05-15 06-10 07-01 09-06 09-18 10-01 10-11 12-25 12-26", {"12:00": "02-09 12-24 12-31"}),
}


def _venue_sql(opens: int, closes: int, closed: str, early: dict[str, str]) -> str:
    days = lambda text: ", ".join(f"DATE '2024-{x}'" for x in text.split()) or "NULL"
    ends = "".join(f"WHEN date IN ({days(text)}) THEN INTERVAL '{at}:00' " for at, text in early.items())
    close = f"CASE {ends}ELSE INTERVAL {closes} MINUTE END" if ends else f"INTERVAL {closes} MINUTE"
    free = f" AND date NOT IN ({days(closed)})" if closed else ""
    return f"SELECT date, date + INTERVAL ({opens}) MINUTE AS open_local, date + {close} AS close_local FROM (SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) g(d)) WHERE isodow(date) < 6{free}"


def _venue(name: str) -> Query:
    return lambda s, d: get_calendar(name).schedule_frame(s, "2024-01-01", "2024-12-31").select("date", "open_local", "close_local")


for _name, _args in _VENUES_2024.items():
    _add(f"schedule_{_name.lower()}", _venue(_name), _venue_sql(*_args))


def _intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticks(spark, sf_dir).select("instrument", F.col("ts").alias("date"), "event_id", "price")


_I = "SELECT event_type AS instrument, ts AS date, event_id, 100 + value AS price FROM events"
_add("market_hours", lambda s, d: get_calendar("XNYS").filter_market_hours(_intraday(s, d)).select("event_id"), f"WITH {_SESSIONS} SELECT event_id FROM events JOIN s ON CAST(ts AS DATE) = s.date WHERE ts >= s.date + INTERVAL 570 MINUTE AND ts <= s.date + close - INTERVAL 1 MINUTE")
_add("market_hours_end_col", lambda s, d: get_calendar("XNYS").filter_market_hours(_intraday(s, d).withColumn("end", F.col("date") + F.expr("interval 30 minutes")), end_column="end").select("event_id"), f"WITH {_SESSIONS} SELECT event_id FROM events JOIN s ON CAST(ts AS DATE) = s.date WHERE ts >= s.date + INTERVAL 570 MINUTE AND ts + INTERVAL 30 MINUTE <= s.date + close")
_TOKYO = "('2024-01-01'), ('2024-01-02'), ('2024-01-03'), ('2024-01-08')"
_add("lunch_break_filter", lambda s, d: get_calendar("XTKS").filter_market_hours(_intraday(s, d)).select("event_id"), f"WITH c AS (SELECT CAST(x AS DATE) AS x FROM (VALUES {_TOKYO}) v(x)) SELECT event_id FROM events WHERE isodow(ts) < 6 AND CAST(ts AS DATE) NOT IN (SELECT x FROM c) AND ts >= date_trunc('day', ts) + INTERVAL 9 HOUR AND ts <= date_trunc('day', ts) + INTERVAL 899 MINUTE AND NOT (ts >= date_trunc('day', ts) + INTERVAL 690 MINUTE AND ts < date_trunc('day', ts) + INTERVAL 750 MINUTE)")
_add("trading_index", lambda s, d: get_calendar("XNYS").trading_index(s, "2024-03-04", "2024-03-15", "30 minutes").select(F.unix_seconds("time").alias("seconds")),
     f"WITH {_SESSIONS} SELECT CAST(epoch(timezone('America/New_York', t)) AS BIGINT) AS seconds FROM (SELECT unnest(generate_series(date + INTERVAL 570 MINUTE, date + close - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS t FROM s WHERE date BETWEEN DATE '2024-03-04' AND DATE '2024-03-15')")
_add("session_offset", lambda s, d: s.createDataFrame([(x, get_calendar("XNYS").session_offset(x, 3)) for x in get_calendar("XNYS").valid_days("2024-02-01", "2024-11-30")], "date date, later date"), f"WITH {_SESSIONS}, k AS (SELECT date, lead(date, 3) OVER (ORDER BY date) AS later FROM s) SELECT * FROM k WHERE date BETWEEN DATE '2024-02-01' AND DATE '2024-11-30'")


def _flatten(schedule: FlattenSchedule, what: str = "position") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = _intraday(spark, sf_dir).select("instrument", "date", "event_id", (F.col("price") + F.col("event_id") % 7).alias("open"), F.col("price").alias("close"))
        result = run(bars, Crossing(ValueGT("close", 300), ValueLT("close", 200)), calendar=get_calendar("XNYS"), flatten=schedule, instrument_col="instrument", seq_col="event_id", cost=Cost(2, 1.5), check=False)
        if what == "position":
            return result.signals.select("instrument", "event_id", "_position")
        return rounded(getattr(result, what))

    return query


def _flatten_sql(days: str, minutes: int, block: int, what: str = "position") -> str:
    c = "0.00035::double"
    return f"""WITH {_SESSIONS}, wk AS (SELECT *, date = max(date) OVER (PARTITION BY date_trunc('week', date)) AS wc FROM s),
b AS (SELECT event_type AS instrument, ts, event_id, 100 + value AS close, 100 + value + event_id % 7 AS open, wk.date AS ses, wk.date + wk.close AS cl, {days} AS pick FROM events JOIN wk ON CAST(ts AS DATE) = wk.date WHERE ts >= wk.date + INTERVAL 570 MINUTE AND ts <= wk.date + wk.close - INTERVAL 1 MINUTE),
o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts, event_id) AS idx, pick AND {"ts >= cl - INTERVAL " + str(block) + " MINUTE" if block else "false"} AS bl FROM b),
f AS (SELECT *, coalesce(idx = max(CASE WHEN pick AND ts <= cl - INTERVAL {minutes} MINUTE THEN idx END) OVER (PARTITION BY instrument, ses), false) AS fb, close > 300 AS e0, close < 200 AS ex FROM o),
d AS (SELECT *, (e0 OR coalesce(lag(e0 AND fb AND NOT bl) OVER (PARTITION BY instrument ORDER BY idx), false)) AND NOT bl AS en FROM f),
p AS (SELECT *, coalesce(last_value(CASE WHEN en AND NOT fb THEN 1 WHEN ex OR fb THEN 0 END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p FROM d),
l AS (SELECT *, coalesce(lag(p) OVER w, 0) AS d1, coalesce(lag(p, 2) OVER w, 0) AS d2, lag(close) OVER w AS pc, lead(open) OVER w AS no, coalesce(lag(fb) OVER w, false) AS after FROM p WINDOW w AS (PARTITION BY instrument ORDER BY idx)),
i AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY idx) AS k FROM l WHERE p = 1 AND d1 = 0), x AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY idx) AS k FROM l WHERE p = 0 AND d1 = 1)
""" + {
        "position": "SELECT instrument, event_id, CAST(p AS INTEGER) AS _position FROM l",
        "returns": f"""SELECT instrument, ts AS date, round(CASE WHEN after THEN 0 WHEN fb AND d1 = 1 AND d2 = 0 THEN -2 * {c} WHEN fb AND d1 = 1 THEN (open - pc) / pc - {c} WHEN d1 = 1 AND d2 = 0 THEN (close - open) / open - {c} WHEN d1 = 0 AND d2 = 1 THEN (open - pc) / pc - {c} WHEN d1 = 1 THEN close / pc - 1 ELSE 0 END, 9) AS "return" FROM l""",
        "trades": f"SELECT i.instrument, i.ts AS entry_date, x.ts AS exit_date, CAST(1 AS TINYINT) AS side, round(CASE WHEN x.fb THEN x.open ELSE x.no END / i.no - 1 - 2 * {c}, 9) AS pnl, CAST(x.idx + CASE WHEN x.fb THEN 0 ELSE 1 END - i.idx - 1 AS BIGINT) AS bars_held FROM i JOIN x USING (instrument, k)",
    }[what]


_add("flatten_eod", _flatten(FlattenSchedule("daily")), _flatten_sql("true", 0, 0))
_add("flatten_eow", _flatten(FlattenSchedule("weekly")), _flatten_sql("wc", 0, 0))
_add("flatten_offset_block", _flatten(FlattenSchedule({3, 5}, 30, 60)), _flatten_sql("isodow(wk.date) IN (3, 5)", 30, 60))
for _what in ("returns", "trades"):
    _add(f"flatten_eod_{_what}", _flatten(FlattenSchedule("daily"), _what), _flatten_sql("true", 0, 0, _what))
    _add(f"flatten_eow_{_what}", _flatten(FlattenSchedule("weekly"), _what), _flatten_sql("wc", 0, 0, _what))
    _add(f"flatten_offset_block_{_what}", _flatten(FlattenSchedule({3, 5}, 30, 60), _what), _flatten_sql("isodow(wk.date) IN (3, 5)", 30, 60, _what))

# Rates: a synthetic curve by date from orders.

def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("x"))
    at = {TreasuryRate.M3: 1, TreasuryRate.Y2: 2, TreasuryRate.Y10: 3}
    return t.select("date", *[(F.when(F.dayofmonth("date") != 13, 0.01 * at[x] + F.col("x") / 1e8) if x in at else F.lit(None).cast("double")).alias(x.column) for x in TreasuryRate])


_C = "c AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(CAST(o_totalprice AS DOUBLE)) AS x FROM orders GROUP BY 1), q AS (SELECT date, CASE WHEN day(date) <> 13 THEN 0.01::double * 1 + x / 1e8 END AS m3, CASE WHEN day(date) <> 13 THEN 0.01::double * 2 + x / 1e8 END AS y2, CASE WHEN day(date) <> 13 THEN 0.01::double * 3 + x / 1e8 END AS y10 FROM c)"
_SPAN = ("1900-01-01", "2100-12-31")  # all dates of the table
_add("treasury_rates", lambda s, d: rounded(treasury_rates(_rates(s, d), *_SPAN, TreasuryRate.M3)), f"WITH {_C} SELECT date, round(m3, 9) AS rate FROM q WHERE m3 IS NOT NULL")
_add("treasury_spread", lambda s, d: rounded(treasury_spread(_rates(s, d), *_SPAN)), f"WITH {_C} SELECT date, round(y10 - y2, 9) AS spread FROM q WHERE y10 IS NOT NULL")
_add("treasury_matrix", lambda s, d: rounded(treasury_spread_matrix(_rates(s, d), *_SPAN, [TreasuryRate.M3, TreasuryRate.Y2, TreasuryRate.Y10])), f"WITH {_C} SELECT date, round(y2 - m3, 9) AS spread_2year_3month, round(y10 - m3, 9) AS spread_10year_3month, round(y10 - y2, 9) AS spread_10year_2year FROM q")
_add("mean_rate", lambda s, d: rounded(mean_treasury_rate(_rates(s, d), *_SPAN)), f"WITH {_C} SELECT round(avg(m3), 9) AS rate FROM q")
_add("mean_rate_geo", lambda s, d: rounded(mean_treasury_rate(_rates(s, d), *_SPAN, method=MeanMethod.GEOMETRIC)), f"WITH {_C} SELECT round(exp(avg(ln(1 + m3))) - 1, 9) AS rate FROM q")


def _fallback_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over a range with rates, the last rate before a range without any, and 0 where nothing is known."""
    each = [mean_treasury_rate(_rates(spark, sf_dir), f"{a}-01-01", f"{b}-12-31").select(F.lit(n).alias("span"), "rate") for n, a, b in (("inside", 1996, 1997), ("after", 2002, 2002), ("nothing", 1980, 1981))]
    return rounded(each[0].union(each[1]).union(each[2]))


_add("fallback_rates", _fallback_rates, f"WITH {_C} SELECT 'inside' AS span, (SELECT round(avg(m3), 9) FROM q WHERE year(date) IN (1996, 1997)) AS rate UNION ALL SELECT 'after', (SELECT round(arg_max(m3, date), 9) FROM q WHERE m3 IS NOT NULL AND year(date) IN (2001, 2002)) UNION ALL SELECT 'nothing', 0.0::double")

# Simulation has no SQL counterpart; its distributions are tested.
_add("gbm", lambda s, d: monte_carlo(s, Process.GBM, 20, 253, seed=7, base=100.0, drift=0.05, vol=0.2))
_add("ou", lambda s, d: monte_carlo(s, Process.OU, 20, 253, seed=7, theta=5.0, mu=1.0, sigma=0.3))
_add("frw", lambda s, d: monte_carlo(s, Process.FRW, 20, 253, seed=7, hurst=0.7))
_add("var_mc", lambda s, d: s.createDataFrame([(m, simulate_metric(m, _returns(s, d).where("instrument = '1-URGENT'"), 2000)) for m in ("var", "cvar")], "metric string, value double"))
_register_metrics()


def _macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.windows import macd

    return rounded(run(macd(lineitem_bars(spark, sf_dir), ORDER), MacdCrossover(), instrument_col="instrument", check=False).returns)


# The three exponential means by recursion, seeded by the first close.
_MACD = f"""walk(instrument, idx, f, s, g) AS (SELECT instrument, idx, close, close, 0.0::double FROM ind WHERE idx = 0
  UNION ALL SELECT instrument, idx, f, s, g + (f - s - g) * 0.2::double FROM (SELECT i.instrument, i.idx, f + (close - f) * (2.0::double / 13) AS f, s + (close - s) * (2.0::double / 27) AS s, g FROM walk JOIN ind i ON i.instrument = walk.instrument AND i.idx = walk.idx + 1)),
sig AS (SELECT ind.*, f - s > g AND lag(f - s) OVER v <= lag(g) OVER v AS en, f - s < g AND lag(f - s) OVER v >= lag(g) OVER v AS ex FROM ind JOIN walk USING (instrument, idx) WINDOW v AS (PARTITION BY instrument ORDER BY idx))"""
_add("macd_crossover", _macd, "WITH RECURSIVE" + _sql(entry=_MACD, realized=True).removeprefix("WITH"))
