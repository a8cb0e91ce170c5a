"""Exchange calendars: rules on the driver, and sessions joined to bars as a small table.

A schedule has about 250 rows a year, so it is computed in Python for the
range of dates asked for and broadcast. It holds each time twice: as an
instant, and as the exchange's wall clock for bars without a zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, time, timedelta
from functools import cached_property
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

Day = date | str
ONE = timedelta(days=1)
#: First and last year that a calendar's cache key covers.
KEY_YEARS = (1970, 2069)


def parse_date(x: Day) -> date:
    return date.fromisoformat(x) if isinstance(x, str) else x.date() if isinstance(x, datetime) else x


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar (Gauss)."""
    k = year // 100
    m = (15 - (13 + 8 * k) // 25 + k - k // 4) % 30
    a = year % 19
    d = (19 * a + m) % 30
    d -= d == 29 or d == 28 and a > 10
    full = date(year, 3, 21) + timedelta(days=d)
    return full + timedelta(days=6 - full.weekday() if full.weekday() < 6 else 7)


def good_friday(year: int) -> date:
    return easter(year) - 2 * ONE


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th given weekday (0 is Monday) of a month, or with -1 the last."""
    if n < 0:
        last = date(year + month // 12, month % 12 + 1, 1) - ONE
        return last - timedelta(days=(last.weekday() - weekday) % 7)
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def weekday_before(d: date) -> date:
    """Last Monday-to-Friday day before d."""
    return d - timedelta(days={0: 3, 6: 2}.get(d.weekday(), 1))


def nearest_workday(d: date) -> date:
    return d + timedelta(days={5: -1, 6: 1}.get(d.weekday(), 0))


def sunday_to_monday(d: date) -> date:
    return d + timedelta(days=d.weekday() == 6)


def weekend_to_monday(d: date) -> date:
    return d + timedelta(days={5: 2, 6: 1}.get(d.weekday(), 0))


def previous_friday(d: date) -> date:
    return d - timedelta(days=(d.weekday() - 4) % 7)


def _yearly(of_year: Callable[[int], date | None], start: date, end: date, move: Callable[[date], date] | None = None) -> Iterator[date]:
    """Dates of a function of the year from start to end, moved if need be; a move can cross into a neighbouring year."""
    for year in range(start.year - 1, end.year + 2):
        if (d := of_year(year)) and start <= (d := move(d) if move else d) <= end:
            yield d


@dataclass(frozen=True)
class HolidayRule:
    """A fixed (month, day) or the n-th weekday of a month, in a range of years, moved by an observance."""

    name: str
    month: int
    day: int | None = None
    weekday: int | None = None
    week: int | None = None
    start_year: int | None = None
    end_year: int | None = None
    observance: Callable[[date], date] | None = None

    def raw_date(self, year: int) -> date | None:
        if self.start_year and year < self.start_year or self.end_year and year > self.end_year:
            return None
        return date(year, self.month, self.day) if self.day else nth_weekday(year, self.month, self.weekday, self.week)

    def dates_in_range(self, start: date, end: date) -> list[date]:
        return list(_yearly(self.raw_date, start, end, self.observance))


@dataclass(frozen=True)
class AdhocClosure:
    name: str
    dates: tuple[date, ...]


@dataclass(frozen=True)
class EarlyClose:
    """Days with another close, by a rule, a function of the year, or dates."""

    name: str
    close: time
    rule: HolidayRule | None = None
    compute_fn: Callable[[int], date | None] | None = None
    dates: tuple[date, ...] = ()

    def dates_in_range(self, start: date, end: date) -> list[date]:
        own = [d for d in self.dates if start <= d <= end]
        return own + (self.rule.dates_in_range(start, end) if self.rule else []) + (list(_yearly(self.compute_fn, start, end)) if self.compute_fn else [])


def holiday_eve(month: int, day: int) -> Callable[[int], date | None]:
    """Day before a holiday that falls on Tuesday to Friday."""
    return lambda year: weekday_before(d) if 1 <= (d := date(year, month, day)).weekday() <= 4 else None


def fixed_date_if_weekday(month: int, day: int, *, start_year: int = 0) -> Callable[[int], date | None]:
    return lambda year: d if year >= start_year and (d := date(year, month, day)).weekday() < 5 else None


def day_after(rule: HolidayRule) -> Callable[[int], date | None]:
    return lambda year: d + ONE if (d := rule.raw_date(year)) else None


def last_weekday_before(month: int, day: int, *, year_offset: int = 0) -> Callable[[int], date]:
    return lambda year: weekday_before(date(year + year_offset, month, day))


@dataclass(frozen=True)
class MarketDailySchedule:
    date: date
    market_open: datetime
    market_close: datetime
    break_start: datetime | None = None
    break_end: datetime | None = None


@dataclass(frozen=True, eq=False)
class ExchangeCalendar:
    """An exchange's sessions. open_offset -1 opens on the day before; a break closes it in between."""

    name: str
    open_time: time
    close_time: time
    zone: str
    rules: tuple[HolidayRule, ...] = ()
    adhoc_closures: tuple[AdhocClosure, ...] = ()
    early_closes: tuple[EarlyClose, ...] = ()
    special_closures: Callable[[int], Iterable[date]] | None = None
    exclusions: frozenset[date] = frozenset()
    open_offset: int = 0
    break_start: time | None = None
    break_end: time | None = None
    _memo: dict = field(default_factory=dict, repr=False)

    @cached_property
    def cache_key(self) -> str:
        """Digest of the hours and of every closed and short day of KEY_YEARS: what functions give counts, not where they are."""
        from .artifact import text_digest

        start, end = date(KEY_YEARS[0], 1, 1), date(KEY_YEARS[1], 12, 31)
        early = sorted((d.isoformat(), str(e.close)) for e in self.early_closes for d in e.dates_in_range(start, end))
        closed = sorted(d.isoformat() for d in self._closed(start, end))
        hours = [str(t) for t in (self.open_time, self.close_time, self.break_start, self.break_end)]
        return text_digest([self.name, self.zone, hours, self.open_offset, closed, early])

    def _closed(self, start: date, end: date) -> set[date]:
        found = {d for r in self.rules for d in r.dates_in_range(start, end)}
        found |= {d for c in self.adhoc_closures for d in c.dates}
        if self.special_closures:
            found |= {d for y in range(start.year, end.year + 1) for d in self.special_closures(y)}
        return found - self.exclusions

    def valid_days(self, start: Day, end: Day) -> list[date]:
        start, end = parse_date(start), parse_date(end)
        if start > end:
            return []
        closed = self._closed(start, end)
        days = (start + timedelta(days=i) for i in range((end - start).days + 1))
        return [d for d in days if d.weekday() < 5 and d not in closed]

    def is_session(self, day: Day) -> bool:
        d = parse_date(day)
        if d.year not in self._memo:
            self._memo[d.year] = frozenset(self.valid_days(date(d.year, 1, 1), date(d.year, 12, 31)))
        return d in self._memo[d.year]

    def schedule(self, start: Day, end: Day) -> list[MarketDailySchedule]:
        start, end = parse_date(start), parse_date(end)
        early = {d: e.close for e in self.early_closes for d in e.dates_in_range(start, end)}
        zone = ZoneInfo(self.zone)
        at = lambda d, t: datetime.combine(d, t, zone) if t else None
        return [MarketDailySchedule(d, at(d + self.open_offset * ONE, self.open_time), at(d, early.get(d, self.close_time)), at(d, self.break_start), at(d, self.break_end)) for d in self.valid_days(start, end)]

    def get_schedule(self, day: Day) -> MarketDailySchedule | None:
        d = parse_date(day)
        return next(iter(self.schedule(d, d)), None)

    def _walk(self, d: date, step: int) -> date:
        d += step * ONE
        while not self.is_session(d):
            d += step * ONE
        return d

    def next_session(self, day: Day) -> date:
        return self._walk(parse_date(day), 1)

    def previous_session(self, day: Day) -> date:
        return self._walk(parse_date(day), -1)

    def session_offset(self, day: Day, n: int) -> date:
        d = self.date_to_session(day)
        for _ in range(abs(n)):
            d = self._walk(d, 1 if n > 0 else -1)
        return d

    def date_to_session(self, day: Day, direction: str = "none") -> date:
        if direction not in ("none", "next", "previous"):
            raise ValueError(f"unknown direction {direction!r}")
        d = parse_date(day)
        if self.is_session(d):
            return d
        if direction == "none":
            raise ValueError(f"{d} is not a session")
        return self._walk(d, 1 if direction == "next" else -1)

    def sessions_in_range(self, start: Day, end: Day) -> int:
        return len(self.valid_days(start, end))

    def _aware(self, t: datetime) -> datetime:
        return t.replace(tzinfo=ZoneInfo(self.zone)) if t.tzinfo is None else t.astimezone(ZoneInfo(self.zone))

    def _near(self, t: datetime) -> list[MarketDailySchedule]:
        """Sessions from some before to some after t, enough for any holiday gap."""
        return self.schedule(t.date() - 20 * ONE, t.date() + 20 * ONE)

    def minute_to_session(self, t: datetime, direction: str = "none") -> date | None:
        t = self._aware(t)
        for s in self._near(t):
            if s.market_open <= t < s.market_close:
                return s.date
        if direction == "none":
            return None
        if direction == "next":
            return next(s.date for s in self._near(t) if s.market_open > t)
        if direction == "previous":
            return next(s.date for s in reversed(self._near(t)) if s.market_close <= t)
        raise ValueError(f"unknown direction {direction!r}")

    def is_open_on_minute(self, t: datetime) -> bool:
        t = self._aware(t)
        return any(s.market_open <= t < s.market_close and not (s.break_start and s.break_start <= t < s.break_end) for s in self._near(t))

    def next_open(self, t: datetime) -> datetime:
        t = self._aware(t)
        return next(s.market_open for s in self._near(t) if s.market_open > t)

    def next_close(self, t: datetime) -> datetime:
        t = self._aware(t)
        return next(s.market_close for s in self._near(t) if s.market_close > t)

    def previous_open(self, t: datetime) -> datetime:
        t = self._aware(t)
        return next(s.market_open for s in reversed(self._near(t)) if s.market_open < t)

    def previous_close(self, t: datetime) -> datetime:
        t = self._aware(t)
        return next(s.market_close for s in reversed(self._near(t)) if s.market_close < t)

    # Bulk forms.

    def schedule_frame(self, spark: SparkSession, start: Day, end: Day) -> DataFrame:
        """(date, market_open, market_close, *_local, break_start, break_end, week_close): instants, and wall clocks as local."""
        rows = self.schedule(start, end)
        # A week's last session may lie beyond the range, so the calendar is asked, not the rows.
        last = [r.date.isocalendar()[:2] != self.next_session(r.date).isocalendar()[:2] for r in rows]
        naive = lambda t: t.replace(tzinfo=None) if t else None
        utc = lambda t: t.astimezone(ZoneInfo("UTC")) if t else None
        data = [(r.date, utc(r.market_open), utc(r.market_close), naive(r.market_open), naive(r.market_close), utc(r.break_start), utc(r.break_end), naive(r.break_start), naive(r.break_end), w) for r, w in zip(rows, last, strict=True)]
        return spark.createDataFrame(data, "date date, market_open timestamp, market_close timestamp, open_local timestamp_ntz, close_local timestamp_ntz, break_start timestamp, break_end timestamp, break_start_local timestamp_ntz, break_end_local timestamp_ntz, week_close boolean")

    def _times(self, df: DataFrame, column: str) -> tuple[str, str, str, str]:
        """Names of the schedule's columns on the side of df's time column: instants or wall clocks."""
        if isinstance(df.schema[column].dataType, TimestampType):
            return "market_open", "market_close", "break_start", "break_end"
        return "open_local", "close_local", "break_start_local", "break_end_local"

    def session_table(self, df: DataFrame, column: str) -> DataFrame:
        """Sessions around df's dates: (_session, _open, _close, _break_start, _break_end, _week_close)."""
        low, high, rows = df.agg(F.min(column), F.max(column), F.count("*")).first()
        if low is None and rows:
            raise ValueError(f"every value of {column} is null")
        low, high = (parse_date(x) if x is not None else date(1970, 1, 2) for x in (low, high))
        o, c, b, e = self._times(df, column)
        table = self.schedule_frame(df.sparkSession, low - 7 * ONE, high + 7 * ONE)
        return table.select(F.col("date").alias("_session"), F.col(o).alias("_open"), F.col(c).alias("_close"), F.col(b).alias("_break_start"), F.col(e).alias("_break_end"), F.col("week_close").alias("_week_close"))

    def with_session(self, df: DataFrame, column: str, sessions: DataFrame) -> DataFrame:
        """df with _session, _open, _close and _week_close of the session that holds each time; null outside.

        Sessions do not overlap. They are joined on each calendar day that
        they touch, an equi join with a broadcast table, and then by interval.
        """
        if isinstance(df.schema[column].dataType, DateType):
            return df.join(F.broadcast(sessions.drop("_break_start", "_break_end")), F.col(column) == F.col("_session"), "left")
        days = sessions.withColumn("_day", F.explode(F.sequence(F.to_date("_open"), F.to_date("_close")))).drop("_break_start", "_break_end")
        t = F.col(column)
        inside = (F.to_date(t) == F.col("_day")) & (t >= F.col("_open")) & (t < F.col("_close"))
        return df.join(F.broadcast(days), inside, "left").drop("_day")

    def filter_market_hours(self, df: DataFrame, date_column: str = "date", end_column: str | None = None) -> DataFrame:
        """Bars within their own date's session: open <= t <= close less a minute, or up to an end time within the close.

        A bar whose time or end is null goes; if all times are null, that is an error. Bars that start in a break go.
        Bars of whole days stay if the day is a session.
        """
        sessions = self.session_table(df, date_column)
        t = F.col(date_column)
        if isinstance(df.schema[date_column].dataType, DateType):
            return df.join(F.broadcast(sessions.select("_session")), t == F.col("_session"), "left_semi")
        upper: Column = F.col(end_column) <= F.col("_close") if end_column else t <= F.col("_close") - F.make_dt_interval(mins=F.lit(1))
        keep = (F.to_date(t) == F.col("_session")) & (t >= F.col("_open")) & upper
        if self.break_start:
            keep = keep & ~((t >= F.col("_break_start")) & (t < F.col("_break_end")))
        return df.join(F.broadcast(sessions), keep, "left_semi")

    def trading_index(self, spark: SparkSession, start: Day, end: Day, period: str = "1 minute", closed: str = "left") -> DataFrame:
        """(time): stamps of each session, its parts around a break one by one; closed: left, right, both or none."""
        if closed not in ("left", "right", "both", "none"):
            raise ValueError(f"unknown closed {closed!r}")
        table = self.schedule_frame(spark, start, end)
        parts = F.array(F.struct(F.col("market_open").alias("a"), F.col("market_close").alias("b")))
        if self.break_start:
            parts = F.array(F.struct(F.col("market_open").alias("a"), F.col("break_start").alias("b")), F.struct(F.col("break_end").alias("a"), F.col("market_close").alias("b")))
        rows = table.select(F.explode(parts).alias("p")).select("p.a", "p.b").where("a <= b")
        stamps = rows.select("a", "b", F.explode(F.sequence("a", "b", F.expr(f"interval {period}"))).alias("time"))
        if closed in ("right", "none"):
            stamps = stamps.where("time > a")
        if closed in ("left", "none"):
            stamps = stamps.where("time < b")
        return stamps.select("time").orderBy("time")
