"""The registered exchanges and their holidays."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, time, timedelta

from .calendar import (
    ONE,
    AdhocClosure,
    EarlyClose,
    ExchangeCalendar,
    HolidayRule,
    day_after,
    easter,
    fixed_date_if_weekday,
    good_friday,
    holiday_eve,
    last_weekday_before,
    nearest_workday,
    nth_weekday,
    sunday_to_monday,
    weekday_before,
    weekend_to_monday,
)


def _fixed(name: str, month: int, day: int, observance: Callable[[date], date] | None = None, **years: int) -> HolidayRule:
    return HolidayRule(name, month, day, observance=observance, **years)


def _monday(name: str, month: int, week: int, **years: int) -> HolidayRule:
    return HolidayRule(name, month, weekday=0, week=week, **years)


def _days(name: str, *texts: str) -> AdhocClosure:
    return AdhocClosure(name, tuple(date.fromisoformat(t) for t in texts))


# United States.
NEW_YEAR, INDEPENDENCE = _fixed("New Year", 1, 1, sunday_to_monday), _fixed("Independence Day", 7, 4, nearest_workday)
MLK, PRESIDENTS, MEMORIAL, LABOR = _monday("Martin Luther King Day", 1, 3, start_year=1998), _monday("Presidents' Day", 2, 3), _monday("Memorial Day", 5, -1), _monday("Labor Day", 9, 1)
JUNETEENTH = _fixed("Juneteenth", 6, 19, nearest_workday, start_year=2022)
THANKSGIVING = HolidayRule("Thanksgiving", 11, weekday=3, week=4)
US_CHRISTMAS = _fixed("Christmas", 12, 25, nearest_workday)
US_RULES = (NEW_YEAR, MLK, PRESIDENTS, MEMORIAL, JUNETEENTH, INDEPENDENCE, LABOR, THANKSGIVING, US_CHRISTMAS)
_SEPTEMBER_11 = _days("September 11", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14")
# Days of mourning, and the storm that closed the stock exchanges.
_MOURNING = _days("days of mourning", "1994-04-27", "2004-06-11", "2007-01-02", "2018-12-05", "2025-01-09")
_SANDY = _days("Hurricane Sandy", "2012-10-29", "2012-10-30")
_ONE = time(13)
BLACK_FRIDAY = EarlyClose("Black Friday", _ONE, compute_fn=day_after(THANKSGIVING))
US_CHRISTMAS_EVE = EarlyClose("Christmas Eve", _ONE, compute_fn=fixed_date_if_weekday(12, 24, start_year=1993))
US_EARLY = (EarlyClose("Independence Day Eve", _ONE, compute_fn=holiday_eve(7, 4)), BLACK_FRIDAY, US_CHRISTMAS_EVE)
CME_EARLY = (*[EarlyClose(r.name, _ONE, rule=r) for r in (MLK, PRESIDENTS, MEMORIAL, INDEPENDENCE, LABOR, THANKSGIVING)], BLACK_FRIDAY, US_CHRISTMAS_EVE)


def _good_friday(year: int) -> list[date]:
    return [good_friday(year)]


def _easter_days(year: int) -> list[date]:
    return [good_friday(year), easter(year) + ONE]


def _us(name: str, close: time, early: tuple[EarlyClose, ...]) -> ExchangeCalendar:
    return ExchangeCalendar(name, time(9, 30), close, "America/New_York", US_RULES, (_SEPTEMBER_11, _SANDY, _MOURNING), early, _good_friday)


def _cme(name: str, opens: time, close: time, offset: int) -> ExchangeCalendar:
    return ExchangeCalendar(name, opens, close, "America/New_York", (NEW_YEAR, US_CHRISTMAS), (_SEPTEMBER_11, _MOURNING), CME_EARLY, _good_friday, open_offset=offset)


# United Kingdom and Canada: a second day of Christmas that follows the first one's substitute.
def _after_christmas(d: date) -> date:
    return max(weekend_to_monday(d), weekend_to_monday(date(d.year, 12, 25)) + ONE)


def _london() -> ExchangeCalendar:
    rules = (_fixed("New Year", 1, 1, weekend_to_monday), _monday("Early May", 5, 1), _monday("Spring", 5, -1), _monday("Summer", 8, -1), _fixed("Christmas", 12, 25, weekend_to_monday), _fixed("Boxing Day", 12, 26, _after_christmas))
    # Extra bank holidays, and the usual ones that were moved to them.
    extra = _days("extra bank holidays", "2011-04-29", "2012-06-04", "2012-06-05", "2020-05-08", "2022-06-02", "2022-06-03", "2022-09-19", "2023-05-08")
    moved = frozenset({date(2012, 5, 28), date(2020, 5, 4), date(2022, 5, 30)})
    half = time(12, 30)
    early = (EarlyClose("Christmas Eve", half, compute_fn=last_weekday_before(12, 25)), EarlyClose("New Year's Eve", half, compute_fn=last_weekday_before(1, 1, year_offset=1)))
    return ExchangeCalendar("XLON", time(8), time(16, 30), "Europe/London", rules, (extra,), early, _easter_days, moved)


_CONTINENT = (_fixed("New Year", 1, 1), _fixed("Labour Day", 5, 1), _fixed("Christmas", 12, 25), _fixed("Boxing Day", 12, 26))


def _paris() -> ExchangeCalendar:
    eves = tuple(EarlyClose(n, time(14, 5), compute_fn=fixed_date_if_weekday(12, d)) for n, d in (("Christmas Eve", 24), ("New Year's Eve", 31)))
    return ExchangeCalendar("XPAR", time(9), time(17, 30), "Europe/Paris", _CONTINENT, (), eves, _easter_days)


def _frankfurt() -> ExchangeCalendar:
    def special(year: int) -> list[date]:
        whit = [easter(year) + 50 * ONE] if 2015 <= year <= 2021 else []
        return [*_easter_days(year), *whit, date(year, 12, 24), date(year, 12, 31)]

    rules = (*_CONTINENT, _fixed("Unity Day", 10, 3, start_year=2014, end_year=2021))
    extra = (_days("single holidays", "2007-05-28", "2017-10-31"),)
    early = (EarlyClose("last working day", time(14), compute_fn=lambda y: weekday_before(date(y, 12, 31)) if y >= 2010 else None),)
    return ExchangeCalendar("XETR", time(9), time(17, 30), "Europe/Berlin", rules, extra, early, special)


def _toronto() -> ExchangeCalendar:
    def special(year: int) -> list[date]:
        limit = date(year, 5, 24)
        return [good_friday(year), limit - timedelta(days=limit.weekday())]

    rules = (_fixed("New Year", 1, 1, weekend_to_monday), _monday("Family Day", 2, 3, start_year=2008), _fixed("Canada Day", 7, 1, weekend_to_monday), _monday("Civic Holiday", 8, 1), _monday("Labour Day", 9, 1), _monday("Thanksgiving", 10, 2), _fixed("Christmas", 12, 25, weekend_to_monday), _fixed("Boxing Day", 12, 26, _after_christmas))
    early = (EarlyClose("Christmas Eve", _ONE, compute_fn=fixed_date_if_weekday(12, 24)),)
    return ExchangeCalendar("XTSE", time(9, 30), time(16), "America/Toronto", rules, (_SEPTEMBER_11,), early, special)


# Japan. Fixed value: the day of September in the one year that the approximation does not give.
_AUTUMN_DAY = {1996: 22}


def _equinoxes(year: int) -> list[date]:
    """Vernal and autumnal equinox day by the usual approximation, 1990 to 2030."""
    if not 1990 <= year <= 2030:
        return []
    drift = 0.242194 * (year - 1980) - (year - 1980) // 4
    autumn = _AUTUMN_DAY.get(year, int(23.2488 + drift))
    return [date(year, 3, int(20.8431 + drift)), date(year, 9, autumn)]


def _tokyo() -> ExchangeCalendar:
    # Holidays moved for the games of 2020 and 2021, where they went and where they had been.
    moved_to = {2020: ((7, 23), (7, 24), (8, 10)), 2021: ((7, 22), (7, 23), (8, 9))}
    moved_from = frozenset({date(2020, 7, 20), date(2020, 8, 11), date(2020, 10, 12), date(2021, 7, 19), date(2021, 8, 11), date(2021, 10, 11)})

    def special(year: int) -> list[date]:
        out = [sunday_to_monday(d) for d in _equinoxes(year)] + [date(year, 12, 31)]
        aged = nth_weekday(year, 9, 0, 3)
        if any(d - aged == 2 * ONE for d in _equinoxes(year)):
            out.append(aged + ONE)
        # A Sunday among the first two of three holidays in a row is made up for after the third.
        if 6 in (date(year, 5, 3).weekday(), date(year, 5, 4).weekday()):
            out.append(date(year, 5, 6))
        return out + [date(year, m, d) for m, d in moved_to.get(year, ())]

    sunday = sunday_to_monday
    rules = (
        _fixed("New Year", 1, 1), _fixed("January 2", 1, 2), _fixed("January 3", 1, 3), _monday("Coming of Age", 1, 2), _fixed("Foundation Day", 2, 11, sunday),
        _fixed("Emperor's Birthday", 2, 23, sunday, start_year=2020), _fixed("Emperor's Birthday", 12, 23, sunday, end_year=2018), _fixed("Showa Day", 4, 29, sunday),
        _fixed("Constitution Day", 5, 3, sunday), _fixed("Greenery Day", 5, 4, sunday), _fixed("Children's Day", 5, 5, sunday), _monday("Marine Day", 7, 3),
        _fixed("Mountain Day", 8, 11, sunday, start_year=2016), _monday("Respect for the Aged", 9, 3), _monday("Sports Day", 10, 2), _fixed("Culture Day", 11, 3, sunday), _fixed("Thanksgiving", 11, 23, sunday),
    )
    single = _days("accession of 2019 and the halt of 2020", "2019-04-30", "2019-05-01", "2019-05-02", "2019-10-22", "2020-10-01")
    return ExchangeCalendar("XTKS", time(9), time(15), "Asia/Tokyo", rules, (single,), (), special, moved_from, break_start=time(11, 30), break_end=time(12, 30))


# Hong Kong. Fixed values: (month, day) of each festival by year.
_LUNAR_NEW_YEAR = {  # first day of the lunar year
    1990: (1, 27), 1991: (2, 15), 1992: (2, 4), 1993: (1, 23), 1994: (2, 10), 1995: (1, 31), 1996: (2, 19), 1997: (2, 7),
    1998: (1, 28), 1999: (2, 16), 2000: (2, 5), 2001: (1, 24), 2002: (2, 12), 2003: (2, 1), 2004: (1, 22), 2005: (2, 9),
    2006: (1, 29), 2007: (2, 18), 2008: (2, 7), 2009: (1, 26), 2010: (2, 14), 2011: (2, 3), 2012: (1, 23), 2013: (2, 10),
    2014: (1, 31), 2015: (2, 19), 2016: (2, 8), 2017: (1, 28), 2018: (2, 16), 2019: (2, 5), 2020: (1, 25), 2021: (2, 12),
    2022: (2, 1), 2023: (1, 22), 2024: (2, 10), 2025: (1, 29), 2026: (2, 17), 2027: (2, 6), 2028: (1, 26), 2029: (2, 13),
    2030: (2, 3),
}
_BUDDHA = {  # Buddha's Birthday
    2007: (5, 24), 2008: (5, 12), 2009: (5, 2), 2010: (5, 21), 2011: (5, 10), 2012: (4, 28), 2013: (5, 17), 2014: (5, 6),
    2015: (5, 25), 2016: (5, 14), 2017: (5, 3), 2018: (5, 22), 2019: (5, 12), 2020: (4, 30), 2021: (5, 19), 2022: (5, 8),
    2023: (5, 26), 2024: (5, 15), 2025: (5, 5), 2026: (5, 24), 2027: (5, 13), 2028: (5, 2), 2029: (5, 20), 2030: (5, 9),
}
_TUEN_NG = {  # Tuen Ng Festival
    2007: (6, 19), 2008: (6, 8), 2009: (5, 28), 2010: (6, 16), 2011: (6, 6), 2012: (6, 23), 2013: (6, 12), 2014: (6, 2),
    2015: (6, 20), 2016: (6, 9), 2017: (5, 30), 2018: (6, 18), 2019: (6, 7), 2020: (6, 25), 2021: (6, 14), 2022: (6, 3),
    2023: (6, 22), 2024: (6, 10), 2025: (5, 31), 2026: (6, 19), 2027: (6, 9), 2028: (5, 28), 2029: (6, 16), 2030: (6, 5),
}
_MID_AUTUMN = {  # the day after Mid-Autumn
    2007: (9, 26), 2008: (9, 15), 2009: (10, 3), 2010: (9, 23), 2011: (9, 13), 2012: (10, 1), 2013: (9, 20), 2014: (9, 9),
    2015: (9, 28), 2016: (9, 16), 2017: (10, 5), 2018: (9, 25), 2019: (9, 14), 2020: (10, 2), 2021: (9, 22), 2022: (9, 12),
    2023: (9, 30), 2024: (9, 18), 2025: (10, 7), 2026: (9, 26), 2027: (9, 16), 2028: (10, 4), 2029: (9, 23), 2030: (9, 13),
}
_CHUNG_YEUNG = {  # Chung Yeung Festival
    2007: (10, 19), 2008: (10, 7), 2009: (10, 26), 2010: (10, 16), 2011: (10, 5), 2012: (10, 23), 2013: (10, 13), 2014: (10, 2),
    2015: (10, 21), 2016: (10, 9), 2017: (10, 28), 2018: (10, 17), 2019: (10, 7), 2020: (10, 26), 2021: (10, 14), 2022: (10, 4),
    2023: (10, 23), 2024: (10, 11), 2025: (10, 29), 2026: (10, 18), 2027: (10, 8), 2028: (10, 26), 2029: (10, 16), 2030: (10, 5),
}


def _dated(table: dict[int, tuple[int, int]]) -> dict[int, date]:
    return {year: date(year, month, day) for year, (month, day) in table.items()}


def _hong_kong() -> ExchangeCalendar:
    new_year = _dated(_LUNAR_NEW_YEAR)
    lunar = [_dated(t) for t in (_BUDDHA, _TUEN_NG, _MID_AUTUMN, _CHUNG_YEUNG)]

    def ching_ming(year: int) -> date:
        # The solar term's day by the usual approximation; a clash with Easter Monday moves it on.
        start, base = (5.59, 1900) if year < 2000 else (4.81, 2000)
        y = year - base
        d = sunday_to_monday(date(year, 4, int(0.2422 * y + start) - y // 4))
        return d + ONE if d == easter(year) + ONE else d

    def special(year: int) -> list[date]:
        out = _easter_days(year)
        if first := new_year.get(year):
            days = [first + i * ONE for i in range(3)]
            out += [sunday_to_monday(d) for d in days]
            if year >= 2013 and any(d.weekday() == 6 for d in days):
                out.append(first + 3 * ONE)
            out.append(ching_ming(year))
        for table in lunar:
            if d := table.get(year):
                # The national day keeps the 1st of October.
                out.append(sunday_to_monday(d + ONE if (d.month, d.day) == (10, 1) else d))
        christmas = date(year, 12, 25)
        out += [d for d in (christmas, christmas + ONE) if d.weekday() < 5]
        return out + ([christmas + 2 * ONE] if christmas.weekday() >= 5 else [])

    def lunar_eve(year: int) -> date | None:
        d = new_year.get(year)
        return d - ONE if d and (d - ONE).weekday() < 5 else None

    # Storms and one anniversary that closed whole days.
    closed = _days("storms and anniversaries", "2008-08-06", "2008-08-22", "2011-09-29", "2013-08-14", "2015-09-03", "2016-08-02", "2016-10-21", "2017-08-23", "2020-10-13", "2021-10-13", "2023-07-17", "2024-09-06")
    rules = (_fixed("New Year", 1, 1, sunday_to_monday), _fixed("Establishment Day", 7, 1, sunday_to_monday, start_year=1997), _fixed("National Day", 10, 1, sunday_to_monday, start_year=1997), _fixed("Labour Day", 5, 1, sunday_to_monday, start_year=1999))
    noon = time(12)
    early = (EarlyClose("Christmas Eve", noon, compute_fn=fixed_date_if_weekday(12, 24)), EarlyClose("New Year's Eve", noon, compute_fn=fixed_date_if_weekday(12, 31)), EarlyClose("Lunar New Year's Eve", noon, compute_fn=lunar_eve))
    return ExchangeCalendar("XHKG", time(9, 30), time(16), "Asia/Hong_Kong", rules, (closed,), early, special, break_start=time(12), break_end=time(13))


_MAKERS: dict[str, Callable[[], ExchangeCalendar]] = {}
_MADE: dict[str, ExchangeCalendar] = {}
_NOTICES: dict[str, str] = {}


def register_exchange(names: str | list[str], make: Callable[[], ExchangeCalendar], adhoc_url: str | None = None) -> None:
    """Make a calendar available under names, the first of which is its own; a page of its ad-hoc closures may be noted."""
    names = [names] if isinstance(names, str) else names
    for n in names:
        _MAKERS[n.upper()] = make
        _MADE.pop(n.upper(), None)
    if adhoc_url:
        _NOTICES[names[0]] = adhoc_url


def get_calendar(name: str) -> ExchangeCalendar:
    key = name.upper()
    if key not in _MAKERS:
        raise ValueError(f"no exchange is named {name!r}")
    if key not in _MADE:
        _MADE[key] = _MAKERS[key]()
    return _MADE[key]


def get_adhoc_url(name: str) -> str | None:
    return _NOTICES.get(get_calendar(name).name)


def get_all_adhoc_urls() -> dict[str, str]:
    return dict(_NOTICES)


register_exchange(["XNYS", "NYSE"], lambda: _us("XNYS", time(16), US_EARLY), "https://www.nyse.com/markets/hours-calendars")
register_exchange(["XNAS", "NASDAQ"], lambda: _us("XNAS", time(16), US_EARLY), "https://www.nasdaq.com/market-activity/stock-market-holiday-schedule")
register_exchange(["XCBO", "CBOE"], lambda: _us("XCBO", time(16, 15), (BLACK_FRIDAY,)))
register_exchange(["XCME", "CME", "CME-RTH"], lambda: _cme("XCME", time(9, 30), time(16, 15), 0))
register_exchange(["GLBX", "Globex", "CME-GLOBEX"], lambda: _cme("GLBX", time(18), time(17), -1))
register_exchange(["CMES", "CME-FX", "FX"], lambda: ExchangeCalendar("CMES", time(17), time(17), "America/New_York", open_offset=-1))
register_exchange(["XLON", "LSE", "London"], _london)
register_exchange(["XPAR", "Euronext", "Paris"], _paris)
register_exchange(["XETR", "Xetra", "Frankfurt"], _frankfurt)
register_exchange(["XTSE", "TSX", "Toronto"], _toronto)
register_exchange(["XTKS", "JPX", "Tokyo", "TSE"], _tokyo)
register_exchange(["XHKG", "HKEX", "HongKong"], _hong_kong)
