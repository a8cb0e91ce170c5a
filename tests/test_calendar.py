"""Calendar facts, kept as literal dates."""

from datetime import date, datetime
from zoneinfo import ZoneInfo

import pytest

from barlight.plans.calendar import easter
from barlight.plans.venues import get_calendar


def test_easter():
    assert [easter(y) for y in (1981, 2000, 2019, 2024, 2025)] == [date(1981, 4, 19), date(2000, 4, 23), date(2019, 4, 21), date(2024, 3, 31), date(2025, 4, 20)]


@pytest.mark.parametrize(
    ("name", "closed"),
    [
        ("NYSE", ["2024-06-19", "2012-10-29", "2001-09-11", "2018-12-05", "2021-07-05", "2021-12-24"]),
        ("XLON", ["2022-06-02", "2022-06-03", "2022-09-19", "2020-05-08", "2021-12-27", "2021-12-28"]),
        ("XTKS", ["2020-05-06", "2025-05-06", "2019-05-02", "2015-09-22", "2021-07-22", "2024-12-31"]),
        ("XHKG", ["2024-02-12", "2024-02-13", "2021-12-27", "2022-12-27", "2024-09-06", "2015-04-07"]),
        ("XETR", ["2024-12-24", "2017-10-31", "2015-05-25"]), ("XPAR", ["2024-05-01", "2024-04-01"]), ("XTSE", ["2024-05-20", "2021-12-28", "2022-12-27"]), ("CME", ["2024-03-29", "2024-12-25"]),
    ],
)
def test_closed_days(name, closed):
    assert not any(get_calendar(name).is_session(d) for d in closed)


@pytest.mark.parametrize(("name", "open_"), [("NYSE", ["2021-12-31", "2024-07-05"]), ("XLON", ["2022-05-30", "2020-05-04", "2012-05-28"]), ("XTKS", ["2020-07-20", "2021-10-11", "2019-12-23"]), ("XETR", ["2022-10-03"]), ("CME", ["2024-01-15", "2024-07-04"]), ("FX", ["2024-12-25"])])
def test_open_days(name, open_):
    assert all(get_calendar(name).is_session(d) for d in open_)


def test_navigation():
    c = get_calendar("nyse")
    assert c.next_session("2024-01-06") == date(2024, 1, 8) and c.previous_session("2024-12-26") == date(2024, 12, 24)
    assert c.session_offset("2024-01-05", 1) == date(2024, 1, 8) and c.date_to_session("2024-01-06", "previous") == date(2024, 1, 5)
    with pytest.raises(ValueError):
        c.date_to_session("2024-01-06")
    assert c.sessions_in_range("2024-01-01", "2024-12-31") == 252
    assert c.get_schedule("2024-11-29").market_close.hour == 13 and c.get_schedule("2024-01-06") is None
    with pytest.raises(ValueError):
        get_calendar("nowhere")


def test_minutes():
    c, zone = get_calendar("XTKS"), ZoneInfo("Asia/Tokyo")
    at = lambda h, m: datetime(2024, 1, 10, h, m, tzinfo=zone)
    assert [c.is_open_on_minute(at(*x)) for x in ((8, 59), (9, 0), (11, 30), (12, 29), (12, 30), (15, 0))] == [False, True, False, False, True, False]
    g = get_calendar("GLBX")
    evening = datetime(2024, 1, 9, 18, 30, tzinfo=ZoneInfo("America/New_York"))
    assert g.minute_to_session(evening) == date(2024, 1, 10)
    assert g.next_close(evening).hour == 17 and g.previous_close(evening).day == 9 and g.next_open(evening).day == 10 and g.previous_open(evening).day == 9


def test_filter_and_index(spark):
    c = get_calendar("NYSE")
    times = ["2024-11-29 10:00", "2024-11-29 12:59", "2024-11-29 13:00", "2024-11-29 14:00", "2024-11-27 15:59", "2024-11-27 16:00", "2024-11-28 12:00"]
    ntz = spark.createDataFrame([(datetime.fromisoformat(t),) for t in times], "date timestamp_ntz")
    assert sorted(r.date.isoformat()[:16] for r in c.filter_market_hours(ntz).collect()) == ["2024-11-27T15:59", "2024-11-29T10:00", "2024-11-29T12:59"]
    tokyo = spark.createDataFrame([(datetime(2024, 1, 10, h, m),) for h, m in ((11, 29), (11, 30), (12, 0), (12, 30))], "date timestamp_ntz")
    assert get_calendar("XTKS").filter_market_hours(tokyo).count() == 2
    assert c.trading_index(spark, "2024-03-08", "2024-03-08", closed="both").count() == 391 and c.trading_index(spark, "2024-03-08", "2024-03-08").count() == 390
    opens = [r.market_open.hour for r in c.schedule_frame(spark, "2024-03-08", "2024-03-11").orderBy("date").collect()]
    assert opens == [14, 13]
    assert get_calendar("XTKS").trading_index(spark, "2024-01-10", "2024-01-10", "30 minutes", "left").count() == 10
    table = c.session_table(ntz, "date")
    assert c.with_session(ntz, "date", table).where("_session is not null").count() == 3


def test_cache_keys_tell_calendars_apart_and_are_the_same_in_each_process():
    import subprocess
    import sys
    from dataclasses import replace

    london = get_calendar("XLON")
    code = "from barlight.plans.venues import get_calendar; print(get_calendar('XLON').cache_key)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == london.cache_key
    assert replace(london, special_closures=None, _memo={}).cache_key != london.cache_key
    assert len({get_calendar(n).cache_key for n in ("XNYS", "XCBO", "XCME", "GLBX", "CMES", "XLON", "XPAR", "XETR", "XTSE", "XTKS", "XHKG")}) == 11


def test_times_that_are_all_null_are_an_error(spark):
    bars = spark.createDataFrame([(None,), (None,)], "date timestamp_ntz")
    with pytest.raises(ValueError, match="null"):
        get_calendar("NYSE").filter_market_hours(bars)
    assert get_calendar("NYSE").filter_market_hours(bars.where("false")).count() == 0
