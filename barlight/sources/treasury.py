"""US Treasury par yields: yearly CSV files, the public XML feed, and lookups.

Files hold percent by date, a column for each tenor; blanks are missing. They
are read with one schema for all years, so a tenor that appears late is kept.
"""

from __future__ import annotations

import os
import urllib.request
import xml.etree.ElementTree as ET
from datetime import date, datetime
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TreasuryRate(Enum):
    """Tenors in order of maturity; the value is the name of its column in files."""

    M1, M1_5, M2, M3, M4, M6 = "BC_1MONTH", "BC_1_5MONTH", "BC_2MONTH", "BC_3MONTH", "BC_4MONTH", "BC_6MONTH"
    Y1, Y2, Y3, Y5, Y7, Y10, Y20, Y30 = "BC_1YEAR", "BC_2YEAR", "BC_3YEAR", "BC_5YEAR", "BC_7YEAR", "BC_10YEAR", "BC_20YEAR", "BC_30YEAR"
    Y30_DISPLAY = "BC_30YEARDISPLAY"

    @property
    def column(self) -> str:
        return self.value.lower()


class MeanMethod(Enum):
    ARITHMETIC = "arithmetic"
    GEOMETRIC = "geometric"


TENORS = list(TreasuryRate)
SCHEMA = "date date, " + ", ".join(f"{t.column} double" for t in TENORS)
FEED = "https://home.treasury.gov/resource-center/data-chart-center/interest-rates/pages/xml?data=daily_treasury_yield_curve&field_tdr_date_value={year}"
#: Days after which the current year's cached file is fetched again.
STALE_DAYS = 7


def load_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Decimal rates by date from all CSV files below folder; null where a tenor is missing."""
    # Columns differ by year, so each file's header decides where its values go.
    raw = spark.read.option("header", True).option("enforceSchema", False)
    paths = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.csv").load(folder).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    out = None
    for path in sorted(paths):
        one = raw.csv(path)
        have = {c.lower(): c for c in one.columns}
        one = one.select(F.to_date(have["date"]).alias("date"), *[(F.expr(f"try_cast(`{have[t.column]}` as double)") / 100 if t.column in have else F.lit(None).cast("double")).alias(t.column) for t in TENORS])
        out = one if out is None else out.unionByName(one)
    return out


def schema_matrix(rates: DataFrame) -> DataFrame:
    """(year, tenor): which tenors have values in which years."""
    wide = rates.groupBy(F.year("date").alias("year")).agg(*[F.bool_or(F.col(t.column).isNotNull()).alias(t.column) for t in TENORS])
    return wide.unpivot("year", [t.column for t in TENORS], "tenor", "present").where("present").select("year", "tenor")


def parse_feed(xml: str) -> list[dict]:
    """Rows {date, BC_*: decimal} of an Atom document of the feed, whatever its namespaces."""
    tag = lambda e: e.tag.rpartition("}")[2]
    rows = []
    for entry in (e for e in ET.fromstring(xml).iter() if tag(e) == "properties"):
        values = {tag(e): (e.text or "").strip() for e in entry}
        if not values.get("NEW_DATE"):
            continue
        row: dict = {"date": datetime.fromisoformat(values["NEW_DATE"]).date()}
        for t in TENORS:
            try:
                row[t.value] = float(values[t.value]) / 100
            except (KeyError, ValueError):
                continue
        rows.append(row)
    return sorted(rows, key=lambda r: r["date"])


def save_year(folder: str, year: int, rows: list[dict]) -> str:
    """Write a year's CSV in percent, with the tenors that have values."""
    used = [t.value for t in TENORS if any(t.value in r for r in rows)]
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{year}.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(["date", *used]) + "\n")
        for r in rows:
            f.write(",".join([r["date"].isoformat(), *[f"{r[u] * 100:.2f}" if u in r else "" for u in used]]) + "\n")
    return path


def is_stale(path: str, year: int, today: date | None = None) -> bool:
    """Past years are final; the current one holds for STALE_DAYS."""
    today = today or date.today()
    return year >= today.year and (today - date.fromtimestamp(os.path.getmtime(path))).days >= STALE_DAYS


def fetch_year(folder: str, year: int, timeout: float = 30) -> str:
    """Path of a year's file: the cached one unless stale, else fetched; a stale one if that fails."""
    path = os.path.join(folder, f"{year}.csv")
    if os.path.exists(path) and not is_stale(path, year):
        return path
    try:
        with urllib.request.urlopen(FEED.format(year=year), timeout=timeout) as answer:
            return save_year(folder, year, parse_feed(answer.read().decode()))
    except OSError:
        if os.path.exists(path):
            return path
        raise


def clear_cache(folder: str) -> None:
    for name in os.listdir(folder) if os.path.isdir(folder) else []:
        if name[:-4].isdigit() and name.endswith(".csv"):
            os.remove(os.path.join(folder, name))


def _between(rates: DataFrame, start: str, end: str) -> DataFrame:
    return rates.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def treasury_rates(rates: DataFrame, start: str, end: str, instrument: TreasuryRate | list[TreasuryRate] | None = None) -> DataFrame:
    """(date, rate) of one tenor without nulls; several or all give a wide frame with every row."""
    part = _between(rates, start, end)
    if isinstance(instrument, TreasuryRate):
        return part.select("date", F.col(instrument.column).alias("rate")).where("rate is not null").orderBy("date")
    return part.select("date", *[t.column for t in instrument or TENORS]).orderBy("date")


def treasury_spread(rates: DataFrame, start: str, end: str, long: TreasuryRate = TreasuryRate.Y10, short: TreasuryRate = TreasuryRate.Y2) -> DataFrame:
    return _between(rates, start, end).select("date", (F.col(long.column) - F.col(short.column)).alias("spread")).where("spread is not null").orderBy("date")


def treasury_spread_matrix(rates: DataFrame, start: str, end: str, instruments: list[TreasuryRate] | None = None, longs: list[TreasuryRate] | None = None, shorts: list[TreasuryRate] | None = None) -> DataFrame:
    """date and spread_<long>_<short> for every pair with the longer maturity first; all rows."""
    every = instruments or [t for t in TENORS if t is not TreasuryRate.Y30_DISPLAY]
    name = lambda t: t.column.removeprefix("bc_")
    pairs = [(a, b) for b in shorts or every for a in longs or every if TENORS.index(a) > TENORS.index(b)]
    return _between(rates, start, end).select("date", *[(F.col(a.column) - F.col(b.column)).alias(f"spread_{name(a)}_{name(b)}") for a, b in pairs]).orderBy("date")


def mean_treasury_rate(rates: DataFrame, start: str, end: str, instrument: TreasuryRate = TreasuryRate.M3, method: MeanMethod = MeanMethod.ARITHMETIC) -> DataFrame:
    """One row `rate`: the mean in the range; without any, the last rate since the year before start; without that, 0."""
    r, first, last = F.col(instrument.column), F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = F.when(F.col("date").between(first, last), r)
    if method is MeanMethod.GEOMETRIC:
        bad = F.when(inside <= -1, F.raise_error(F.lit("a rate of -100 % or less has no geometric mean")).cast("double"))
        mean = F.expm1(F.avg(F.log1p(F.coalesce(bad, inside))))
    else:
        mean = F.avg(inside)
    before = F.max_by(r, F.when(r.isNotNull() & (F.col("date") <= last) & (F.year("date") >= F.year(first) - 1), F.col("date")))
    return rates.agg(F.coalesce(mean, before, F.lit(0.0)).alias("rate"))


def risk_free_rate(rates: DataFrame, start: str, end: str, instrument: TreasuryRate = TreasuryRate.M3) -> float:
    return mean_treasury_rate(rates, start, end, instrument).first()[0]
