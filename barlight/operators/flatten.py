"""Bars on which positions are closed before the end of a session, and bars that open nothing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import BarOrder
from .options import FlattenSchedule


def flatten_masks(df: DataFrame, calendar: Any, schedule: FlattenSchedule, order: BarOrder) -> DataFrame:
    """df with _fb (the forced-close bar of a selected session) and _blocked.

    A bar belongs to the session that it opens in. The forced-close bar is the
    session's last one at or before the close less minutes_before_close.
    """
    sessions = calendar.session_table(df, order.date)
    if schedule.resolved_days == "weekly":
        picked = F.col("_week_close")
    elif schedule.resolved_days == "daily":
        picked = F.lit(True)
    else:
        picked = (F.weekday("_session") + 1).isin([int(d) for d in schedule.resolved_days])
    df = calendar.with_session(df, order.date, sessions)
    minutes = lambda m: F.make_dt_interval(mins=F.lit(m))
    t = F.col(order.date)
    early = picked & (t <= F.col("_close") - minutes(schedule.minutes_before_close))
    each = Window.partitionBy(*order.keys, "_session")
    last = F.max(F.when(early, F.col("_idx"))).over(each)
    df = df.withColumn("_fb", F.coalesce((F.col("_idx") == last) & F.col("_session").isNotNull(), F.lit(False)))
    blocked = picked & (t >= F.col("_close") - minutes(schedule.block_minutes)) if schedule.block_minutes else F.lit(False)
    return df.withColumn("_blocked", F.coalesce(blocked, F.lit(False))).drop("_session", "_open", "_close", "_week_close")
