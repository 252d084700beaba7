"""Trading calendar: sessions, next / previous session, session arithmetic, missing days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.frames import with_one_row


def weekdays(bounds: DataFrame) -> DataFrame:
    """All Monday-Friday dates between the one-row columns ``first_day`` and ``last_day``."""
    return bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("session_date")).where(
        F.dayofweek("session_date").between(2, 6)
    )


def active_holidays(holidays: DataFrame) -> DataFrame:
    return holidays.where("active").select(F.col("holiday_date").alias("session_date")).distinct()


def trading_calendar(bounds: DataFrame, holidays: DataFrame) -> DataFrame:
    """Numbered sessions: weekdays without active holidays. One row per day, so always small."""
    days = weekdays(bounds).join(F.broadcast(active_holidays(holidays)), "session_date", "left_anti")
    return days.withColumn("session_no", F.row_number().over(W.orderBy("session_date")))


def date_span(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def _numbered(calendar: DataFrame) -> DataFrame:
    """Every calendar day with the number of the last session on or before it."""
    span = date_span(calendar, "session_date")
    days = span.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return days.join(calendar, days.day == calendar.session_date, "left").select(
        "day",
        F.coalesce(F.max("session_no").over(w), F.lit(0)).alias("last_no"),
        F.col("session_no").isNotNull().alias("is_session"),
    )


def add_sessions(df: DataFrame, day: str, n: int, calendar: DataFrame, out: str) -> DataFrame:
    """Date ``n`` trading sessions after (before) ``day``; 0 keeps a session or moves to the next.

    Works by session number on the small calendar, which is broadcast; dates outside the
    calendar give NULL, so pass a calendar that covers the shift.
    """
    mapped = _numbered(calendar)
    # from a closed day one step back lands on the last session itself
    if n > 0:
        target = F.col("last_no") + n
    elif n == 0:
        target = F.when(F.col("is_session"), F.col("last_no")).otherwise(F.col("last_no") + 1)
    else:
        target = F.col("last_no") + n + F.when(F.col("is_session"), 0).otherwise(1)
    mapped = mapped.withColumn("_no", target)
    ends = calendar.select(F.col("session_no").alias("_no"), F.col("session_date").alias(out))
    lookup = mapped.join(ends, "_no").select(F.col("day").alias(day), out)
    return df.join(F.broadcast(lookup), day, "left")


def next_session(df: DataFrame, day: str, calendar: DataFrame, out: str = "next_session") -> DataFrame:
    return add_sessions(df, day, 1, calendar, out)


def previous_session(df: DataFrame, day: str, calendar: DataFrame, out: str = "previous_session") -> DataFrame:
    return add_sessions(df, day, -1, calendar, out)


def missing_sessions(daily: DataFrame, calendar: DataFrame, as_of: dt.date, n: int, force: bool = False) -> DataFrame:
    """The last ``n`` sessions up to ``as_of`` that have no daily row (all of them when forced)."""
    recent = calendar.where(F.col("session_date") <= F.lit(as_of)).orderBy(F.desc("session_date")).limit(n)
    if force:
        return recent.select("session_date")
    seen = daily.select("session_date").distinct()
    return recent.select("session_date").join(seen, "session_date", "left_anti")


def pending_backtest_dates(signals: DataFrame, trades: DataFrame, metrics: DataFrame, as_of: dt.date, limit: int) -> DataFrame:
    """Oldest signal dates with fewer trades than signals, or without metrics."""

    def per_day(df: DataFrame, day: str, out: str) -> DataFrame:
        kept = df.where(F.col(day) <= F.lit(as_of))
        return kept.groupBy(F.col(day).alias("reference_date")).agg(F.count(F.lit(1)).alias(out))

    joined = (
        per_day(signals, "reference_date", "signals")
        .join(per_day(trades, "reference_date", "trades"), "reference_date", "left")
        .join(per_day(metrics, "as_of_date", "metric_rows"), "reference_date", "left")
    )
    open_days = joined.where(
        (F.coalesce("trades", F.lit(0)) < F.col("signals")) | (F.coalesce("metric_rows", F.lit(0)) == 0)
    )
    return open_days.orderBy("reference_date").limit(limit).select("reference_date")


def next_open_day(last_day: DataFrame, holidays: DataFrame, reach: int = 10) -> DataFrame:
    """First open weekday within ``reach`` days after the one-row column ``last_trading_day``."""
    days = last_day.select(
        F.explode(
            F.sequence(F.date_add("last_trading_day", 1), F.date_add("last_trading_day", reach))
        ).alias("session_date")
    ).where(F.dayofweek("session_date").between(2, 6))
    open_days = days.join(F.broadcast(active_holidays(holidays)), "session_date", "left_anti")
    return open_days.agg(F.min("session_date").alias("next_trading_day"))


__all__ = [
    "active_holidays",
    "add_sessions",
    "date_span",
    "missing_sessions",
    "next_open_day",
    "next_session",
    "pending_backtest_dates",
    "previous_session",
    "trading_calendar",
    "with_one_row",
]
