"""Queries over candles, calendar and quotes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import candles as cdl
from .registry import cte, query
from .shared import shared
from .tables import Tables

CANDLE = "ticker candle_at open:d high:d low:d close:d volume:d"

cte(
    "candles_15m",
    """
    SELECT ticker, time_bucket(INTERVAL 15 MINUTE, ts) AS candle_at, arg_min(price, (ts, seq)) AS open,
           max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(price) AS samples,
           0.0::DOUBLE AS volume,
           CASE WHEN count(price) = 1 THEN ['NO_VOLUME_SOURCE', 'SINGLE_QUOTE_BUCKET']
                ELSE ['NO_VOLUME_SOURCE'] END AS flags
    FROM ticks GROUP BY ALL
    """,
    "ticks",
)


@query(
    "intraday_candles_15m",
    f"{CANDLE} samples:n flags:a",
    "SELECT * FROM candles_15m",
    "candles_15m",
)
def _candles(t: Tables):
    return cdl.build_intraday_candles(t.quotes)


def _rolled(unit: str) -> str:
    return f"""
    SELECT ticker, date_trunc('{unit}', candle_at) AS at_, arg_min(open, candle_at) AS open, max(high) AS high,
           min(low) AS low, arg_max(close, candle_at) AS close, sum(volume) AS volume
    FROM candles_15m GROUP BY ALL
    """


@query(
    "rollup_candles_1h",
    f"{CANDLE} flags:a",
    f"SELECT * EXCLUDE (at_), at_ AS candle_at, ['ROLLED_UP'] AS flags FROM ({_rolled('hour')})",
    "candles_15m",
)
def _hourly(t: Tables):
    return cdl.rollup_candles(cdl.build_intraday_candles(t.quotes), "1h")


@query(
    "rollup_candles_1d",
    CANDLE,
    f"SELECT * EXCLUDE (at_), at_::TIMESTAMP AS candle_at FROM ({_rolled('day')})",
    "candles_15m",
)
def _days(t: Tables):
    return cdl.rollup_candles(cdl.build_intraday_candles(t.quotes), "1D")


@query(
    "format_intraday_prices",
    "ticker ts price:d",
    "SELECT ticker, ts, arg_max(price, seq) AS price FROM ticks GROUP BY ticker, ts",
    "ticks",
)
def _prices(t: Tables):
    return cdl.format_intraday_prices(t.quotes)


@query(
    "candle_flag_counts",
    "flag candles:n",
    "SELECT flag, count(*) AS candles FROM (SELECT unnest(flags) AS flag FROM candles_15m) GROUP BY flag",
    "candles_15m",
)
def _flags(t: Tables):
    return cdl.count_flags(cdl.build_intraday_candles(t.quotes))


@query(
    "candle_storage_rows",
    "ticker candle_at reference_date open:d close:d data_quality_flags",
    """SELECT ticker, candle_at, CAST(candle_at AS DATE) AS reference_date, open, close,
              array_to_string(flags, ',') AS data_quality_flags FROM candles_15m""",
    "candles_15m",
)
def _storage(t: Tables):
    return cdl.candle_rows(cdl.build_intraday_candles(t.quotes))


BODY = "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL"


@query(
    "candle_rejects",
    "ticker session_date reject_reasons:a",
    """
    SELECT ticker, session_date, list_concat(
        CASE WHEN high < greatest(open, close, low) THEN ['HIGH_BELOW_BODY'] ELSE [] END,
        CASE WHEN low > least(open, close, high) THEN ['LOW_ABOVE_BODY'] ELSE [] END) AS reject_reasons
    FROM daily WHERE high < greatest(open, close, low) OR low > least(open, close, high)
    """,
    "daily",
)
def _rejects(t: Tables):
    return cdl.validate_candles(t.daily)[1]


@query(
    "valid_candles",
    "ticker session_date open:d high:d low:d close:d volume:d",
    "SELECT * FROM daily WHERE high >= greatest(open, close, low) AND low <= least(open, close, high)",
    "daily",
)
def _valid(t: Tables):
    return cdl.validate_candles(t.daily)[0]


@shared
def calendar_of(t: Tables):
    return cal.trading_calendar(cal.date_span(t.daily, "session_date"), t.holidays)


@query("trading_calendar", "session_date session_no:n", "SELECT * FROM calendar", "calendar")
def _calendar(t: Tables):
    return calendar_of(t)


def _shifted(n: int) -> str:
    return {
        -1: "(SELECT max(session_date) FROM calendar AS c WHERE c.session_date < d.day)",
        0: "(SELECT min(session_date) FROM calendar AS c WHERE c.session_date >= d.day)",
        1: "(SELECT min(session_date) FROM calendar AS c WHERE c.session_date > d.day)",
    }[n]


@query(
    "session_shifts",
    "day bars:n same_or_next next_session previous_session plus_five",
    f"""
    SELECT day, bars, {_shifted(0)} AS same_or_next, {_shifted(1)} AS next_session,
           {_shifted(-1)} AS previous_session,
           (SELECT session_date FROM calendar AS c
            WHERE c.session_no = 5 + (SELECT count(*) FROM calendar AS b WHERE b.session_date <= d.day)) AS plus_five
    FROM (SELECT CAST(captured_at AS DATE) AS day, count(*) AS bars FROM quotes GROUP BY 1) AS d
    """,
    "calendar quotes",
)
def _shifts(t: Tables):
    days = t.quotes.groupBy(F.to_date("captured_at").alias("day")).agg(F.count(F.lit(1)).alias("bars"))
    k = calendar_of(t)
    out = cal.add_sessions(days, "day", 0, k, "same_or_next")
    out = cal.next_session(out, "day", k)
    out = cal.previous_session(out, "day", k)
    return cal.add_sessions(out, "day", 5, k, "plus_five")


@query(
    "missing_sessions",
    "session_date",
    """
    SELECT session_date FROM (SELECT session_date FROM calendar WHERE session_date <= DATE '2024-02-29'
                              ORDER BY session_date DESC LIMIT 40)
    WHERE session_date NOT IN (SELECT quote_date FROM quotes)
    """,
    "calendar quotes",
)
def _missing(t: Tables):
    """Sessions that have no quote at all."""
    days = t.quotes.withColumnRenamed("quote_date", "session_date")
    return cal.missing_sessions(days, calendar_of(t), dt.date(2024, 2, 29), 40)
