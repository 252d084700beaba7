"""Queries over inventory, coverage, incidents and quality checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import quality as ql
from .registry import cte, query, sdiv
from .shared import shared
from .tables import Tables

DAY = dt.date(2024, 3, 4)  # a session with duplicates, see tables.py
QUOTE_DAY = dt.date(2024, 1, 17)
BAD = """(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR least(open, high, low, close) <= 0
          OR high < greatest(low, open, close) OR low > least(open, close))"""
NOVOL = "(financial_volume IS NULL OR financial_volume <= 0)"

cte(
    "coverage",
    f"""
    SELECT d.*, t.company, t.active, e.expected_days, {sdiv('d.days_with_data', 'e.expected_days')} AS coverage_pct,
           CASE WHEN NOT coalesce(t.active, FALSE) THEN 'inativo'
                WHEN {sdiv('d.days_with_data', 'e.expected_days')} >= 0.9 AND avg_financial_volume >= 1e6
                     AND invalid_price_days + invalid_volume_days + duplicate_days = 0 THEN 'elegivel'
                WHEN {sdiv('d.days_with_data', 'e.expected_days')} >= 0.75 THEN 'observacao'
                ELSE 'excluir' END AS eligibility_status
    FROM (
        SELECT r.ticker, min(session_date) AS first_date, max(session_date) AS last_date,
               count(DISTINCT session_date) AS days_with_data, avg(financial_volume) AS avg_financial_volume,
               count(*) FILTER (WHERE {BAD}) AS invalid_price_days,
               count(*) FILTER (WHERE {NOVOL}) AS invalid_volume_days,
               count(DISTINCT CASE WHEN copies > 1 THEN session_date END) AS duplicate_days
        FROM (SELECT *, count(*) OVER (PARTITION BY ticker, session_date) AS copies FROM daily) AS r
        GROUP BY r.ticker
    ) AS d
    CROSS JOIN (SELECT count(*) AS expected_days FROM calendar) AS e
    LEFT JOIN tickers AS t ON t.ticker = d.ticker
    """,
    "daily tickers calendar",
)
cte(
    "universe",
    """
    SELECT ticker FROM coverage
    WHERE eligibility_status = 'elegivel'
       OR (eligibility_status = 'observacao' AND coverage_pct >= 0.9 AND avg_financial_volume >= 1e6
           AND invalid_price_days = 0 AND invalid_volume_days = 0 AND duplicate_days <= 3)
    """,
    "coverage",
)


@shared
def coverage_of(t: Tables):
    return ql.ticker_coverage(t.daily, t.tickers, t.holidays)


@query(
    "ticker_coverage",
    """ticker company active:b first_date last_date days_with_data:n expected_days:n coverage_pct:d
       avg_financial_volume:d invalid_price_days:n invalid_volume_days:n duplicate_days:n eligibility_status""",
    "SELECT * FROM coverage",
    "coverage",
)
def _coverage(t: Tables):
    return coverage_of(t)


@query("research_universe", "ticker", "SELECT * FROM universe", "universe")
def _universe(t: Tables):
    return ql.research_universe(coverage_of(t))


@query(
    "data_inventory_summary",
    """active_tickers:n total_tickers:n daily_tickers:n intraday_tickers:n first_available_date
       last_available_date daily_candles:n intraday_candles:n valid_data_pct:d last_update""",
    f"""
    SELECT active_tickers, total_tickers, daily_tickers, intraday_tickers, least(d0, q0) AS first_available_date,
           greatest(d1, q1) AS last_available_date, daily_candles, intraday_candles,
           {sdiv('daily_candles + intraday_candles - bad_daily - bad_quotes', 'daily_candles + intraday_candles')}
               AS valid_data_pct, greatest(du, qu) AS last_update
    FROM (SELECT count(*) AS daily_candles, count(DISTINCT ticker) AS daily_tickers, min(session_date) AS d0,
                 max(session_date) AS d1, max(updated_at) AS du,
                 count(*) FILTER (WHERE {BAD}) + count(*) FILTER (WHERE {NOVOL}) AS bad_daily FROM daily),
         (SELECT count(*) AS intraday_candles, count(DISTINCT ticker) AS intraday_tickers, min(quote_date) AS q0,
                 max(quote_date) AS q1, max(captured_at) AS qu,
                 count(*) FILTER (WHERE price IS NULL OR price <= 0) AS bad_quotes FROM quotes),
         (SELECT count(*) AS total_tickers, count(*) FILTER (WHERE active) AS active_tickers FROM tickers)
    """,
    "daily quotes tickers",
)
def _inventory(t: Tables):
    return ql.data_inventory_summary(t.daily, t.quotes, t.tickers)


@query(
    "data_quality_incidents",
    "incident_type severity ticker incident_date",
    f"""
    SELECT 'daily_invalid_price' AS incident_type, 'high' AS severity, ticker, session_date AS incident_date
    FROM daily WHERE {BAD}
    UNION ALL SELECT 'daily_invalid_volume', 'medium', ticker, session_date FROM daily WHERE {NOVOL}
    UNION ALL SELECT 'daily_duplicate', 'high', ticker, session_date FROM daily
    GROUP BY ticker, session_date HAVING count(*) > 1
    UNION ALL SELECT 'intraday_invalid_price', 'high', ticker, quote_date FROM quotes
    WHERE price IS NULL OR price <= 0
    """,
    "daily quotes",
)
def _incidents(t: Tables):
    return ql.data_quality_incidents(t.daily, t.quotes)


@query(
    "incident_texts",
    "incident_type ticker recommendation",
    f"""
    SELECT 'daily_duplicate' AS incident_type, ticker,
           'Remover ou consolidar ' || CAST(count(*) AS VARCHAR) || ' candles duplicados para ticker/data.'
               AS recommendation
    FROM daily GROUP BY ticker, session_date HAVING count(*) > 1
    UNION ALL
    SELECT 'intraday_invalid_price', ticker, 'Preço intraday ausente ou zerado no horário ' || quote_time || '.'
    FROM quotes WHERE price IS NULL OR price <= 0
    UNION ALL
    SELECT 'daily_invalid_price', ticker, 'OHLC inválido: ' || concat_ws(' ', {', '.join(f"'{c}=' || coalesce({c}::DOUBLE::VARCHAR, 'NULL')" for c in ('open', 'high', 'low', 'close'))})
    FROM daily WHERE {BAD}
    UNION ALL
    SELECT 'daily_invalid_volume', ticker, 'Volume financeiro ausente ou zerado: ' || coalesce(financial_volume::DOUBLE::VARCHAR, 'NULL') FROM daily WHERE {NOVOL}
    """,
    "daily quotes",
)
def _texts(t: Tables):
    return ql.data_quality_incidents(t.daily, t.quotes)


def _cover(available: str, threshold: float) -> str:
    return f"""CASE WHEN expected_tickers <= 0 THEN 'WARN'
                    WHEN {sdiv(available, 'expected_tickers')} >= {threshold} THEN 'PASS' ELSE 'FAIL' END AS status,
               round(coalesce({sdiv(available, 'expected_tickers')}, 0), 4) AS coverage_pct"""


ACTIVE = "(SELECT count(*) FILTER (WHERE active) AS expected_tickers FROM tickers) AS t"


@query(
    "dq_daily_freshness",
    "check_name status available_tickers:n expected_tickers:n coverage_pct:d",
    f"""
    SELECT 'daily_freshness' AS check_name, *, {_cover('available_tickers', 0.9)}
    FROM {ACTIVE}, (SELECT count(DISTINCT ticker) AS available_tickers FROM daily
                    WHERE session_date = DATE '{DAY}') AS d
    """,
    "daily tickers",
)
def _fresh(t: Tables):
    return ql.dq_daily_freshness(t.daily, t.tickers, DAY, 0.9)


@query(
    "dq_intraday_freshness",
    "check_name status fresh_tickers:n expected_tickers:n coverage_pct:d last_time",
    f"""
    SELECT 'intraday_freshness' AS check_name, *, {_cover('fresh_tickers', 0.1)}
    FROM {ACTIVE}, (SELECT count(*) FILTER (WHERE last >= '22:00:00') AS fresh_tickers, max(last) AS last_time
                    FROM (SELECT max(quote_time) AS last FROM quotes WHERE quote_date = DATE '{QUOTE_DAY}'
                          GROUP BY ticker)) AS d
    """,
    "quotes tickers",
)
def _fresh_quotes(t: Tables):
    return ql.dq_intraday_freshness(t.quotes, t.tickers, QUOTE_DAY, "22:00:00", 0.1)


@query(
    "dq_daily_uniqueness",
    "check_name status duplicates:n",
    f"""
    SELECT 'daily_uniqueness' AS check_name, n AS duplicates, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status
    FROM (SELECT count(*) FILTER (WHERE c > 1) AS n FROM (
        SELECT count(*) AS c FROM daily WHERE session_date = DATE '{DAY}' GROUP BY ticker, session_date))
    """,
    "daily",
)
def _unique(t: Tables):
    return ql.dq_daily_uniqueness(t.daily, DAY)


@query(
    "dq_intraday_uniqueness",
    "check_name status duplicates:n tolerance:n",
    f"""
    SELECT 'intraday_uniqueness' AS check_name, n AS duplicates, 2 AS tolerance,
           CASE WHEN n > 2 THEN 'FAIL' ELSE 'PASS' END AS status
    FROM (SELECT count(*) FILTER (WHERE c > 1) AS n FROM (
        SELECT count(*) AS c FROM quotes WHERE quote_date = DATE '{QUOTE_DAY}'
        GROUP BY ticker, quote_date, quote_time))
    """,
    "quotes",
)
def _unique_quotes(t: Tables):
    return ql.dq_intraday_uniqueness(t.quotes, QUOTE_DAY, 2)


BROKEN_DAY = dt.date(2024, 4, 17)  # session 77


@query(
    "dq_ohlc_validity",
    "check_name status invalid_high:n invalid_low:n",
    f"""
    SELECT 'ohlc_validity' AS check_name, *, CASE WHEN invalid_high + invalid_low > 0 THEN 'FAIL' ELSE 'PASS' END
               AS status
    FROM (SELECT count(*) FILTER (WHERE high < greatest(open, close, low)) AS invalid_high,
                 count(*) FILTER (WHERE low > least(open, close, high)) AS invalid_low
          FROM daily WHERE session_date = DATE '{BROKEN_DAY}')
    """,
    "daily",
)
def _ohlc(t: Tables):
    return ql.dq_ohlc_validity(t.daily, BROKEN_DAY)
