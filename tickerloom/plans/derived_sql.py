"""The derived market tables of ``tables.py`` as DuckDB CTEs."""

from .registry import cte

cte(
    "indexed_bars",
    """
    SELECT 'S' || lpad(CAST(tk AS VARCHAR), 5, '0') AS ticker,
           DATE '2024-01-01' + CAST((idx // 5) * 7 + idx % 5 AS INTEGER) AS session_date,
           arg_min(cents, seq) / 100.0::DOUBLE AS open, max(cents) / 100.0::DOUBLE AS high,
           min(cents) / 100.0::DOUBLE AS low, arg_max(cents, seq) / 100.0::DOUBLE AS close,
           sum(l_quantity) AS volume, sum(l_quantity * cents) * 10 AS financial_volume,
           count(*) AS trades, tk, idx
    FROM (
        SELECT *, (l_orderkey * 10 + l_linenumber) * 100000 + cents AS seq
        FROM (
            SELECT *, 10000 + 5 * idx * (tk % 3 - 1) + 80 * abs((idx + 7 * tk) % 40 - 20)
                      + 8 * (l_partkey % 97 - 48) AS cents
            FROM (
                SELECT l_suppkey AS tk, l_orderkey, l_linenumber, l_partkey, l_quantity,
                       (date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) % 250 + 250) % 250 AS idx
                FROM lineitem
            ) AS keyed
        ) AS priced
    ) AS ordered
    GROUP BY tk, idx
    """,
)
cte(
    "bars",
    "SELECT ticker, session_date, open, high, low, close, volume, financial_volume, trades FROM indexed_bars",
    "indexed_bars",
)
cte(
    "daily",
    """
    SELECT ticker, session_date, open,
           CASE WHEN tk % 11 = 4 AND idx = 77 THEN low - 1 ELSE high END AS high, low,
           close + copy * 0.5::DOUBLE AS close,
           CASE WHEN tk % 7 = 3 AND idx % 61 = 0 THEN 0 ELSE volume END AS volume,
           CASE WHEN tk % 7 = 3 AND idx % 61 = 0 THEN 0 ELSE financial_volume END AS financial_volume,
           CAST(session_date AS TIMESTAMP) + to_hours(21 + copy) AS updated_at
    FROM indexed_bars, (VALUES (0), (1)) AS copies(copy)
    WHERE copy = 0 OR (tk % 5 = 0 AND idx % 50 = 0) OR (tk % 5 = 1 AND idx % 125 = 0)
    """,
    "indexed_bars",
)
cte(
    "tickers",
    """
    SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS ticker, s_name AS company,
           s_suppkey % 7 <> 6 AS active
    FROM supplier
    """,
)
cte(
    "holidays",
    """
    SELECT DATE '2024-01-01' + CAST((i // 5) * 7 + i % 5 AS INTEGER) AS holiday_date, i <> 60 AS active
    FROM range(250) AS r(i) WHERE i % 83 = 41 OR i = 60
    """,
)
cte(
    "quotes",
    """
    SELECT 'q' || CAST(user_id % 20 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS quote_date,
           strftime(ts, '%H:%M:%S') AS quote_time,
           CASE WHEN event_id % 97 <> 0 THEN value END AS price, event_id AS seq,
           date_trunc('second', ts) AS captured_at
    FROM events
    """,
)
# valid quotes with an event time, as the candle builder sees them
cte(
    "ticks",
    """
    SELECT upper(trim(ticker)) AS ticker, price, seq,
           CAST(CAST(quote_date AS VARCHAR) || ' ' || quote_time AS TIMESTAMP) AS ts
    FROM quotes WHERE price IS NOT NULL
    """,
    "quotes",
)
cte(
    "calendar",
    """
    SELECT d AS session_date, row_number() OVER (ORDER BY d) AS session_no
    FROM (SELECT CAST(g AS DATE) AS d
          FROM generate_series((SELECT min(session_date) FROM daily)::TIMESTAMP,
                               (SELECT max(session_date) FROM daily)::TIMESTAMP, INTERVAL 1 DAY) AS s(g)) AS days
    WHERE isodow(d) <= 5 AND d NOT IN (SELECT holiday_date FROM holidays WHERE active)
    """,
    "daily holidays",
)
