"""Queries over stored signals, operations views, paper trading and controlled operation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import ops, trading as tr
from ..operators import quality as ql
from .learning_queries import clean_bars, dataset_of
from .market_queries import cdl
from .registry import cte, query, sdiv
from .research_queries import dashboard_of, exposure_of, ranking_of, rk
from .signal_queries import AS_OF, METRICS_AS_OF, bar, baseline_of, eod_signals, eod_trades, trades_of
from .shared import shared
from .tables import Tables, stored

DAY = dt.date(2024, 9, 3)
NOW = dt.datetime(2024, 9, 4, 12, 0)
SIG = "reference_date valid_for ticker side entry:d target:d stop:d score:d rank:n"

# ------------------------------------------------------------------ checks on signals


cte(
    "limit_check",
    f"""
    SELECT 'signals_limits' AS check_name, *, CASE WHEN total = 0 OR total > 5 OR invalid_levels > 0 THEN 'FAIL'
                                                   ELSE 'PASS' END AS status
    FROM (SELECT count(*) AS total, count(*) FILTER (WHERE side NOT IN ('BUY', 'SELL')) AS invalid_side,
                 count(*) FILTER (WHERE side NOT IN ('BUY', 'SELL')
                     OR (side = 'BUY' AND (target <= entry OR stop >= entry))
                     OR (side = 'SELL' AND (target >= entry OR stop <= entry))) AS invalid_levels
          FROM eod_signals WHERE reference_date = DATE '{DAY}')
    """,
    "eod_signals",
)


@query("dq_signal_limits", "check_name status total:n invalid_side:n invalid_levels:n", "SELECT * FROM limit_check", "limit_check")
def _limits(t: Tables):
    return ql.dq_signal_limits(eod_signals(t), DAY)


@shared
def stored_metrics(t: Tables):
    stamp = F.lit("2024-09-02 22:05:00").cast("timestamp_ntz")
    return bar.backtest_metrics(eod_trades(t), METRICS_AS_OF).withColumn("created_at", stamp)


cte(
    "deadline_checks",
    f"""
    SELECT *, CASE WHEN reason IS NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM (
        SELECT *, CASE WHEN rows = 0 THEN missing WHEN last_created_at > deadline THEN late END AS reason FROM (
            SELECT 'signals_freshness' AS check_name, count(*) AS rows, max(created_at) AS last_created_at,
                   TIMESTAMP '{DAY} 19:30:00' AS deadline, 'missing_signals' AS missing, 'late_generation' AS late
            FROM eod_signals WHERE reference_date = DATE '{DAY}'
            UNION ALL
            SELECT 'backtest_metrics', count(*), max(TIMESTAMP '2024-09-02 22:05:00'),
                   TIMESTAMP '{METRICS_AS_OF} 22:30:00', 'missing_backtest', 'late_backtest' FROM emetrics))
    """,
    "eod_signals emetrics",
)


@query("dq_deadline_freshness", "check_name status rows:n last_created_at deadline reason", "SELECT * FROM deadline_checks", "deadline_checks")
def _deadlines(t: Tables):
    a = ql.dq_deadline_freshness(eod_signals(t), "reference_date", "signals_freshness", "signals",
                                 "missing_signals", "late_generation", DAY, "19:00:00", 30)
    b = ql.dq_deadline_freshness(stored_metrics(t), "as_of_date", "backtest_metrics", "metrics",
                                 "missing_backtest", "late_backtest", METRICS_AS_OF, "22:00:00", 30)
    return a.unionByName(b)


@shared
def checks_of(t: Tables):
    checks = [
        ql.dq_daily_freshness(t.daily, t.tickers, DAY, 0.9),
        ql.dq_daily_uniqueness(t.daily, dt.date(2024, 3, 11)),
        ql.dq_ohlc_validity(t.daily, dt.date(2024, 4, 17)),
        ql.dq_intraday_uniqueness(t.quotes, dt.date(2024, 1, 17), 2),
        ql.dq_intraday_freshness(t.quotes, t.tickers, dt.date(2024, 1, 17), "22:00:00", 0.1),
        ql.dq_signal_limits(eod_signals(t), DAY),
        _deadlines(t),
    ]
    return ql.dq_results(checks, DAY, "run-1")


cte(
    "check_rows",
    f"""
    SELECT DATE '{DAY}' AS check_date, 'run-1' AS run_id, *,
           CASE status WHEN 'PASS' THEN 'INFO' WHEN 'WARN' THEN 'WARNING' ELSE 'CRITICAL' END AS severity
    FROM (
        SELECT 'daily_freshness' AS check_name, 'daily' AS component, CASE WHEN e <= 0 THEN 'WARN'
               WHEN {sdiv('a', 'e')} >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status
        FROM (SELECT count(DISTINCT ticker) AS a FROM daily WHERE session_date = DATE '{DAY}'),
             (SELECT count(*) FILTER (WHERE active) AS e FROM tickers)
        UNION ALL
        SELECT 'daily_uniqueness', 'daily', CASE WHEN count(*) > count(DISTINCT ticker) THEN 'FAIL' ELSE 'PASS' END
        FROM daily WHERE session_date = DATE '2024-03-11'
        UNION ALL
        SELECT 'ohlc_validity', 'daily', CASE WHEN count(*) FILTER (WHERE high < greatest(open, close, low)
               OR low > least(open, close, high)) > 0 THEN 'FAIL' ELSE 'PASS' END
        FROM daily WHERE session_date = DATE '2024-04-17'
        UNION ALL
        SELECT 'intraday_uniqueness', 'intraday', CASE WHEN count(*) FILTER (WHERE c > 1) > 2 THEN 'FAIL'
               ELSE 'PASS' END
        FROM (SELECT count(*) AS c FROM quotes WHERE quote_date = DATE '2024-01-17' GROUP BY ticker, quote_time)
        UNION ALL
        SELECT 'intraday_freshness', 'intraday', CASE WHEN e <= 0 THEN 'WARN' WHEN {sdiv('a', 'e')} >= 0.1 THEN 'PASS' ELSE 'FAIL' END
        FROM (SELECT count(DISTINCT ticker) AS a FROM quotes WHERE quote_date = DATE '2024-01-17' AND quote_time >= '22:00:00'),
             (SELECT count(*) FILTER (WHERE active) AS e FROM tickers)
        UNION ALL SELECT check_name, 'signals', status FROM limit_check
        UNION ALL SELECT check_name, CASE check_name WHEN 'backtest_metrics' THEN 'metrics' ELSE 'signals' END, status FROM deadline_checks)
    """,
    "daily tickers quotes limit_check deadline_checks",
)


@query("dq_results", "check_date check_name component status severity run_id", "SELECT * FROM check_rows", "check_rows")
def _results(t: Tables):
    return checks_of(t)


@query(
    "dq_incidents",
    "incident_id check_name status severity",
    "SELECT *, CAST(check_date AS VARCHAR) || '_' || check_name || '_' || run_id AS incident_id FROM check_rows WHERE status = 'FAIL'",
    "check_rows",
)
def _incidents(t: Tables):
    return ql.dq_incidents(checks_of(t))


@query(
    "component_status",
    "component last_reference last_timestamp rows_today:n notes",
    f"""
    SELECT 'cotacao_ohlcv_diario' AS component, max(session_date) AS last_reference, max(updated_at) AS last_timestamp,
           count(*) FILTER (WHERE session_date = DATE '{DAY}') AS rows_today,
           'Último pregão: ' || CAST(max(session_date) AS VARCHAR) AS notes FROM daily
    UNION ALL SELECT 'cotacao_b3', max(quote_date), max(captured_at), count(*) FILTER (WHERE quote_date = DATE '{DAY}'),
           'Última hora registrada: ' || max(quote_time) FROM quotes
    UNION ALL SELECT 'sinais_eod', max(reference_date), max(created_at),
           count(*) FILTER (WHERE reference_date = DATE '{DAY}'),
           'Válidos para: ' || CAST(max(valid_for) AS VARCHAR) FROM eod_signals
    UNION ALL SELECT 'backtest_metrics', max(as_of_date), TIMESTAMP '2024-09-02 22:05:00',
           count(*) FILTER (WHERE as_of_date = DATE '{DAY}'),
           'Entradas avaliadas: ' || CAST(CAST(sum(signals) AS BIGINT) AS VARCHAR) FROM emetrics
    UNION ALL SELECT 'dq_checks_daily', max(check_date), TIMESTAMP '2024-09-03 23:00:00',
           count(*) FILTER (WHERE status = 'FAIL'), 'Último status: ' || max(status) FROM check_rows
    """,
    "daily quotes eod_signals emetrics check_rows",
)
def _components(t: Tables):
    stamp = F.lit("2024-09-03 23:00:00").cast("timestamp_ntz")
    checks = checks_of(t).withColumn("created_at", stamp)
    return ql.component_status(t.daily, t.quotes, eod_signals(t), stored_metrics(t), checks, DAY)


# ------------------------------------------------------------------ operations views

JOBS = "CASE {c} WHEN '1-URGENT' THEN 'intraday_fetch' WHEN '2-HIGH' THEN 'signals_eod' WHEN '3-MEDIUM' THEN 'backtest_daily' WHEN '5-LOW' THEN 'daily_ohlcv' ELSE 'dq_checks_daily' END"
cte(
    "runs",
    f"""SELECT {JOBS.format(c='o_orderpriority')} AS job_name, o_orderkey AS run_id,
               CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'RUNNING' ELSE 'WARN' END AS status,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished_at, o_orderdate AS started_at
        FROM orders""",
)


@shared
def runs(t: Tables):
    """Job runs out of the orders table."""
    state = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("WARN")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return t.read("orders").select(
        F.expr(JOBS.format(c="o_orderpriority")).alias("job_name"),
        F.col("o_orderkey").alias("run_id"),
        state.alias("status"),
        F.when(F.col("o_orderstatus") != "O", at).alias("finished_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        at.alias("started_at"),
    )


@shared
def job_config(t: Tables):
    row = ("cfg-1", 60, 30, 45, "18:00:00", "19:00:00", "22:00:00", "2024-01-01")
    return t.spark.createDataFrame(
        [row],
        "config_id string, intraday_max_staleness_minutes int, signals_grace_minutes int, backtest_grace_minutes int,"
        " intraday_latest_time string, signals_deadline string, backtest_deadline string, created_at string",
    )


JOB_NOW = dt.datetime(2001, 8, 2, 3, 0)
cte(
    "job_status",
    f"""
    SELECT *, date_diff('minute', last_run_at, TIMESTAMP '{JOB_NOW}') AS minutes_since_last_run,
           CAST('{JOB_NOW.date()} ' || CASE job_name WHEN 'intraday_fetch' THEN '18:00:00' WHEN 'signals_eod'
                THEN '19:00:00' WHEN 'backtest_daily' THEN '22:00:00' ELSE '21:00:00' END AS TIMESTAMP) AS deadline_at,
           date_diff('minute', last_run_at, TIMESTAMP '{JOB_NOW}') > CASE job_name WHEN 'intraday_fetch' THEN 60
                WHEN 'signals_eod' THEN 30 WHEN 'backtest_daily' THEN 45 WHEN 'daily_ohlcv' THEN 1440 ELSE 180 END
                AS is_silent
    FROM (SELECT job_name, coalesce(finished_at, started_at) AS last_run_at, status AS last_status,
                 run_id AS last_run_id FROM runs
          QUALIFY row_number() OVER (PARTITION BY job_name
                                     ORDER BY coalesce(finished_at, started_at) DESC, run_id DESC) = 1)
    """,
    "runs",
)


@shared
def jobs_of(t: Tables):
    return ops.ops_job_status(runs(t), job_config(t), JOB_NOW)


@query(
    "ops_job_status",
    "job_name last_run_at last_status minutes_since_last_run:n deadline_at is_silent:b last_run_id:n",
    "SELECT * FROM job_status",
    "job_status",
)
def _jobs(t: Tables):
    return jobs_of(t)


cte(
    "check_log",
    """SELECT CAST(ts AS DATE) AS check_date, event_type AS check_name, event_id,
              CASE WHEN value > 80 THEN 'FAIL' WHEN value > 50 THEN 'WARN' ELSE 'PASS' END AS status,
              CASE WHEN value > 80 THEN 'CRITICAL' ELSE 'INFO' END AS severity, date_trunc('second', ts) AS created_at
       FROM events""",
)


@shared
def check_log(t: Tables):
    """Check results and incidents out of the events table."""
    v, ts = F.col("value"), F.col("ts").cast("timestamp_ntz")
    return t.read("events").select(
        ts.cast("date").alias("check_date"),
        F.col("event_type").alias("check_name"),
        "event_id",
        F.when(v > 80, "FAIL").when(v > 50, "WARN").otherwise("PASS").alias("status"),
        F.when(v > 80, "CRITICAL").otherwise("INFO").alias("severity"),
        F.date_trunc("second", ts).cast("timestamp_ntz").alias("created_at"),
        F.to_json(F.struct("value")).alias("details"),
    )


LOG_DAY = dt.date(2024, 1, 28)


@query(
    "ops_dq_latest",
    "check_date check_name status created_at",
    f"""SELECT * FROM check_log WHERE check_date >= DATE '{LOG_DAY}' - 7
        ORDER BY created_at DESC, check_name, check_date LIMIT 200""",
    "check_log",
)
def _dq_latest(t: Tables):
    return ops.ops_dq_latest(check_log(t), LOG_DAY)


@query(
    "ops_incidents_open",
    "incident_id:n check_name severity source status created_at",
    """SELECT * FROM (SELECT event_id AS incident_id, check_name, severity, check_name AS source, created_at,
                             CASE WHEN event_id % 3 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status FROM check_log
                      WHERE status = 'FAIL')
       WHERE status = 'OPEN' OR incident_id % 5 = 0 ORDER BY created_at DESC, incident_id LIMIT 200""",
    "check_log",
)
def _open(t: Tables):
    rows = check_log(t).where("status = 'FAIL'").withColumns(
        {
            "incident_id": F.col("event_id"),
            "status": F.when(F.col("event_id") % 3 == 0, "OPEN").otherwise("CLOSED"),
            "resolved_at": F.when(F.col("event_id") % 5 != 0, F.col("created_at")),
            "job_name": F.lit(None).cast("string"),
        }
    )
    return ops.ops_incidents_open(rows)


@query(
    "ops_signals_history",
    SIG,
    f"SELECT * FROM eod_signals WHERE reference_date >= DATE '{DAY}' - 120",
    "eod_signals",
)
def _history(t: Tables):
    return ops.ops_signals_history(eod_signals(t), DAY, 120)


# the daily table as it stood on an evening
cte("daily_then", f"SELECT * FROM daily WHERE session_date <= DATE '{DAY}'", "daily")
cte(
    "next_day",
    f"""SELECT min(d) AS next_trading_day, any_value(last) AS last_trading_day
        FROM (SELECT max(session_date) AS last FROM daily_then), range(1, 11) AS r(i),
             LATERAL (SELECT last + CAST(i AS INTEGER) AS d) AS x
        WHERE isodow(d) <= 5 AND d NOT IN (SELECT holiday_date FROM holidays WHERE active)""",
    "daily_then holidays",
)
cte(
    "next_signals",
    "SELECT s.* FROM eod_signals AS s JOIN next_day ON valid_for = next_trading_day ORDER BY rank, ticker LIMIT 5",
    "eod_signals next_day",
)


@shared
def daily_then(t: Tables):
    return t.daily.where(F.col("session_date") <= F.lit(DAY))


@shared
def next_of(t: Tables):
    return ops.ops_signals_next_session(eod_signals(t), daily_then(t), t.holidays, DAY)


@query("ops_signals_next_session", SIG, "SELECT * FROM next_signals", "next_signals")
def _next(t: Tables):
    return next_of(t)


@query(
    "ops_overview",
    "last_trading_day next_trading_day job_health dq_health signals_ready:b signals_count:n last_signals_generated_at",
    """
    SELECT last_trading_day, next_trading_day, signals_count, last_signals_generated_at,
           signals_count > 0 AS signals_ready,
           CASE WHEN silent THEN 'FAIL' WHEN warn THEN 'WARN' ELSE 'OK' END AS job_health,
           CASE WHEN fail THEN 'FAIL' WHEN dq_warn THEN 'WARN' ELSE 'PASS' END AS dq_health
    FROM next_day, (SELECT bool_or(is_silent) AS silent, bool_or(last_status = 'WARN') AS warn FROM job_status),
         (SELECT bool_or(status = 'FAIL') AS fail, bool_or(status = 'WARN') AS dq_warn FROM check_rows),
         (SELECT count(*) AS signals_count, max(created_at) AS last_signals_generated_at FROM next_signals)
    """,
    "next_day job_status check_rows next_signals",
)
def _overview(t: Tables):
    return ops.ops_overview(jobs_of(t), checks_of(t), next_of(t), daily_then(t), t.holidays, NOW)


@query(
    "intraday_daily_counts",
    "data_ref total_rows:n",
    f"""SELECT quote_date AS data_ref, count(*) AS total_rows FROM quotes
        WHERE quote_date >= DATE '{LOG_DAY}' - 14 GROUP BY 1 ORDER BY 1 DESC LIMIT 14""",
    "quotes",
)
def _intraday_counts(t: Tables):
    return ops.row_counts_by_day(t.quotes, "quote_date", 14, LOG_DAY - dt.timedelta(days=14))


@query(
    "daily_table_counts",
    "data_ref total_rows:n",
    "SELECT session_date AS data_ref, count(*) AS total_rows FROM daily GROUP BY 1 ORDER BY 1 DESC LIMIT 20",
    "daily",
)
def _daily_counts(t: Tables):
    return ops.row_counts_by_day(t.daily, "session_date", 20)


@query(
    "latest_quotes",
    "ticker price:d quote_date quote_time captured_at",
    "SELECT * FROM quotes ORDER BY captured_at DESC, seq DESC LIMIT 50",
    "quotes",
)
def _latest_quotes(t: Tables):
    return ops.latest_quotes(t.quotes, 50)


@query(
    "candles_table_daily_counts",
    "table_name session_date total_rows:n",
    """
    SELECT n.table_name, r.session_date, coalesce(c, 0) AS total_rows
    FROM (SELECT DISTINCT session_date FROM daily
          ORDER BY session_date DESC LIMIT 10) AS r
    CROSS JOIN (VALUES ('candles_diarios'), ('candles_intraday_15m')) AS n(table_name)
    LEFT JOIN (SELECT 'candles_diarios' AS table_name, session_date, count(*) AS c FROM daily GROUP BY 2
               UNION ALL SELECT 'candles_intraday_15m', CAST(candle_at AS DATE), count(*) FROM candles_15m GROUP BY 2)
         AS k ON k.table_name = n.table_name AND k.session_date = r.session_date
    """,
    "daily candles_15m",
)
def _grid(t: Tables):
    quarter = cdl.candle_rows(cdl.build_intraday_candles(t.quotes))
    tables = {"candles_diarios": (t.daily, "session_date"), "candles_intraday_15m": (quarter, "reference_date")}
    return ops.candles_table_daily_counts(tables, t.daily, 10)


cte(
    "messages",
    """SELECT event_id AS message_id, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'click' THEN 'WARNING'
              ELSE 'INFO' END AS severity, 'Collector' || CAST(user_id % 5 AS VARCHAR) AS collector,
              CASE WHEN event_id % 2 = 0 THEN 'intraday' ELSE 'daily' END AS dataset, user_id AS records,
              date_trunc('second', ts) AS created_at FROM events""",
)


@shared
def messages(t: Tables):
    """Collector messages out of the events table."""
    kind = F.col("event_type")
    return t.read("events").select(
        F.col("event_id").alias("message_id"),
        F.when(kind == "error", "CRITICAL").when(kind == "click", "WARNING").otherwise("INFO").alias("severity"),
        F.concat(F.lit("Collector"), (F.col("user_id") % 5).cast("string")).alias("collector"),
        F.when(F.col("event_id") % 2 == 0, "intraday").otherwise("daily").alias("dataset"),
        F.col("user_id").alias("records"),
        F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("created_at"),
    )


@query(
    "collection_messages",
    "message_id:n severity collector created_at",
    """SELECT * FROM messages WHERE severity = 'CRITICAL' AND collector = 'Collector3'
       ORDER BY created_at DESC, message_id DESC LIMIT 100""",
    "messages",
)
def _messages(t: Tables):
    return ops.collection_messages(messages(t), "critical", "collector3 ", 100)


@query(
    "latest_message",
    "message_id:n dataset records:n created_at",
    "SELECT * FROM messages WHERE dataset = 'intraday' ORDER BY created_at DESC, message_id DESC LIMIT 1",
    "messages",
)
def _latest_message(t: Tables):
    return ops.latest_message(messages(t), "intraday")


@query(
    "message_day_totals",
    "data_ref total_rows:n",
    f"""SELECT CAST(created_at AS DATE) AS data_ref, sum(records) AS total_rows FROM messages
        WHERE dataset = 'intraday' AND CAST(created_at AS DATE) >= DATE '{LOG_DAY}' - 13
        GROUP BY 1 ORDER BY 1 DESC LIMIT 14""",
    "messages",
)
def _message_totals(t: Tables):
    return ops.message_day_totals(messages(t), "intraday", LOG_DAY - dt.timedelta(days=13), 14)


@query(
    "signals_by_date",
    f"{SIG} next_day_high:d next_day_low:d",
    f"""SELECT s.*, d.high AS next_day_high, d.low AS next_day_low FROM eod_signals AS s
        LEFT JOIN dedup AS d ON d.ticker = s.ticker AND d.session_date = s.valid_for
        WHERE reference_date = DATE '{DAY}'""",
    "eod_signals dedup",
)
def _by_date(t: Tables):
    return ops.signals_by_date(eod_signals(t), clean_bars(t), DAY)


@query(
    "signals_next_fallback",
    SIG,
    """SELECT * FROM eod_signals WHERE valid_for = (SELECT max(valid_for) FROM eod_signals)
       ORDER BY rank, score DESC, created_at DESC, ticker LIMIT 5""",
    "eod_signals",
)
def _fallback(t: Tables):
    return ops.signals_next_fallback(eod_signals(t))


@query(
    "signals_history_range",
    SIG,
    """SELECT * FROM eod_signals WHERE reference_date BETWEEN DATE '2024-05-06' AND DATE '2024-05-17'
              OR valid_for BETWEEN DATE '2024-05-06' AND DATE '2024-05-17'
       ORDER BY reference_date DESC, rank, created_at DESC, ticker LIMIT 30""",
    "eod_signals",
)
def _range(t: Tables):
    return ops.signals_history_range(eod_signals(t), dt.date(2024, 5, 6), dt.date(2024, 5, 17), 30)


@query(
    "latest_backtest_trades",
    "reference_date ticker side entry:d exit_price:d exit_reason return_pct:d days_in_trade:n",
    """SELECT *, date_diff('day', entry_fill_date, exit_date) AS days_in_trade FROM etrades
       ORDER BY created_at DESC, ticker, side LIMIT 40""",
    "etrades",
)
def _latest_trades(t: Tables):
    return ops.latest_backtest_trades(eod_trades(t), 40)


@query(
    "signals_per_ticker",
    "ticker signals:n",
    f"SELECT ticker, count(*) AS signals FROM bsignals WHERE reference_date = DATE '{DAY}' GROUP BY 1",
    "bsignals",
)
def _per_ticker(t: Tables):
    return ops.signals_per_ticker(baseline_of(t), DAY)


@query(
    "ops_read",
    "dataset_split rows_count:n",
    """SELECT dataset_split, count(*) AS rows_count FROM dataset GROUP BY 1
       ORDER BY CASE dataset_split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'test' THEN 3 ELSE 4 END LIMIT 3""",
    "dataset",
)
def _read(t: Tables):
    view = dataset_of(t).groupBy("dataset_split").agg(F.count(F.lit(1)).alias("rows_count"))
    return ops.ops_read(view, [ops.split_order()], 3)


# ------------------------------------------------------------------ paper trading

cte(
    "paper_orders",
    """
    SELECT 'paper:' || signal_id AS paper_order_id, *, entry_timestamp AS opened_at,
           CASE WHEN days_in_trade % 7 = 0 THEN 'aberta' WHEN exit_reason = 'expiration' THEN 'expire'
                ELSE exit_reason END AS order_status,
           CASE WHEN day(reference_date) % 9 <> 0 THEN expected_entry_price END AS simulated_entry_price,
           mfe_pct - gross_pnl_pct AS divergence_pct, gross_pnl_pct AS expected_backtest_pnl_pct,
           CASE WHEN days_in_trade % 7 <> 0 THEN net_pnl_pct END AS paid
    FROM btrades
    """,
    "btrades",
)


@shared
def paper_orders(t: Tables):
    """Paper orders out of the baseline trades."""
    still_open = F.col("days_in_trade") % 7 == 0
    return trades_of(t).withColumns(
        {
            "paper_order_id": F.concat(F.lit("paper:"), "signal_id"),
            "opened_at": F.col("entry_timestamp"),
            "closed_at": F.col("exit_timestamp"),
            "order_status": F.when(still_open, "aberta")
            .when(F.col("exit_reason") == "expiration", "expire")
            .otherwise(F.col("exit_reason")),
            "simulated_entry_price": F.when(F.dayofmonth("reference_date") % 9 != 0, F.col("entry_price_filled")),
            "divergence_pct": F.col("mfe_pct") - F.col("gross_pnl_pct"),
            "expected_backtest_pnl_pct": F.col("gross_pnl_pct"),
            "net_pnl_pct": F.when(~still_open, F.col("net_pnl_pct")),
        }
    )


OPEN_ = "order_status IN ('aberta', 'entrada_simulada')"
CLOSED_ = "order_status IN ('encerrada', 'stop', 'target', 'expire', 'time_stop')"


@shared
def paper_config(t: Tables):
    rows = [("paper_core", "v1", 5, 100, 0.0005, 0.001, "em_teste", "2024-01-01"),
            ("paper_old", "v1", 9, 10, 0.1, 0.1, "inativa", "2023-01-01")]
    return t.spark.createDataFrame(
        rows,
        "config_id string, config_version string, max_daily_orders int, default_quantity int, default_cost_pct double,"
        " default_slippage_pct double, status string, updated_at string",
    ).withColumnRenamed("config_version", "paper_config_version")


@query(
    "paper_candidate_signals",
    "signal_id ticker side reference_date regime_label exposure_action max_trades_per_day:n default_quantity:n paper_signal_status",
    f"""
    SELECT s.*, e.market_regime AS regime_label, e.exposure_action, coalesce(e.max_trades, 5) AS max_trades_per_day,
           100 AS default_quantity,
           CASE WHEN exposure_action = 'ficar_em_caixa' THEN 'filtrado_regime_caixa'
                WHEN exposure_action = 'bloquear_compras' AND side = 'BUY' THEN 'filtrado_bloqueio_compra'
                ELSE 'candidato_paper' END AS paper_signal_status
    FROM bsignals AS s LEFT JOIN exposure AS e USING (reference_date)
    WHERE s.reference_date >= DATE '{DAY}' - 10
    """,
    "bsignals exposure",
)
def _candidates(t: Tables):
    return tr.paper_candidate_signals(baseline_of(t), exposure_of(t), paper_config(t), DAY)


_STATES = "('aberta', 1, 0), ('entrada_simulada', 1, 0), ('encerrada', 0, 1), ('stop', 0, 1), ('target', 0, 1), ('expire', 0, 1), ('time_stop', 0, 1)"
cte(
    "order_states",
    f"""SELECT p.*, coalesce(is_open, 0) AS is_open, coalesce(is_closed, 0) AS is_closed, (simulated_entry_price IS NOT NULL)::INT AS filled
        FROM paper_orders AS p LEFT JOIN (VALUES {_STATES}) AS s(order_status, is_open, is_closed) USING (order_status)""",
    "paper_orders",
)
cte(
    "paper_days",
    """
    SELECT d.*, (SELECT sum(coalesce(paid, 0)) FROM order_states AS o WHERE o.reference_date <= d.reference_date) AS accumulated_net_pnl_pct,
           coalesce((SELECT min_by(name, place) FROM (VALUES (1, 'divergencia_alta', avg_abs_divergence_pct > 0.03), (2, 'baixa_execucao', execution_rate < 0.8))
                         AS r(place, name, holds) WHERE holds), 'aderente') AS adherence_status
    FROM (SELECT reference_date, sum(is_open) AS open_orders, sum(is_closed) AS closed_orders, count(*) AS total_orders, sum(coalesce(paid, 0)) AS daily_net_pnl_pct,
                 avg(slippage_pct) AS avg_slippage_pct, avg(abs(divergence_pct)) AS avg_abs_divergence_pct, avg(filled) AS execution_rate
          FROM order_states GROUP BY 1) AS d
    """,
    "order_states",
)
PAPER_DAY = """reference_date open_orders:n closed_orders:n total_orders:n daily_net_pnl_pct:d avg_slippage_pct:d
               avg_abs_divergence_pct:d execution_rate:d accumulated_net_pnl_pct:d adherence_status"""


@query("paper_dashboard", PAPER_DAY, "SELECT * FROM paper_days", "paper_days")
def _paper_days(t: Tables):
    return tr.paper_dashboard(paper_orders(t), 0.03)


@query(
    "paper_open_orders",
    "paper_order_id ticker order_status opened_at",
    f"SELECT * FROM paper_orders WHERE {OPEN_}",
    "paper_orders",
)
def _open_orders(t: Tables):
    return tr.paper_open_orders(paper_orders(t))


@query(
    "paper_closed_today",
    "paper_order_id ticker order_status net_pnl_pct:d",
    f"SELECT * EXCLUDE (net_pnl_pct), paid AS net_pnl_pct FROM paper_orders WHERE {CLOSED_} AND reference_date = DATE '{DAY}'",
    "paper_orders",
)
def _closed_today(t: Tables):
    return tr.paper_closed_today(paper_orders(t), DAY)


@query(
    "paper_adherence",
    """strategy_id ticker paper_trades:n expected_backtest_pnl_pct:d realized_paper_pnl_pct:d avg_divergence_pct:d
       avg_abs_divergence_pct:d execution_rate:d adherence_status""",
    """
    SELECT *, coalesce((SELECT min_by(name, place) FROM (VALUES (1, 'amostra_paper_insuficiente', paper_trades < 20), (2, 'divergencia_explicar', avg_abs_divergence_pct > 0.5),
                            (3, 'aderente_positivo', realized_paper_pnl_pct > 0 AND avg_abs_divergence_pct IS NOT NULL)) AS r(place, name, holds) WHERE holds), 'paper_negativo') AS adherence_status
    FROM (SELECT strategy_id, ticker, len(q) AS paper_trades, list_avg([x.b for x in q]) AS expected_backtest_pnl_pct, list_avg([x.p for x in q]) AS realized_paper_pnl_pct,
                 list_avg([x.d for x in q]) AS avg_divergence_pct, list_avg([abs(x.d) for x in q]) AS avg_abs_divergence_pct, list_avg([x.f for x in q]) AS execution_rate
          FROM (SELECT strategy_id, ticker, list({'b': expected_backtest_pnl_pct, 'p': paid, 'd': divergence_pct, 'f': filled}) AS q FROM order_states WHERE is_closed = 1 GROUP BY 1, 2))
    """,
    "order_states",
)
def _adherence(t: Tables):
    return tr.paper_adherence(paper_orders(t))


@query(
    "paper_metrics",
    """model_version reference_date total_orders:n open_orders:n closed_orders:n fill_rate:d avg_return_pct:d
       profit_factor:d win_rate:d avg_abs_backtest_divergence_pct:d""",
    f"""
    SELECT strategy_version AS model_version, reference_date, count(*) AS total_orders,
           count(*) FILTER (WHERE {OPEN_}) AS open_orders, count(*) FILTER (WHERE {CLOSED_}) AS closed_orders,
           {sdiv('count(simulated_entry_price)', 'count(*)')} AS fill_rate, avg(paid) AS avg_return_pct,
           coalesce(sum(paid) FILTER (WHERE paid > 0), 0) / nullif(abs(sum(paid) FILTER (WHERE paid < 0)), 0)
               AS profit_factor,
           {sdiv('count(*) FILTER (WHERE paid > 0)', 'count(paid)')} AS win_rate,
           avg(abs(divergence_pct)) AS avg_abs_backtest_divergence_pct
    FROM paper_orders WHERE strategy_family = 'momentum_diario' GROUP BY 1, 2
    """,
    "paper_orders",
)
def _paper_metrics(t: Tables):
    return tr.paper_metrics(paper_orders(t), "momentum_diario")


@query(
    "operational_diary",
    "decision_id event_timestamp strategy_id ticker",
    f"""SELECT trade_id AS decision_id, signal_timestamp AS event_timestamp, strategy_id, ticker FROM btrades
        WHERE reference_date >= DATE '{DAY}' - 30""",
    "btrades",
)
def _diary(t: Tables):
    log = trades_of(t).withColumns({"decision_id": F.col("trade_id"), "event_timestamp": F.col("signal_timestamp")})
    return tr.operational_diary(log, DAY)


@query(
    "build_paper_orders",
    "reference_date valid_for ticker side expected_entry_price:d simulated_entry_price:d notional_brl:d order_status",
    """
    SELECT *, entry AS expected_entry_price, 'aberta' AS order_status,
           entry * CASE side WHEN 'BUY' THEN 1.001::DOUBLE ELSE 0.999::DOUBLE END AS simulated_entry_price,
           entry * CASE side WHEN 'BUY' THEN 1.001::DOUBLE ELSE 0.999::DOUBLE END * 100 AS notional_brl
    FROM eod_signals WHERE rank <= 3
    """,
    "eod_signals",
)
def _orders(t: Tables):
    return tr.build_paper_orders(eod_signals(t), "run-1", max_orders=3)


# ------------------------------------------------------------------ controlled operation


@shared
def risk_config(t: Tables):
    row = ("risk_core", 40.0, 20, 30, 100000.0, 0.02, 0.04, 10, True, "ativa", "2024-01-01")
    return t.spark.createDataFrame(
        [row],
        "risk_config_id string, min_robustness_score double, min_paper_days int, min_paper_trades int,"
        " max_capital_brl double, max_daily_loss_pct double, max_weekly_loss_pct double, max_open_positions int,"
        " auto_pause_on_limit_breach boolean, status string, updated_at string",
    )


@shared
def checklist(t: Tables):
    rows = [("baseline_daily_momentum_v1", "v1", "piloto", "aprovar", True, "2024-01-02"),
            ("baseline_daily_momentum_v1", "v1", "pesquisa", "pausar", False, "2024-01-01"),
            ("baseline_gap_fade_v1", "v1", "paper", "reprovar", True, "2024-01-02")]
    return t.spark.createDataFrame(
        rows,
        "strategy_id string, strategy_version string, approval_status string, manual_decision string,"
        " risk_limits_ok boolean, updated_at string",
    )


@query(
    "strategy_committee",
    """strategy_id approval_status trades:n expectancy_net_pct:d max_drawdown_pct:d robustness_score:d paper_days:n
       paper_trades:n paper_expectancy_net_pct:d min_sample_ok:b positive_expectancy_ok:b drawdown_ok:b
       oos_validation_ok:b robustness_ok:b paper_trading_ok:b risk_limits_ok:b manual_decision recommended_status""",
    """
    SELECT *, (SELECT min_by(name, place) FROM (VALUES (1, 'reprovada', manual_decision = 'reprovar'), (2, 'pausada', manual_decision = 'pausar'),
                   (3, 'piloto', manual_decision = 'aprovar' AND list_bool_and(checks)), (4, 'paper_trading', paper_days > 0), (5, 'validacao', robustness_score > 0),
                   (6, 'pesquisa', TRUE)) AS r(place, name, holds) WHERE holds) AS recommended_status,
           checks[1] AS min_sample_ok, checks[2] AS positive_expectancy_ok, checks[3] AS drawdown_ok, checks[4] AS oos_validation_ok, checks[5] AS robustness_ok,
           checks[6] AS paper_trading_ok, checks[7] AS risk_limits_ok
    FROM (SELECT m.*, r.robustness_score AS robustness, p.* EXCLUDE (strategy_id), coalesce(state, 'pesquisa') AS approval_status, coalesce(decision, 'pendente') AS manual_decision,
                 [m.trades >= 30, m.expectancy_net_pct > 0, m.max_drawdown_pct >= -0.2, r.oos_status = 'aprovado_oos', r.robustness_score >= 40,
                  coalesce(len(days) >= 20 AND paper_trades >= 30 AND paper_expectancy_net_pct > 0, FALSE), coalesce(within, FALSE)] AS checks, len(days) AS paper_days
          FROM (SELECT * EXCLUDE (robustness_score) FROM bmetrics) AS m LEFT JOIN dashboard AS r USING (strategy_id)
          LEFT JOIN (SELECT strategy_id, list(DISTINCT reference_date) AS days, count(*) AS paper_trades, avg(paid) AS paper_expectancy_net_pct
                     FROM order_states WHERE is_closed = 1 GROUP BY 1) AS p USING (strategy_id)
          LEFT JOIN (VALUES ('baseline_daily_momentum_v1', 'piloto', 'aprovar', TRUE), ('baseline_gap_fade_v1', 'paper', 'reprovar', TRUE))
               AS c(strategy_id, state, decision, within) USING (strategy_id)) AS j,
         LATERAL (SELECT j.robustness AS robustness_score)
    """,
    "bmetrics dashboard order_states",
)
def _committee(t: Tables):
    metrics = bar.baseline_metrics(trades_of(t), AS_OF)
    return tr.strategy_committee(metrics, dashboard_of(t), paper_orders(t), checklist(t), risk_config(t))


cte(
    "risk_snapshots",
    """
    SELECT c_custkey AS snapshot_id, CASE WHEN c_custkey % 5 <> 0 THEN 's' || CAST(c_custkey % 40 AS VARCHAR) END
               AS strategy_id, CASE WHEN c_custkey % 3 <> 0 THEN 't' || CAST(c_custkey % 30 AS VARCHAR) END AS ticker,
           c_mktsegment AS sector, DATE '2024-08-20' + CAST(c_custkey % 15 AS INTEGER) AS reference_date,
           CAST(DATE '2024-08-20' + CAST(c_custkey % 15 AS INTEGER) AS TIMESTAMP) + to_hours(CAST(c_custkey % 24 AS INTEGER))
               AS snapshot_timestamp,
           (c_custkey % 60 - 40) / 1000.0::DOUBLE AS daily_pnl_pct,
           (c_custkey % 90 - 60) / 1000.0::DOUBLE AS weekly_pnl_pct, c_custkey % 13 AS open_positions,
           CASE WHEN c_custkey % 11 = 0 THEN 'max_daily_loss_pct' END AS breached_limit
    FROM customer
    """,
)


@shared
def risk_snapshots(t: Tables):
    """Risk snapshots out of the customer table."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit(dt.date(2024, 8, 20)), (k % 15).cast("int"))
    return t.read("customer").select(
        k.alias("snapshot_id"),
        F.when(k % 5 != 0, F.concat(F.lit("s"), (k % 40).cast("string"))).alias("strategy_id"),
        F.when(k % 3 != 0, F.concat(F.lit("t"), (k % 30).cast("string"))).alias("ticker"),
        F.col("c_mktsegment").alias("sector"),
        day.alias("reference_date"),
        (day.cast("timestamp_ntz") + F.make_dt_interval(hours=k % 24)).alias("snapshot_timestamp"),
        ((k % 60 - 40) / 1000).alias("daily_pnl_pct"),
        ((k % 90 - 60) / 1000).alias("weekly_pnl_pct"),
        (k % 13).alias("open_positions"),
        F.when(k % 11 == 0, "max_daily_loss_pct").alias("breached_limit"),
    )


# place, risk status, action
_RISKS = """(1, 'limite_violado', 'pausar_estrategia_imediatamente', breached_limit IS NOT NULL), (2, 'perto_limite_diario', 'reduzir_exposicao', daily_pnl_pct <= -0.8::DOUBLE * 0.02::DOUBLE),
            (3, 'perto_limite_semanal', 'monitorar', weekly_pnl_pct <= -0.8::DOUBLE * 0.04::DOUBLE), (4, 'limite_posicoes_atingido', 'monitorar', open_positions >= 10),
            (5, 'dentro_dos_limites', 'monitorar', TRUE)"""
cte(
    "limits",
    f"""
    SELECT n.*, (SELECT min_by(name, place) FROM (VALUES {_RISKS}) AS r(place, name, action, holds) WHERE holds) AS risk_status,
           (SELECT min_by(action, place) FROM (VALUES {_RISKS}) AS r(place, name, action, holds) WHERE holds) AS recommended_action
    FROM risk_snapshots AS n
    JOIN (SELECT arg_max(snapshot_id, row(snapshot_timestamp, -snapshot_id)) AS snapshot_id FROM risk_snapshots WHERE reference_date >= DATE '{DAY}' - 7
          GROUP BY coalesce(strategy_id, ''), coalesce(ticker, ''), sector) USING (snapshot_id)
    """,
    "risk_snapshots",
)
LIMIT_COLS = "snapshot_id:n strategy_id ticker sector snapshot_timestamp daily_pnl_pct:d risk_status recommended_action"


@query("risk_limits", LIMIT_COLS, "SELECT * FROM limits", "limits")
def _risk(t: Tables):
    return tr.risk_limits(risk_snapshots(t), risk_config(t), DAY)


@query("shutdown_alerts", LIMIT_COLS, "SELECT * FROM limits WHERE risk_status <> 'dentro_dos_limites'", "limits")
def _shutdown(t: Tables):
    return tr.shutdown_alerts(tr.risk_limits(risk_snapshots(t), risk_config(t), DAY))


def _decide(score: str, blocking: str) -> str:
    return f"""CASE WHEN {blocking} OR {score} < 35 THEN 'blocked' WHEN {score} >= 80 THEN 'approved_candidate'
                    WHEN {score} >= 65 THEN 'paper_trading_candidate' ELSE 'observe' END AS decision"""


_strong = "(decile_return_correlation > 0.25 AND top_minus_bottom_decile_return_5d > 0)"


@query(
    "daily_evaluation",
    "evaluation_type subject_id score:d decision status reasons:a",
    f"""
    SELECT 'ranking' AS evaluation_type, subject_id, score, {_decide('score', 'blocking')}, status,
           CASE WHEN len(reasons) = 0 THEN ['ranking_aprovado_pelos_criterios_diarios'] ELSE reasons END AS reasons
    FROM (SELECT ranking_model_id AS subject_id, ranking_status AS status,
                 CASE WHEN portfolio_days >= 60 THEN 20 ELSE 0 END
                 + CASE WHEN positive_day_rate >= 0.5 THEN least(25, positive_day_rate * 35) ELSE 0 END
                 + CASE WHEN avg_excess_vs_random_5d > 0 THEN 25 ELSE 0 END
                 + CASE WHEN {_strong} THEN 30 WHEN decile_return_correlation <= 0 THEN 0 ELSE 10 END AS score,
                 NOT {_strong} AND decile_return_correlation <= 0 AS blocking,
                 list_filter([CASE WHEN portfolio_days < 60 THEN 'amostra_insuficiente_ranking' END,
                     CASE WHEN positive_day_rate < 0.5 THEN 'taxa_positiva_baixa' END,
                     CASE WHEN avg_excess_vs_random_5d <= 0 THEN 'nao_supera_aleatorio' END,
                     CASE WHEN NOT {_strong} THEN CASE WHEN decile_return_correlation <= 0 THEN 'sem_monotonicidade'
                               ELSE 'monotonicidade_fraca' END END], lambda x: x IS NOT NULL) AS reasons
          FROM ranking_quality)
    UNION ALL
    SELECT 'strategy_robustness', strategy_id, robustness_score,
           {_decide('robustness_score', "(overfitting_alerts <> '' AND robustness_score < 65)")}, oos_status,
           CASE WHEN overfitting_alerts = '' THEN ['robustez_aprovada_pelos_criterios_diarios']
                ELSE string_split(overfitting_alerts, ',') END
    FROM dashboard
    UNION ALL
    SELECT 'paper_trading', 'paper_trading_dashboard', score, {_decide('score', "status = 'divergencia_alta'")}, status,
           CASE WHEN len(reasons) = 0 THEN ['paper_trading_aprovado_pelos_criterios_diarios'] ELSE reasons END
    FROM (SELECT adherence_status AS status, 20 + CASE WHEN adherence_status = 'aderente' THEN 35 ELSE 0 END
                 + least(25, execution_rate * 25) + CASE WHEN daily_net_pnl_pct > 0 THEN 20 ELSE 0 END AS score,
                 list_filter([CASE WHEN adherence_status <> 'aderente' THEN 'aderencia_' || adherence_status END,
                     CASE WHEN daily_net_pnl_pct <= 0 THEN 'pnl_diario_nao_positivo' END],
                     lambda x: x IS NOT NULL) AS reasons
          FROM paper_days ORDER BY reference_date DESC LIMIT 1)
    """,
    "ranking_quality dashboard paper_days",
)
def _evaluate(t: Tables):
    t = stored(t)
    ranking = rk.ranking_performance(ranking_of(t))
    return tr.daily_evaluation(ranking, dashboard_of(t), tr.paper_dashboard(paper_orders(t), 0.03))
