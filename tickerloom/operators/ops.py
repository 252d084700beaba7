"""Operational views: job status, signal and check listings, row counts, messages, overview."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import status_chain
from ..functions.frames import first_rows, with_one_row
from .calendar import next_open_day

#: Default page of the reads below; None reads all.
PAGE = 200


def ops_job_status(runs: DataFrame, config: DataFrame, now: dt.datetime) -> DataFrame:
    """Latest run per job, silence against the job's threshold, today's deadline.

    Each job collapses to one row by a max-by aggregate with map-side combine.
    """
    at = F.coalesce("finished_at", "updated_at", "started_at")
    last = runs.groupBy("job_name").agg(F.max_by(F.struct(at.alias("at"), "status", "run_id"), F.struct(at, "run_id")).alias("r"))
    newest = config.orderBy(F.desc("created_at")).limit(1)
    job = F.col("job_name")
    limit = status_chain(
        [
            (job == "intraday_fetch", F.col("intraday_max_staleness_minutes")),
            (job == "signals_eod", F.col("signals_grace_minutes")),
            (job == "backtest_daily", F.col("backtest_grace_minutes")),
            (job == "daily_ohlcv", F.lit(1440)),
        ],
        F.lit(180),
    )
    deadline = status_chain(
        [
            (job == "intraday_fetch", F.col("intraday_latest_time")),
            (job == "signals_eod", F.col("signals_deadline")),
            (job == "backtest_daily", F.col("backtest_deadline")),
        ],
        F.lit("21:00:00"),
    )
    day = now.date().isoformat()
    minutes = F.timestamp_diff("MINUTE", F.col("r.at"), F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz"))
    return with_one_row(last, newest).select(
        "job_name",
        F.col("r.at").alias("last_run_at"),
        F.col("r.status").alias("last_status"),
        minutes.alias("minutes_since_last_run"),
        F.concat(F.lit(f"{day} "), F.coalesce(deadline, F.lit("21:00:00"))).cast("timestamp_ntz").alias("deadline_at"),
        F.coalesce(minutes > F.coalesce(limit, F.lit(180)), F.lit(True)).alias("is_silent"),
        F.col("r.run_id").alias("last_run_id"),
    )


def _since(df: DataFrame, day: str, as_of: dt.date, days: int) -> DataFrame:
    return df.where(F.col(day) >= F.lit(as_of - dt.timedelta(days=days)))


def ops_dq_latest(checks: DataFrame, as_of: dt.date, days: int = 7, limit: int | None = PAGE) -> DataFrame:
    return first_rows(_since(checks, "check_date", as_of, days), [F.desc("created_at"), "check_name", "check_date"], limit)


def ops_signals_history(signals: DataFrame, as_of: dt.date, days: int = 365) -> DataFrame:
    return _since(signals, "reference_date", as_of, days).orderBy(F.desc("reference_date"), "rank")


def ops_incidents_open(incidents: DataFrame, limit: int | None = PAGE) -> DataFrame:
    unresolved = F.col("status").isin("OPEN", "INVESTIGATING") | F.col("resolved_at").isNull()
    shown = incidents.where(unresolved).withColumn("source", F.coalesce("job_name", "check_name", F.lit("unknown")))
    return first_rows(shown, [F.desc("created_at"), "incident_id"], limit)


def _trading_days(daily: DataFrame, holidays: DataFrame, today: dt.date) -> DataFrame:
    last = daily.agg(F.coalesce(F.max("session_date"), F.lit(today)).alias("last_trading_day"))
    return with_one_row(last, next_open_day(last, holidays))


def ops_signals_next_session(signals, daily, holidays, today: dt.date, limit: int = 5) -> DataFrame:
    """Best-ranked signals valid for the first open day after the last traded one."""
    days = _trading_days(daily, holidays, today).select("next_trading_day")
    due = signals.join(F.broadcast(days), signals.valid_for == days.next_trading_day)
    return due.orderBy("rank", "ticker").limit(limit)


def ops_overview(job_status, checks, signals_next, daily, holidays, now: dt.datetime) -> DataFrame:
    """One row: worst-of health of jobs and checks, readiness of the next session's signals."""

    def any_status(c: str, *values: str) -> Column:
        return F.coalesce(F.bool_or(F.upper(c).isin(*values)), F.lit(False))

    failed = ("FAIL", "ERROR", "CRITICAL")
    jobs = job_status.agg(
        F.coalesce(F.bool_or("is_silent"), F.lit(False)).alias("_silent"),
        any_status("last_status", *failed).alias("_fail"),
        any_status("last_status", "WARN", "WARNING").alias("_warn"),
    )
    dq = checks.agg(any_status("status", *failed).alias("_dq_fail"), any_status("status", "WARN").alias("_dq_warn"))
    ready = signals_next.agg(
        F.count(F.lit(1)).alias("signals_count"), F.max("created_at").alias("last_signals_generated_at")
    )
    days = _trading_days(daily, holidays, now.date())
    row = with_one_row(with_one_row(with_one_row(days, jobs), dq), ready)
    return row.select(
        F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz").alias("as_of"),
        "last_trading_day",
        F.coalesce("next_trading_day", "last_trading_day").alias("next_trading_day"),
        status_chain([(F.col("_silent") | F.col("_fail"), "FAIL"), (F.col("_warn"), "WARN")], "OK").alias("job_health"),
        status_chain([(F.col("_dq_fail"), "FAIL"), (F.col("_dq_warn"), "WARN")], "PASS").alias("dq_health"),
        (F.col("signals_count") > 0).alias("signals_ready"),
        "signals_count",
        "last_signals_generated_at",
    )


def row_counts_by_day(df: DataFrame, day: str, limit: int, since: dt.date | None = None) -> DataFrame:
    """Rows per day, newest days first."""
    if since is not None:
        df = df.where(F.col(day) >= F.lit(since))
    counts = df.groupBy(F.col(day).alias("data_ref")).agg(F.count(F.lit(1)).alias("total_rows"))
    return counts.orderBy(F.desc("data_ref")).limit(limit)


def latest_quotes(quotes: DataFrame, limit: int) -> DataFrame:
    stamp = F.concat_ws(" ", F.col("quote_date").cast("string"), "quote_time").try_cast("timestamp_ntz")
    shown = quotes.select("ticker", "price", "quote_date", "quote_time", F.coalesce("captured_at", stamp).alias("captured_at"), "seq")
    return shown.orderBy(F.desc("captured_at"), F.desc("seq")).limit(max(limit, 1))


def candles_table_daily_counts(tables: dict[str, tuple[DataFrame, str]], sessions: DataFrame, lookback: int) -> DataFrame:
    """Dense grid of tables x recent sessions with row counts; an absent cell is 0."""
    recent = sessions.select("session_date").distinct().orderBy(F.desc("session_date")).limit(lookback)
    names = F.explode(F.array(*[F.lit(n) for n in tables]))
    counts = None
    for name, (df, day) in tables.items():
        part = df.groupBy(F.col(day).alias("session_date")).agg(F.count(F.lit(1)).alias("total_rows"))
        part = part.withColumn("table_name", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    return (
        recent.withColumn("table_name", names)
        .join(counts, ["table_name", "session_date"], "left")
        .withColumn("total_rows", F.coalesce("total_rows", F.lit(0)))
    )


def collection_messages(messages: DataFrame, severity: str | None = None, collector: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest messages first, optionally by severity and collector."""
    if severity:
        messages = messages.where(F.upper("severity") == severity.strip().upper())
    if collector and collector.strip():
        messages = messages.where(F.lower("collector") == collector.strip().lower())
    ordered = messages.orderBy(F.desc("created_at"), F.desc("message_id"))
    return ordered.limit(limit) if limit and limit > 0 else ordered


def latest_message(messages: DataFrame, dataset: str) -> DataFrame:
    """Newest message about one dataset; at most one row."""
    return collection_messages(messages.where(F.lower("dataset") == dataset), limit=1)


def message_day_totals(messages: DataFrame, dataset: str, since: dt.date, limit: int) -> DataFrame:
    """Records reported per day by the messages of one dataset."""
    rows = messages.where((F.lower("dataset") == dataset) & (F.to_date("created_at") >= F.lit(since)))
    totals = rows.groupBy(F.to_date("created_at").alias("data_ref")).agg(
        F.sum(F.coalesce("records", F.lit(0))).alias("total_rows")
    )
    return totals.orderBy(F.desc("data_ref")).limit(limit)


def signals_by_date(signals: DataFrame, daily: DataFrame, day: dt.date) -> DataFrame:
    """A day's signals with high and low of the session they are valid for."""
    bars = daily.select(
        "ticker",
        F.col("session_date").alias("valid_on"),
        F.col("high").alias("next_day_high"),
        F.col("low").alias("next_day_low"),
    )
    rows = signals.where(F.col("reference_date") == F.lit(day)).withColumn(
        "valid_on", F.coalesce("valid_for", "reference_date")
    )
    return rows.join(bars, ["ticker", "valid_on"], "left").orderBy(
        F.asc_nulls_last("rank"), F.desc_nulls_last("score"), "ticker"
    )


def signals_next_fallback(signals: DataFrame, limit: int = 5) -> DataFrame:
    """Signals of the newest validity date."""
    rows = signals.withColumn("valid_on", F.coalesce("valid_for", "reference_date"))
    newest = rows.agg(F.max("valid_on").alias("valid_on"))
    return (
        rows.join(F.broadcast(newest), "valid_on")
        .orderBy(F.asc_nulls_last("rank"), F.desc_nulls_last("score"), F.desc("created_at"), "ticker")
        .limit(limit)
    )


def signals_history_range(signals: DataFrame, first: dt.date, last: dt.date, limit: int) -> DataFrame:
    valid = F.coalesce("valid_for", "reference_date")
    inside = F.col("reference_date").between(first, last) | valid.between(F.lit(first), F.lit(last))
    return (
        signals.where(inside)
        .orderBy(F.desc_nulls_last("reference_date"), F.asc_nulls_last("rank"), F.desc("created_at"), "ticker")
        .limit(limit)
    )


def latest_backtest_trades(trades: DataFrame, limit: int) -> DataFrame:
    return (
        trades.withColumn("days_in_trade", F.datediff("exit_date", "entry_fill_date"))
        .orderBy(F.desc("created_at"), "ticker", "side")
        .limit(limit)
    )


def signals_per_ticker(signals: DataFrame, day: dt.date) -> DataFrame:
    return signals.where(F.col("reference_date") == F.lit(day)).groupBy("ticker").agg(F.count(F.lit(1)).alias("signals"))


def ops_read(view: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """Ordered, optionally limited read of any view."""
    out = view.orderBy(*order)
    return out.limit(limit) if limit else out


def split_order(c: str = "dataset_split") -> Column:
    return status_chain([(F.col(c) == s, F.lit(i)) for i, s in enumerate(("train", "validation", "test"), 1)], F.lit(4))
