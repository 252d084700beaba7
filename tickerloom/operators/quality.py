"""Data inventory, coverage, incidents and daily quality checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bad_volume, invalid_ohlc, safe_div, status_chain
from ..functions.frames import with_one_row
from .calendar import trading_calendar

# fixed values: severity of a check status, per-day signal limit
SEVERITY = {"PASS": "INFO", "WARN": "WARNING", "FAIL": "CRITICAL"}
SIGNAL_LIMIT = 5


def component_status(daily, quotes, signals, metrics, checks, today: dt.date) -> DataFrame:
    """Last reference, last timestamp and today's rows of the five data components."""
    day = F.lit(today)

    def one(df: DataFrame, name: str, ref: str, stamp: str, hit: Column, note: Column) -> DataFrame:
        return df.agg(
            F.lit(name).alias("component"),
            F.max(ref).alias("last_reference"),
            F.max(stamp).alias("last_timestamp"),
            F.count_if(hit).alias("rows_today"),
            note.alias("notes"),
        )

    def text(c: Column) -> Column:
        return c.cast("string")

    parts = [
        one(daily, "cotacao_ohlcv_diario", "session_date", "updated_at", F.col("session_date") == day,
            F.concat(F.lit("Último pregão: "), text(F.max("session_date")))),
        one(quotes, "cotacao_b3", "quote_date", "captured_at", F.col("quote_date") == day,
            F.concat(F.lit("Última hora registrada: "), F.max("quote_time"))),
        one(signals, "sinais_eod", "reference_date", "created_at", F.col("reference_date") == day,
            F.concat(F.lit("Válidos para: "), text(F.max("valid_for")))),
        one(metrics, "backtest_metrics", "as_of_date", "created_at", F.col("as_of_date") == day,
            F.concat(F.lit("Entradas avaliadas: "), text(F.sum("signals")))),
        one(checks, "dq_checks_daily", "check_date", "created_at",
            (F.col("status") == "FAIL") & (F.col("check_date") == day),
            F.concat(F.lit("Último status: "), F.max_by("status", F.struct("created_at", "status")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_inventory_summary(daily: DataFrame, quotes: DataFrame, tickers: DataFrame) -> DataFrame:
    """One row of counts, date range and share of valid rows over the whole store."""
    d = daily.agg(
        F.count(F.lit(1)).alias("daily_candles"),
        F.count_distinct("ticker").alias("daily_tickers"),
        F.min("session_date").alias("_d0"),
        F.max("session_date").alias("_d1"),
        (F.count_if(invalid_ohlc()) + F.count_if(bad_volume("financial_volume"))).alias("_bad_daily"),
        F.max("updated_at").alias("_du"),
    )
    q = quotes.agg(
        F.count(F.lit(1)).alias("intraday_candles"),
        F.count_distinct("ticker").alias("intraday_tickers"),
        F.min("quote_date").alias("_q0"),
        F.max("quote_date").alias("_q1"),
        F.count_if(bad_volume("price")).alias("_bad_quotes"),
        F.max("captured_at").alias("_qu"),
    )
    t = tickers.agg(F.count(F.lit(1)).alias("total_tickers"), F.count_if(F.col("active")).alias("active_tickers"))
    rows = F.col("daily_candles") + F.col("intraday_candles")
    return with_one_row(with_one_row(d, q), t).select(
        "active_tickers",
        "total_tickers",
        "daily_tickers",
        "intraday_tickers",
        F.least("_d0", "_q0").alias("first_available_date"),
        F.greatest("_d1", "_q1").alias("last_available_date"),
        "daily_candles",
        "intraday_candles",
        safe_div(rows - F.col("_bad_daily") - F.col("_bad_quotes"), rows).alias("valid_data_pct"),
        F.greatest("_du", "_qu").alias("last_update"),
    )


def ticker_coverage(daily: DataFrame, tickers: DataFrame, holidays: DataFrame) -> DataFrame:
    """Coverage, volume, duplicates and eligibility per ticker.

    Rows are first reduced to one per (ticker, session), which carries the duplicate
    count along, so a single map-side-combined aggregation feeds the ticker totals.
    """
    per_day = daily.groupBy("ticker", "session_date").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("financial_volume").alias("_v"),
        F.count("financial_volume").alias("_nv"),
        F.count_if(invalid_ohlc()).alias("_bad_price"),
        F.count_if(bad_volume("financial_volume")).alias("_bad_volume"),
    )
    per_ticker = per_day.groupBy("ticker").agg(
        F.min("session_date").alias("first_date"),
        F.max("session_date").alias("last_date"),
        F.count(F.lit(1)).alias("days_with_data"),
        safe_div(F.sum("_v"), F.sum("_nv")).alias("avg_financial_volume"),
        F.sum("_bad_price").alias("invalid_price_days"),
        F.sum("_bad_volume").alias("invalid_volume_days"),
        F.count_if(F.col("_n") > 1).alias("duplicate_days"),
    )
    # the calendar runs over the whole table's span, taken from the small per-ticker result
    span = per_ticker.agg(F.min("first_date").alias("first_day"), F.max("last_date").alias("last_day"))
    expected = trading_calendar(span, holidays).agg(F.count(F.lit(1)).alias("expected_days"))
    coverage = safe_div("days_with_data", "expected_days")
    clean = (
        (F.col("avg_financial_volume") >= 1_000_000)
        & (F.col("invalid_price_days") == 0)
        & (F.col("invalid_volume_days") == 0)
        & (F.col("duplicate_days") == 0)
    )
    return (
        with_one_row(per_ticker, expected)
        .join(tickers.select("ticker", "company", "active"), "ticker", "left")
        .withColumn("coverage_pct", coverage)
        .withColumn(
            "eligibility_status",
            status_chain(
                [
                    (~F.coalesce("active", F.lit(False)), "inativo"),
                    ((F.col("coverage_pct") >= 0.90) & clean, "elegivel"),
                    (F.col("coverage_pct") >= 0.75, "observacao"),
                ],
                "excluir",
            ),
        )
    )


def research_universe(coverage: DataFrame) -> DataFrame:
    """Tickers fit for research: eligible, or watched with full data and at most three duplicate days."""
    watched = (
        (F.col("eligibility_status") == "observacao")
        & (F.col("coverage_pct") >= 0.90)
        & (F.col("avg_financial_volume") >= 1_000_000)
        & (F.col("invalid_price_days") == 0)
        & (F.col("invalid_volume_days") == 0)
        & (F.col("duplicate_days") <= 3)
    )
    return coverage.where((F.col("eligibility_status") == "elegivel") | watched).select("ticker")


def data_quality_incidents(daily: DataFrame, quotes: DataFrame) -> DataFrame:
    """Incidents of four rules. Both daily row rules come from one scan via ``explode``."""

    def incident(kind: str, severity: str, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("incident_type"), F.lit(severity).alias("severity"), text.alias("recommendation")
        )

    shown = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in ("open", "high", "low", "close")]
    price_text = F.format_string("OHLC inválido: open=%s high=%s low=%s close=%s", *shown)
    volume_text = F.concat(
        F.lit("Volume financeiro ausente ou zerado: "),
        F.coalesce(F.col("financial_volume").cast("string"), F.lit("NULL")),
    )
    found = F.array_compact(
        F.array(
            F.when(invalid_ohlc(), incident("daily_invalid_price", "high", price_text)),
            F.when(bad_volume("financial_volume"), incident("daily_invalid_volume", "medium", volume_text)),
        )
    )
    rows = daily.select("ticker", F.col("session_date").alias("incident_date"), F.inline(found))
    repeated = (
        daily.groupBy("ticker", F.col("session_date").alias("incident_date"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(
            "ticker",
            "incident_date",
            F.lit("daily_duplicate").alias("incident_type"),
            F.lit("high").alias("severity"),
            F.format_string("Remover ou consolidar %d candles duplicados para ticker/data.", "_n").alias(
                "recommendation"
            ),
        )
    )
    intraday = quotes.where(bad_volume("price")).select(
        "ticker",
        F.col("quote_date").alias("incident_date"),
        F.lit("intraday_invalid_price").alias("incident_type"),
        F.lit("high").alias("severity"),
        F.format_string("Preço intraday ausente ou zerado no horário %s.", "quote_time").alias("recommendation"),
    )
    return rows.unionByName(repeated).unionByName(intraday)


# ---- daily checks: each returns one row (check_name, component, status, details columns) ----


def _check(df: DataFrame, name: str, component: str, status: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), F.lit(component).alias("component"), status.alias("status"), "*")


def _coverage_status(available: str, expected: str, threshold: float) -> Column:
    return status_chain(
        [
            (F.col(expected) <= 0, "WARN"),
            (safe_div(available, expected) >= threshold, "PASS"),
        ],
        "FAIL",
    )


def dq_daily_freshness(daily, tickers, day: dt.date, threshold: float) -> DataFrame:
    got = daily.where(F.col("session_date") == F.lit(day)).agg(F.count_distinct("ticker").alias("available_tickers"))
    df = with_one_row(tickers.agg(F.count_if("active").alias("expected_tickers")), got).withColumns(
        {
            "coverage_pct": F.round(F.coalesce(safe_div("available_tickers", "expected_tickers"), F.lit(0.0)), 4),
            "threshold": F.lit(threshold),
        }
    )
    return _check(df, "daily_freshness", "daily", _coverage_status("available_tickers", "expected_tickers", threshold))


def dq_intraday_freshness(quotes, tickers, day: dt.date, min_time: str, threshold: float) -> DataFrame:
    last = quotes.where(F.col("quote_date") == F.lit(day)).groupBy("ticker").agg(F.max("quote_time").alias("_t"))
    got = last.agg(
        F.count_if(F.col("_t") >= min_time).alias("fresh_tickers"), F.max("_t").alias("last_time")
    )
    df = with_one_row(tickers.agg(F.count_if("active").alias("expected_tickers")), got).withColumns(
        {
            "coverage_pct": F.round(F.coalesce(safe_div("fresh_tickers", "expected_tickers"), F.lit(0.0)), 4),
            "threshold": F.lit(threshold),
        }
    )
    return _check(df, "intraday_freshness", "intraday", _coverage_status("fresh_tickers", "expected_tickers", threshold))


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("duplicates"))


def dq_intraday_uniqueness(quotes, day: dt.date, tolerance: int = 0) -> DataFrame:
    df = _repeated(quotes.where(F.col("quote_date") == F.lit(day)), ["ticker", "quote_date", "quote_time"])
    df = df.withColumn("tolerance", F.lit(tolerance))
    return _check(df, "intraday_uniqueness", "intraday",
                  status_chain([(F.col("duplicates") > tolerance, "FAIL")], "PASS"))


def dq_daily_uniqueness(daily, day: dt.date) -> DataFrame:
    df = _repeated(daily.where(F.col("session_date") == F.lit(day)), ["ticker", "session_date"])
    return _check(df, "daily_uniqueness", "daily", status_chain([(F.col("duplicates") > 0, "FAIL")], "PASS"))


def dq_ohlc_validity(daily, day: dt.date) -> DataFrame:
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    whole = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull()
    df = daily.where(F.col("session_date") == F.lit(day)).agg(
        F.count_if(whole & (h < F.greatest(o, c, lo))).alias("invalid_high"),
        F.count_if(whole & (lo > F.least(o, c, h))).alias("invalid_low"),
    )
    issues = F.col("invalid_high") + F.col("invalid_low")
    return _check(df, "ohlc_validity", "daily", status_chain([(issues > 0, "FAIL")], "PASS"))


def dq_signal_limits(signals, day: dt.date, trading_day: bool = True) -> DataFrame:
    side, entry, target, stop = (F.col(n) for n in ("side", "entry", "target", "stop"))
    wrong_level = [
        (side == "BUY") & (target <= entry),
        (side == "BUY") & (stop >= entry),
        (side == "SELL") & (target >= entry),
        (side == "SELL") & (stop <= entry),
    ]
    invalid_side = F.count_if(~side.isin("BUY", "SELL"))
    levels = invalid_side
    for p in wrong_level:
        levels = levels + F.count_if(p)
    df = signals.where(F.col("reference_date") == F.lit(day)).agg(
        F.count(F.lit(1)).alias("total"), invalid_side.alias("invalid_side"), levels.alias("invalid_levels")
    )
    bad = (F.col("total") == 0) | (F.col("total") > SIGNAL_LIMIT) | (F.col("invalid_levels") > 0)
    status = status_chain([(F.lit(not trading_day), "WARN"), (bad, "FAIL")], "PASS")
    return _check(df, "signals_limits", "signals", status)


def dq_deadline_freshness(
    rows, day_col: str, name: str, component: str, missing: str, late: str,
    day: dt.date, deadline: str, grace_minutes: int, trading_day: bool = True,
) -> DataFrame:
    """FAIL when the day has no rows or the newest one came after deadline + grace."""
    limit = dt.datetime.combine(day, dt.time.fromisoformat(deadline)) + dt.timedelta(minutes=grace_minutes)
    df = rows.where(F.col(day_col) == F.lit(day)).agg(
        F.count(F.lit(1)).alias("rows"), F.max("created_at").alias("last_created_at")
    )
    df = df.withColumn("deadline", F.lit(limit.isoformat(sep=" ")).cast("timestamp_ntz"))
    too_late = F.col("last_created_at") > F.col("deadline")
    df = df.withColumn(
        "reason",
        status_chain(
            [(F.lit(not trading_day), "non_trading_day"), (F.col("rows") == 0, missing), (too_late, late)], None
        ),
    )
    status = status_chain(
        [(F.lit(not trading_day), "WARN"), (F.col("reason").isNotNull(), "FAIL")], "PASS"
    )
    return _check(df, name, component, status)


def dq_results(checks: list[DataFrame], day: dt.date, run_id: str) -> DataFrame:
    """All checks in one contract; the check-specific columns become a JSON text."""
    severities = F.create_map(*[F.lit(v) for kv in SEVERITY.items() for v in kv])
    out = None
    for df in checks:
        details = [c for c in df.columns if c not in ("check_name", "component", "status")]
        part = df.select(
            F.lit(day).alias("check_date"),
            "check_name",
            "component",
            "status",
            F.coalesce(F.try_element_at(severities, F.col("status")), F.lit("INFO")).alias("severity"),
            F.to_json(F.struct(*details)).alias("details"),
            F.lit(run_id).alias("run_id"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def dq_incidents(results: DataFrame) -> DataFrame:
    """Failed checks with an incident id."""
    return results.where("status = 'FAIL'").withColumn(
        "incident_id", F.concat_ws("_", F.col("check_date").cast("string"), "check_name", "run_id")
    )


