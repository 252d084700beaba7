"""Barrier trade outcomes, back-tests and their metrics.

Every bar carries the array of its next bars, built by one window per ticker. A
signal meets exactly one such bar, so signals x bars pairs are never generated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import avg_if, profit_factor, safe_div, status_chain
from ..functions.frames import require_columns

EXECUTION_POLICY = "execution_eod_barrier_v2_conservative_daily"
BAR = ["session_date", "high", "low", "close"]


def _forward(bars: DataFrame, horizon: int) -> DataFrame:
    """Each bar with the array of itself and its following bars, at most ``horizon`` long."""
    w = W.partitionBy("ticker").orderBy("session_date")
    bar = F.struct("session_date", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in BAR[1:]])
    return bars.select(
        "ticker",
        "session_date",
        F.lag("session_date").over(w).alias("_prev"),
        F.collect_list(bar).over(w.rowsBetween(0, horizon - 1)).alias("future"),
    )


def attach_future(signals: DataFrame, bars: DataFrame, start: str, horizon: int) -> DataFrame:
    """Add ``future``: the ticker's first ``horizon`` bars on or after date column ``start``.

    The forward as-of lookup is an equi join: a bar is repeated for the calendar days since
    the previous one, so any date finds its next bar; dates before the first bar use it.
    ``(ticker, day)`` spreads a hot ticker over its days.
    """
    reach = _forward(bars, horizon)
    days = F.sequence(F.coalesce(F.date_add("_prev", 1), F.col("session_date")), F.col("session_date"))
    by_day = reach.select("ticker", F.explode(days).alias("_day"), "future")
    first = bars.groupBy("ticker").agg(F.min("session_date").alias("_first"))
    keyed = signals.join(first, "ticker", "left").withColumn("_day", F.greatest(F.col(start), F.col("_first")))
    return keyed.join(by_day, ["ticker", "_day"], "left").drop("_day", "_first")


def barrier_outcomes(
    signals: DataFrame, bars: DataFrame, max_horizon: int = 15,
    cost_pct: float = 0.0, spread_pct: float = 0.0, slippage_pct: float = 0.0, borrow_cost_pct: float = 0.0,
    entry_sessions: int | None = None,
) -> DataFrame:
    """Life of each signal: pending entry, open, stop / target / expiry.

    ``signals`` needs ticker, side, valid_from, entry, target, stop and horizon_days
    (at most ``max_horizon``). Within one bar the stop is checked before the target.
    ``entry_sessions`` limits how long an entry stays pending (default: the horizon).
    """
    require_columns(signals, ["ticker", "side", "valid_from", "entry", "target", "stop", "horizon_days"])
    if min(cost_pct, spread_pct, slippage_pct, borrow_cost_pct) < 0:
        raise ValueError("costs must not be negative")
    df = attach_future(signals, bars, "valid_from", max_horizon)
    return resolve(df, max_horizon, cost_pct + spread_pct + slippage_pct, borrow_cost_pct, entry_sessions)


def resolve(df: DataFrame, max_horizon: int, fixed_cost: float, borrow_cost_pct: float, entry_sessions=None) -> DataFrame:
    """Outcome columns for rows that carry side, entry, target, stop, horizon_days and ``future``.

    Row-local: it adds no exchange.
    """
    entry, target, stop = F.col("entry"), F.col("target"), F.col("stop")
    sell = F.col("side") == "SELL"
    horizon = F.when(F.col("horizon_days") <= max_horizon, F.col("horizon_days").cast("int")).otherwise(
        F.raise_error(F.lit(f"horizon_days above max_horizon={max_horizon}"))
    )
    df = df.withColumn("_bars", F.slice(F.coalesce("future", F.array().cast(df.schema["future"].dataType)), 1, horizon))

    # each step is its own projection, so the array scans run once per row
    touch = F.transform("_bars", lambda b: F.when(sell, b["high"] >= entry).otherwise(b["low"] <= entry))
    if entry_sessions is not None:
        touch = F.slice(touch, 1, entry_sessions)
    df = df.withColumn("_entry_no", F.array_position(touch, True).cast("int"))
    df = df.withColumn(
        "_open",
        F.when(F.col("_entry_no") > 0, F.slice("_bars", F.greatest("_entry_no", F.lit(1)), max_horizon)),
    )
    hit = F.transform(
        "_open",
        lambda b: F.when(sell, (b["high"] >= stop) | (b["low"] <= target)).otherwise(
            (b["low"] <= stop) | (b["high"] >= target)
        ),
    )
    df = df.withColumn("_exit_no", F.array_position(hit, True).cast("int"))
    held = F.when(F.col("_exit_no") > 0, F.col("_exit_no")).otherwise(F.size("_open"))
    df = df.withColumn("holding_sessions", F.when(F.col("_entry_no") > 0, held))
    df = df.withColumn("_held", F.slice("_open", 1, F.coalesce("holding_sessions", F.lit(1))))
    last = F.element_at("_held", -1)
    stopped = F.when(sell, last["high"] >= stop).otherwise(last["low"] <= stop)

    bad = F.coalesce(F.least(entry, target, stop), F.lit(0.0)) <= 0
    bad = bad | entry.isNull() | target.isNull() | stop.isNull()
    filled = ~bad & (F.col("_entry_no") > 0)
    df = df.withColumn(
        "exit_reason",
        status_chain(
            [
                (bad, "INVALID"),
                (F.size("_bars") == 0, "NO_DATA"),
                (~filled, "EXPIRED_UNFILLED"),
                (F.col("_exit_no") == 0, "EXPIRED_MARK_TO_MARKET"),
                (stopped, "STOP"),
            ],
            "TARGET",
        ),
    )
    reason = F.col("exit_reason")
    price = status_chain([(reason == "STOP", stop), (reason == "TARGET", target)], last["close"])
    sign = F.when(sell, -1.0).otherwise(1.0)

    def move(p: Column) -> Column:
        return sign * (p - entry) / entry

    best = F.when(sell, F.array_min(F.transform("_held", lambda b: b["low"]))).otherwise(
        F.array_max(F.transform("_held", lambda b: b["high"]))
    )
    worst = F.when(sell, F.array_max(F.transform("_held", lambda b: b["high"]))).otherwise(
        F.array_min(F.transform("_held", lambda b: b["low"]))
    )
    borrow = F.when(sell, borrow_cost_pct * F.col("holding_sessions")).otherwise(0.0)
    df = df.withColumns(
        {
            "entry_filled": filled,
            "entry_date": F.when(filled, F.get("_open", F.lit(0))["session_date"]),
            "entry_price": F.when(filled, entry),
            "exit_date": F.when(filled, last["session_date"]),
            "exit_price": F.when(filled, price),
            "max_favorable_excursion": F.when(filled, move(best)),
            "max_adverse_excursion": F.when(filled, move(worst)),
            "holding_sessions": F.when(filled, F.col("holding_sessions")),
            "execution_policy_version": F.lit(EXECUTION_POLICY),
        }
    )
    df = df.withColumn("gross_return", F.coalesce(move(F.col("exit_price")), F.lit(0.0)))
    df = df.withColumn(
        "net_return", F.when(filled, F.col("gross_return") - fixed_cost - borrow).otherwise(F.lit(0.0))
    )
    return df.drop("future", "_bars", "_entry_no", "_open", "_exit_no", "_held")


def backtest_trades(signals: DataFrame, bars: DataFrame, max_horizon: int = 15) -> DataFrame:
    """Cost-free outcomes of stored signals, tested from their ``valid_for`` date."""
    out = barrier_outcomes(signals.withColumn("valid_from", F.col("valid_for")), bars, max_horizon)
    reason = status_chain(
        [
            (F.col("exit_reason") == "EXPIRED_UNFILLED", "NO_FILL"),
            (F.col("exit_reason") == "EXPIRED_MARK_TO_MARKET", "EXPIRE"),
        ],
        F.col("exit_reason"),
    )
    return out.select(
        *signals.columns,
        F.col("entry_filled").alias("entry_hit"),
        F.col("entry_date").alias("entry_fill_date"),
        "exit_date",
        reason.alias("exit_reason"),
        "exit_price",
        F.col("net_return").alias("return_pct"),
        F.col("max_favorable_excursion").alias("mfe_pct"),
        F.col("max_adverse_excursion").alias("mae_pct"),
    )


def backtest_metrics(trades: DataFrame, as_of: dt.date, days: int | None = 60) -> DataFrame:
    """Metrics per horizon, (horizon, side), (horizon, ticker) and (horizon, ticker, side).

    NULL ticker / side means "all". ``days`` keeps the trailing window up to ``as_of``.
    """
    if days is not None:
        first = as_of - dt.timedelta(days=days)
        trades = trades.where(F.col("reference_date").between(F.lit(first), F.lit(as_of)))
    fill = F.coalesce("entry_hit", F.lit(False))
    r = F.when(fill, F.col("return_pct"))
    days_in = F.when(fill, F.datediff("exit_date", "entry_fill_date") + 1)
    base = trades.select(
        F.upper("ticker").alias("ticker"),
        F.upper("side").alias("side"),
        "horizon_days",
        fill.alias("_fill"),
        r.alias("_r"),
        days_in.alias("_days"),
    )
    r = F.col("_r")
    out = base.groupingSets(
        [["horizon_days"], ["horizon_days", "side"], ["horizon_days", "ticker"], ["horizon_days", "ticker", "side"]],
        "horizon_days", "ticker", "side",
    ).agg(
        F.count(F.lit(1)).alias("signals"),
        F.count_if("_fill").alias("fills"),
        F.coalesce(safe_div(F.count_if(r > 0), F.count_if("_fill")), F.lit(0.0)).alias("win_rate"),
        F.avg("_r").alias("avg_return"),
        avg_if(r > 0, "_r").alias("avg_win"),
        avg_if(r < 0, "_r").alias("avg_loss"),
        profit_factor("_r").alias("profit_factor"),
        F.avg("_days").alias("avg_days_in_trade"),
    )
    return out.withColumn("as_of_date", F.lit(as_of))


def baseline_trade_outcomes(signals: DataFrame, bars: DataFrame, max_horizon: int = 5, run_id: str = "run") -> DataFrame:
    """Outcomes of baseline signals: entered at the signal close, target checked before stop.

    Bars count within ``max_horizon_days`` bars and ``max_horizon_days + 10`` calendar days
    after the signal; excursions cover all of them. A signal that neither hits a level nor
    has its full number of bars has no outcome. A horizon above ``max_horizon``, the longest of
    ``signals``, is an error.
    """
    side_buy = F.col("side") == "BUY"
    entry, target, stop = F.col("expected_entry_price"), F.col("target_price"), F.col("stop_price")
    horizon = F.when(F.col("max_horizon_days") <= max_horizon, F.col("max_horizon_days").cast("int")).otherwise(
        F.raise_error(F.lit(f"max_horizon_days above max_horizon={max_horizon}"))
    )
    df = attach_future(signals.withColumn("_from", F.date_add("reference_date", 1)), bars, "_from", max_horizon)
    until = F.date_add("reference_date", horizon + 10)
    df = df.withColumn("_bars", F.filter(F.slice("future", 1, horizon), lambda b: b["session_date"] <= until))

    def at_target(b: Column) -> Column:
        return F.coalesce(F.when(side_buy, b["high"] >= target).otherwise(b["low"] <= target), F.lit(False))

    def at_stop(b: Column) -> Column:
        return F.coalesce(F.when(side_buy, b["low"] <= stop).otherwise(b["high"] >= stop), F.lit(False))

    df = df.withColumn(
        "_no", F.array_position(F.transform("_bars", lambda b: at_target(b) | at_stop(b)), True).cast("int")
    )
    bars_no = F.when(F.col("_no") > 0, F.col("_no")).when(F.size("_bars") == horizon, horizon)
    df = df.withColumn("bars_in_trade", bars_no).where("bars_in_trade IS NOT NULL")
    exit_bar = F.get("_bars", F.col("bars_in_trade") - 1)
    reason = status_chain([(at_target(exit_bar), "target"), (at_stop(exit_bar), "stop")], "expiration")
    price = status_chain([(at_target(exit_bar), target), (at_stop(exit_bar), stop)], exit_bar["close"])
    top = F.array_max(F.transform("_bars", lambda b: b["high"]))
    bottom = F.array_min(F.transform("_bars", lambda b: b["low"]))
    df = df.withColumns({"exit_reason": reason, "exit_price": price})
    gross = F.when(side_buy, safe_div("exit_price", entry) - 1).otherwise(safe_div(entry, "exit_price") - 1)

    def at_hour(day: Column, hours: int) -> Column:
        return day.cast("timestamp_ntz") + F.expr(f"INTERVAL {hours} HOURS")

    df = df.withColumn("gross_pnl_pct", gross)
    return df.select(
        F.concat(F.lit("trade:"), F.col("signal_id")).alias("trade_id"),
        "signal_id", "strategy_id", "strategy_family", "strategy_version", "config_version", "ticker", "side",
        "reference_date", "signal_timestamp",
        at_hour(F.get("_bars", F.lit(0))["session_date"], 10).alias("entry_timestamp"),
        entry.alias("entry_price_expected"),
        entry.alias("entry_price_filled"),
        at_hour(exit_bar["session_date"], 18).alias("exit_timestamp"),
        "exit_price",
        "gross_pnl_pct",
        F.lit(0.001).alias("estimated_cost_pct"),
        F.lit(0.0005).alias("slippage_pct"),
        (F.col("gross_pnl_pct") - 0.0015).alias("net_pnl_pct"),
        status_chain(
            [
                (F.col("exit_reason") == "target", "WIN"),
                (F.col("exit_reason") == "stop", "LOSS"),
                (F.col("gross_pnl_pct") > 0, "WIN"),
            ],
            "LOSS",
        ).alias("outcome"),
        "exit_reason",
        "bars_in_trade",
        F.datediff(exit_bar["session_date"], "reference_date").alias("days_in_trade"),
        F.when(side_buy, safe_div(top, entry) - 1).otherwise(safe_div(entry, bottom) - 1).alias("mfe_pct"),
        F.when(side_buy, safe_div(bottom, entry) - 1).otherwise(safe_div(entry, top) - 1).alias("mae_pct"),
        F.lit(None).cast("string").alias("regime_label"),
        F.lit(run_id).alias("run_id"),
    )


STRATEGY = ["strategy_id", "strategy_family", "strategy_version"]


def baseline_metrics(trades: DataFrame, metric_date: dt.date) -> DataFrame:
    """Metrics per strategy and side. ``max_drawdown_pct`` is the worst single trade."""
    net = F.col("net_pnl_pct")
    out = trades.groupBy(*STRATEGY, "config_version", "side").agg(
        F.min("reference_date").alias("period_start"),
        F.max("reference_date").alias("period_end"),
        F.count(F.lit(1)).alias("signals"),
        F.count(F.lit(1)).alias("trades"),
        F.count_if(net > 0).alias("wins"),
        F.count_if(net <= 0).alias("losses"),
        avg_if(net > 0, net).alias("avg_win_pct"),
        avg_if(net <= 0, net).alias("avg_loss_pct"),
        F.avg(net).alias("expectancy_net_pct"),
        F.sum("gross_pnl_pct").alias("gross_return_pct"),
        F.sum(net).alias("net_return_pct"),
        profit_factor(net).alias("profit_factor"),
        F.min(net).alias("max_drawdown_pct"),
        safe_div(F.avg(net), F.stddev_pop(net)).alias("sharpe"),
        safe_div(F.avg(net), F.stddev_pop(F.when(net < 0, net))).alias("sortino"),
        F.avg("days_in_trade").alias("avg_days_in_trade"),
    )
    win_rate = safe_div("wins", "trades")
    score = F.coalesce("expectancy_net_pct", F.lit(0.0)) * 10 + F.coalesce(win_rate, F.lit(0.0))
    return out.withColumns(
        {
            "metric_date": F.lit(metric_date),
            "ticker": F.lit(None).cast("string"),
            "regime_label": F.lit(None).cast("string"),
            "win_rate": win_rate,
            "payoff_avg": safe_div("avg_win_pct", F.abs("avg_loss_pct")),
            "robustness_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)),
        }
    )


def backtest_lab_summary(trades: DataFrame) -> DataFrame:
    """Per strategy and config: only entered trades count for returns."""
    entered = F.col("entry_timestamp").isNotNull()
    net = F.when(entered, F.col("net_pnl_pct"))
    return (
        trades.withColumn("_net", net)
        .groupBy(*STRATEGY, "config_version")
        .agg(
            F.min("reference_date").alias("period_start"),
            F.max("reference_date").alias("period_end"),
            F.count(F.lit(1)).alias("signals"),
            F.count_if(entered).alias("trades"),
            F.count_if(F.col("_net") > 0).alias("wins"),
            F.count_if(F.col("_net") < 0).alias("losses"),
            avg_if(F.col("_net") > 0, "_net").alias("avg_win_pct"),
            avg_if(F.col("_net") < 0, "_net").alias("avg_loss_pct"),
            F.avg("_net").alias("expectancy_net_pct"),
            profit_factor("_net").alias("profit_factor"),
            F.avg("days_in_trade").alias("avg_days_in_trade"),
        )
        .withColumns(
            {
                "win_rate": safe_div("wins", "trades"),
                "payoff_avg": safe_div("avg_win_pct", F.abs("avg_loss_pct")),
            }
        )
    )


LAB_TRADE_COLUMNS = (
    "trade_id signal_id strategy_id strategy_family strategy_version config_version ticker side reference_date "
    "signal_timestamp entry_timestamp entry_price_expected entry_price_filled exit_timestamp exit_price "
    "gross_pnl_pct estimated_cost_pct slippage_pct net_pnl_pct outcome exit_reason bars_in_trade days_in_trade "
    "mfe_pct mae_pct regime_label run_id"
).split()


def backtest_lab_trades(trades: DataFrame) -> DataFrame:
    return trades.select(*LAB_TRADE_COLUMNS)


def strategy_comparator(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn(
        "comparison_status",
        status_chain(
            [
                (F.col("trades") < 30, "amostra_insuficiente"),
                (F.col("expectancy_net_pct") <= 0, "sem_expectativa_positiva"),
                (F.col("profit_factor") < 1, "profit_factor_fraco"),
                (F.col("max_drawdown_pct") < -0.20, "drawdown_elevado"),
            ],
            "comparavel",
        ),
    )


