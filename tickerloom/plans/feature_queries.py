"""Queries over indicators, rule features and model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import quality as ql
from .quality_queries import coverage_of
from .registry import cte, query, sdiv
from .shared import shared
from .tables import Tables

cte(
    "dedup",
    "SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY ticker, session_date ORDER BY updated_at DESC) = 1",
    "daily",
)


@query(
    "dedup_daily",
    "ticker session_date open:d high:d low:d close:d volume:d financial_volume:d updated_at",
    "SELECT * FROM dedup",
    "dedup",
)
def _dedup(t: Tables):
    return ind.dedup_daily(t.daily)


W_ = "PARTITION BY ticker ORDER BY session_date"


def rows(n: int, to: str = "CURRENT ROW") -> str:
    return f"OVER ({W_} ROWS BETWEEN {n} PRECEDING AND {to})"


@query(
    "indicators",
    """ticker session_date close:d px_prev:d sma20:d sd20:d sma50:d bb_up:d bb_dn:d rs_raw:d tr:d rsi14:d
       atr14:d slope50_pct:d""",
    f"""
    SELECT *, sma20 + 2 * sd20 AS bb_up, sma20 - 2 * sd20 AS bb_dn, 100 - 100 / nullif(1 + rs_raw, 0) AS rsi14,
           avg(tr) {rows(13)} AS atr14, abs(sma50 - lag(sma50) OVER ({W_})) / nullif(sma50, 0) AS slope50_pct
    FROM (
        SELECT ticker, session_date, close, px_prev, avg(close) {rows(19)} AS sma20,
               stddev_samp(close) {rows(19)} AS sd20, avg(close) {rows(49)} AS sma50,
               sum(CASE WHEN px_prev IS NOT NULL THEN greatest(close - px_prev, 0) END) {rows(13)}
                 / nullif(-sum(CASE WHEN px_prev IS NOT NULL THEN least(close - px_prev, 0) END) {rows(13)}, 0)
                 AS rs_raw,
               CASE WHEN px_prev IS NOT NULL
                    THEN greatest(high - low, abs(high - px_prev), abs(low - px_prev)) END AS tr
        FROM (SELECT *, lag(close) OVER ({W_}) AS px_prev FROM dedup)
    )
    """,
    "dedup",
)
def _indicators(t: Tables):
    return ind.indicators(ind.dedup_daily(t.daily))


cte(
    "features",
    f"""
    SELECT *, session_date AS reference_date, close / nullif(close_3d_ago, 0) - 1 AS return_3d,
           close / nullif(close_5d_ago, 0) - 1 AS return_5d, close / nullif(close_20d_ago, 0) - 1 AS return_20d,
           financial_volume / nullif(avg_volume_20d, 0) AS relative_volume_20d,
           100 - 100 / nullif(1 + avg_gain_14 / nullif(avg_loss_14, 0), 0) AS rsi_14,
           open / nullif(prior_close, 0) - 1 AS gap_pct
    FROM (
        SELECT *, avg(close) {rows(19)} AS sma_20, avg(close) {rows(49)} AS sma_50,
               avg(financial_volume) {rows(19)} AS avg_volume_20d,
               max(high) {rows(20, '1 PRECEDING')} AS prior_high_20d,
               min(low) {rows(20, '1 PRECEDING')} AS prior_low_20d,
               avg(CASE WHEN prior_close IS NOT NULL THEN greatest(close - prior_close, 0) END) {rows(13)}
                   AS avg_gain_14,
               avg(CASE WHEN prior_close IS NOT NULL THEN abs(least(close - prior_close, 0)) END) {rows(13)}
                   AS avg_loss_14
        FROM (
            SELECT ticker, session_date, open, high, low, close, financial_volume,
                   lag(close, 1) OVER ({W_}) AS prior_close, lag(close, 3) OVER ({W_}) AS close_3d_ago,
                   lag(close, 5) OVER ({W_}) AS close_5d_ago, lag(close, 20) OVER ({W_}) AS close_20d_ago
            FROM dedup SEMI JOIN universe USING (ticker)
        )
    )
    """,
    "dedup universe",
)


@shared
def features_of(t: Tables):
    return ind.daily_features(t.daily, ql.research_universe(coverage_of(t)))


@query(
    "daily_features",
    """ticker reference_date open:d high:d low:d close:d financial_volume:d prior_close:d close_3d_ago:d
       close_5d_ago:d close_20d_ago:d sma_20:d sma_50:d avg_volume_20d:d prior_high_20d:d prior_low_20d:d
       avg_gain_14:d avg_loss_14:d return_3d:d return_5d:d return_20d:d relative_volume_20d:d rsi_14:d gap_pct:d""",
    "SELECT * FROM features",
    "features",
)
def _features(t: Tables):
    return features_of(t)


def _full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {rows(n - 1)} = {n} THEN {agg}({c}) {rows(n - 1)} END"


def _lag(n: int) -> str:
    return f"lag(close, {n}) OVER ({W_})"


_money = _full("avg", "financial_volume", 20)
_sma = {n: _full("avg", "close", n) for n in (5, 20, 50)}
_feature_sql = {f"return_{n}d": f"close / nullif({_lag(n)}, 0) - 1" for n in (1, 5, 10, 20)}
_feature_sql |= {
    f"log_return_{n}d": f"CASE WHEN close / nullif({_lag(n)}, 0) > 0 THEN ln(close / {_lag(n)}) END"
    for n in (1, 5, 10, 20)
}
_feature_sql |= {f"volatility_{n}d": _full("stddev_samp", "r1", n) for n in (5, 10, 20, 60)}
_feature_sql |= {
    "downside_volatility_20d": _full("stddev_samp", "down", 20),
    "daily_range_pct": "rng",
    "intraday_return_pct": "(close - open) / nullif(open, 0)",
    "gap_open_pct": f"(open - {_lag(1)}) / nullif({_lag(1)}, 0)",
    "financial_volume_z20": f"(financial_volume - ({_money})) / nullif({_full('stddev_samp', 'financial_volume', 20)}, 0)",
    "log_financial_volume": "ln(1 + greatest(financial_volume, 0))",
    "log_volume": "ln(1 + greatest(volume, 0))",
    "volume_ratio_5d": f"volume / nullif({_full('avg', 'volume', 5)}, 0)",
    "volume_ratio_20d": f"volume / nullif({_full('avg', 'volume', 20)}, 0)",
    "financial_volume_ratio_20d": f"financial_volume / nullif({_money}, 0)",
    "trend_sma_5_20_pct": f"(({_sma[5]}) - ({_sma[20]})) / nullif(close, 0)",
    "distance_sma_20d_pct": f"(close - ({_sma[20]})) / nullif(close, 0)",
    "distance_sma_50d_pct": f"(close - ({_sma[50]})) / nullif(close, 0)",
    "range_volatility_20d": _full("stddev_samp", "rng", 20),
}
for _n in (20, 60):
    _feature_sql[f"distance_high_{_n}d_pct"] = f"(close - ({_full('max', 'high', _n)})) / nullif(close, 0)"
    _feature_sql[f"distance_low_{_n}d_pct"] = f"(close - ({_full('min', 'low', _n)})) / nullif(close, 0)"

cte(
    "model_features",
    f"""
    SELECT ticker, session_date AS reference_date, open, high, low, close, volume, financial_volume,
           {', '.join(f'{v} AS {k}' for k, v in _feature_sql.items())},
           volume <= 0 AS has_zero_volume, FALSE AS has_missing_ohlcv,
           close <= 0 OR open <= 0 OR high < greatest(open, close, low) OR low > least(open, close, high)
               AS is_suspicious_candle,
           row_number() OVER ({W_}) AS history_days
    FROM (SELECT *, CASE WHEN r1 < 0 THEN r1 ELSE 0 END AS down
          FROM (SELECT *, close / nullif({_lag(1)}, 0) - 1 AS r1, (high - low) / nullif(close, 0) AS rng FROM dedup))
    QUALIFY history_days >= 20
    """,
    "dedup",
)

FEATURE_COLS = (
    "ticker reference_date close:d volume:d financial_volume:d "
    + " ".join(f"{f}:d" for f in ind.FEATURES)
    + " has_missing_ohlcv:b has_zero_volume:b is_suspicious_candle:b history_days:n"
)


@query("eod_feature_table", FEATURE_COLS, "SELECT * FROM model_features", "model_features")
def _model_features(t: Tables):
    return ind.eod_feature_table(ind.dedup_daily(t.daily))


@query(
    "return_windows",
    "ticker session_date future_return:d label:n first_return:d last_return:d window_sum:d",
    f"""
    SELECT *, CASE WHEN future_return >= 0.02 THEN 2 WHEN future_return <= -0.02 THEN 0 ELSE 1 END AS label
    FROM (
        SELECT ticker, session_date, lead(close, 5) OVER ({W_}) / close - 1 AS future_return,
               lag(r, 10) OVER ({W_}) AS first_return, lag(r, 1) OVER ({W_}) AS last_return,
               sum(r) OVER ({W_} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS window_sum
        FROM (SELECT *, coalesce(close / nullif({_lag(1)}, 0) - 1, 0) AS r FROM dedup)
    ) WHERE first_return IS NOT NULL AND future_return IS NOT NULL
    """,
    "dedup",
)
def _windows(t: Tables):
    out = ind.return_windows(ind.dedup_daily(t.daily), 10, 5, 0.02)
    return out.withColumns(
        {
            "first_return": F.element_at("window", 1),
            "last_return": F.element_at("window", -1),
            "window_sum": F.aggregate("window", F.lit(0.0), lambda a, x: a + x),
        }
    )


@query(
    "chronological_split",
    "session_date is_train:b samples:n",
    """
    SELECT session_date, is_train, count(*) AS samples
    FROM (SELECT session_date, row_number() OVER (ORDER BY session_date, ticker)
                 <= floor(count(*) OVER () * (1 - 0.2)) AS is_train FROM dedup)
    GROUP BY ALL
    """,
    "dedup",
)
def _split(t: Tables):
    out = ind.chronological_split(ind.dedup_daily(t.daily), "session_date", ["ticker"], 0.2)
    return out.groupBy("session_date", "is_train").agg(F.count(F.lit(1)).alias("samples"))
