"""Rule-based baseline signals, conditional end-of-day signals and model-driven signals."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import clean_ticker, failed_criteria, status_chain
from ..functions.frames import latest_by, require_columns, top_n_by

#: Default number of signals per day; ``top_n`` sets another, None keeps all.
SIGNALS_PER_DAY = 5


# ---------------------------------------------------------------- baseline rules


@dataclass(frozen=True)
class Rule:
    """One baseline strategy: where it fires and how its levels relate to the close."""

    strategy_id: str
    family: str
    side: str
    target: float
    stop: float
    horizon: int
    exit_rule: str
    fires: str  # SQL predicate over the features
    score: str
    metadata: str  # feature names kept for audit


# fixed values: the published baseline strategies
RULES = (
    Rule("baseline_daily_momentum_v1", "momentum_diario", "BUY", 1.04, 0.98, 5, "target_stop_or_5_days",
         "return_5d >= 0.02D AND close > sma_20 AND financial_volume > avg_volume_20d",
         "relative_volume_20d", "return_5d sma_20 relative_volume_20d rsi_14"),
    Rule("baseline_daily_mean_reversion_v1", "reversao_media_diaria", "BUY", 1.03, 0.975, 3, "target_stop_or_3_days",
         "return_3d <= -0.04D AND close > sma_50 AND rsi_14 <= 35", "abs(return_3d)", "return_3d sma_50 rsi_14"),
    Rule("baseline_daily_breakout_v1", "rompimento_diario", "BUY", 1.05, 0.975, 5, "target_stop_or_5_days",
         "close > prior_high_20d AND financial_volume >= 1.5D * avg_volume_20d",
         "relative_volume_20d", "prior_high_20d relative_volume_20d"),
    Rule("baseline_gap_continuation_v1", "gap_continuation", "BUY", 1.025, 0.98, 2, "target_stop_or_2_days",
         "open >= prior_close * 1.015D AND close > open", "gap_pct", "gap_pct open close prior_close"),
    Rule("baseline_gap_fade_v1", "gap_fade", "SELL", 0.975, 1.02, 2, "target_stop_or_2_days",
         "open >= prior_close * 1.03D AND close < open", "gap_pct", "gap_pct open close prior_close"),
    Rule("baseline_relative_strength_ranking_v1", "ranking_forca_relativa", "BUY", 1.04, 0.975, 5,
         "rebalance_or_5_days", "_strength_position <= 5", "relative_strength_score",
         "return_20d return_5d relative_volume_20d close sma_20"),
)


def baseline_signals(features: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Signals of all baseline rules from one pass over the features.

    Each row yields an array of the rules that fire, which is then exploded; the
    cross-sectional rule ranks the tickers of a day, a group bounded by the universe.
    """
    day = W.partitionBy("reference_date")

    def pct(c: str) -> Column:
        return F.percent_rank().over(day.orderBy(c))

    strength = (
        0.45 * pct("return_20d")
        + 0.30 * pct("return_5d")
        + 0.15 * pct("relative_volume_20d")
        + 0.10 * F.when(F.col("close") > F.col("sma_20"), 1).otherwise(0)
    )
    order = day.orderBy(F.desc("relative_strength_score"), F.desc("financial_volume"), "ticker")
    ranked = features.withColumn("relative_strength_score", strength).withColumn(
        "_strength_position", F.row_number().over(order)
    )
    hits = [
        F.when(
            F.expr(r.fires),
            F.struct(
                F.lit(r.strategy_id).alias("strategy_id"),
                F.lit(r.family).alias("strategy_family"),
                F.lit(r.side).alias("side"),
                (F.col("close") * r.target).alias("target_price"),
                (F.col("close") * r.stop).alias("stop_price"),
                F.lit(r.exit_rule).alias("exit_rule"),
                F.lit(r.horizon).alias("max_horizon_days"),
                F.expr(r.score).alias("ranking_score"),
                F.to_json(F.struct(*r.metadata.split())).alias("metadata_json"),
            ),
        )
        for r in rules
    ]
    fired = ranked.select(
        "ticker", "reference_date", "close", F.inline(F.array_compact(F.array(*hits)))
    ).withColumnRenamed("close", "expected_entry_price")
    key = ["strategy_id", "ticker", F.col("reference_date").cast("string"), "side"]
    return fired.withColumns(
        {
            "signal_fingerprint": F.xxhash64(F.concat_ws("|", *key)),
            "signal_id": F.concat_ws(":", *key),
            "strategy_version": F.lit("v1"),
            "config_version": F.lit("phase2_baseline"),
            "signal_timestamp": F.col("reference_date").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS"),
            "max_horizon_bars": F.col("max_horizon_days"),
            "bar_granularity": F.lit("1d"),
        }
    )


def baseline_status(config: DataFrame, signals: DataFrame, metrics: DataFrame) -> DataFrame:
    """Configured strategies with their signal counts, newest metrics and verdict."""
    keys = ["strategy_id", "strategy_version"]
    counts = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("generated_signals"),
        F.count_distinct("reference_date").alias("signal_days"),
        F.max("reference_date").alias("last_signal_date"),
    )
    newest = latest_by(metrics, keys, [F.desc("metric_date"), F.col("side")]).select(
        *keys, "trades", "expectancy_net_pct", "profit_factor", "max_drawdown_pct", "robustness_score"
    )
    zero = F.lit(0)
    verdict = status_chain(
        [
            (F.coalesce("generated_signals", zero) == 0, "sem_sinais"),
            (F.coalesce("trades", zero) < 30, "amostra_insuficiente"),
            (
                (F.col("expectancy_net_pct") > 0)
                & (F.col("profit_factor") >= 1.1)
                & (F.col("max_drawdown_pct") >= -0.20),
                "promissora",
            ),
            ((F.col("expectancy_net_pct") <= 0) | (F.col("profit_factor") < 1), "reprovada"),
        ],
        "em_teste",
    )
    return (
        config.join(counts, keys, "left")
        .join(newest, keys, "left")
        .withColumns(
            {
                "computed_status": verdict,
                "generated_signals": F.coalesce("generated_signals", zero),
                "signal_days": F.coalesce("signal_days", zero),
            }
        )
    )


def strategy_detail_alerts(status: DataFrame) -> DataFrame:
    def nz(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    return status.withColumn(
        "alerts",
        failed_criteria(
            [
                ("amostra_insuficiente", nz("trades") < 30),
                ("sem_expectativa_liquida_positiva", nz("expectancy_net_pct") <= 0),
                ("profit_factor_fraco", nz("profit_factor") < 1),
                ("drawdown_elevado", nz("max_drawdown_pct") < -0.20),
            ]
        ),
    )


# ---------------------------------------------------------------- conditional signals


@dataclass(frozen=True)
class SignalConfig:
    top_n: int | None = SIGNALS_PER_DAY
    x_pct: float = 0.02
    target_pct: float = 0.07
    stop_pct: float = 0.07
    allow_sell: bool = True
    horizon_days: int = 10

    def __post_init__(self) -> None:
        if self.x_pct < 0:
            raise ValueError("x_pct must not be negative")
        if min(self.target_pct, self.stop_pct, self.horizon_days) <= 0:
            raise ValueError("target_pct, stop_pct and horizon_days must be positive")

    @property
    def limit(self) -> int | None:
        return None if self.top_n is None else max(0, self.top_n)


def number(df: DataFrame, c: str) -> Column:
    """Column as double with NaN as NULL; NULL when the column is absent."""
    if c not in df.columns:
        return F.lit(None).cast("double")
    v = F.col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def liquidity(df: DataFrame) -> Column:
    """First non-zero of financial volume, volume and traded quantity."""
    picks = [F.nullif(number(df, c), F.lit(0.0)) for c in ("financial_volume", "volume", "traded_quantity")]
    return F.coalesce(*picks, F.lit(0.0))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def candidate_score(liq: Column, high: Column, low: Column, close: Column, win: Column, pf: Column) -> Column:
    """Blend of back-test quality and liquidity minus a volatility penalty, within [0, 1]."""
    depth = F.when(liq > 0, _clamp((F.log10(liq) - 4.0) / 6.0)).otherwise(0.0)
    history = F.coalesce(0.7 * _clamp(win) + 0.3 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), pf) / 3.0), F.lit(0.5))
    spread = F.greatest(high - low, F.lit(0.0)) / close
    penalty = F.when(close > 0, F.least(spread / 0.12, F.lit(1.0)) * 0.1).otherwise(0.0)
    return _clamp(0.6 * history + 0.4 * depth - penalty)


def _levels(df: DataFrame, cfg: SignalConfig) -> DataFrame:
    """Entry away from the close, target and stop away from the entry, mirrored for SELL."""
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    factor = 1 - sign * cfg.x_pct
    df = df.withColumn("entry", F.col("close") * factor)
    return df.withColumns(
        {
            "target": F.col("entry") * (1 + sign * cfg.target_pct),
            "stop": F.col("entry") * (1 - sign * cfg.stop_pct),
            "x_rule": F.format_string("close(D)*%.4f", factor),
            "y_target_pct": F.lit(cfg.target_pct),
            "y_stop_pct": F.lit(cfg.stop_pct),
            "horizon_days": F.lit(cfg.horizon_days),
        }
    )


def _pick(df: DataFrame, cfg: SignalConfig, order: list[Column]) -> DataFrame:
    """Best candidate per ticker, then the best ``limit`` tickers of each day."""
    best = top_n_by(df, ["reference_date", "ticker"], order, 1, "_best").drop("_best")
    picked = top_n_by(best, ["reference_date"], order, cfg.limit)
    return picked.select(
        "reference_date", "ticker", "side",
        *[F.round(c, 4).alias(c) for c in ("entry", "target", "stop")],
        "rank", "x_rule", "y_target_pct", "y_stop_pct", "volume", "close", "score", "ranking_key", "horizon_days",
    )


def conditional_candidates(daily: DataFrame, metrics: DataFrame | None, cfg: SignalConfig) -> DataFrame:
    require_columns(daily, ["reference_date", "ticker", "close"])
    close = number(daily, "close")
    base = daily.select(
        "reference_date",
        clean_ticker("ticker").alias("ticker"),
        close.alias("close"),
        (number(daily, "open") if "open" in daily.columns else close).alias("open"),
        # a missing or zero high / low falls back to the close
        F.coalesce(F.nullif(number(daily, "high"), F.lit(0.0)), close).alias("high"),
        F.coalesce(F.nullif(number(daily, "low"), F.lit(0.0)), close).alias("low"),
        liquidity(daily).alias("volume"),
    ).where("close IS NOT NULL AND ticker <> ''")
    sides = F.array(*[F.lit(s) for s in (("BUY", "SELL") if cfg.allow_sell else ("BUY",))])
    both = base.withColumn("side", F.explode(sides))
    if metrics is None:
        both = both.withColumns({"win_rate": F.lit(None).cast("double"), "profit_factor": F.lit(None).cast("double")})
    else:
        known = metrics.where("trim(ticker) <> '' AND upper(trim(side)) IN ('BUY', 'SELL')").select(
            clean_ticker("ticker").alias("ticker"),
            clean_ticker("side").alias("side"),
            F.coalesce(number(metrics, "win_rate"), F.lit(0.0)).alias("win_rate"),
            F.coalesce(number(metrics, "profit_factor"), F.lit(0.0)).alias("profit_factor"),
            *[c for c in ("as_of_date", "created_at") if c in metrics.columns],
        )
        # repeated metrics of one side: the newest, as far as the table says which that is
        newest = [F.desc(c) for c in ("as_of_date", "created_at") if c in metrics.columns]
        known = latest_by(known, ["ticker", "side"], [*newest, F.desc("profit_factor"), F.desc("win_rate")])
        both = both.join(known.select("ticker", "side", "win_rate", "profit_factor"), ["ticker", "side"], "left")
    preferred = F.when(F.col("close") > F.col("open"), "SELL").otherwise("BUY")
    return _levels(
        both.withColumns(
            {
                "score": candidate_score(
                    F.col("volume"), F.col("high"), F.col("low"), F.col("close"),
                    F.col("win_rate"), F.col("profit_factor"),
                ),
                "priority": F.when(F.col("side") == preferred, 0).otherwise(1),
            }
        ),
        cfg,
    )


def conditional_signals(
    daily: DataFrame, metrics: DataFrame | None = None, cfg: SignalConfig = SignalConfig(),
    ranking_key: str = "score_v1",
) -> DataFrame:
    """Ranked conditional entries per day, at most ``cfg.top_n`` tickers.

    ``metrics`` feeds the score where present; of several rows per ticker and side the newest counts.
    """
    ranked = conditional_candidates(daily, metrics, cfg).withColumn("ranking_key", F.lit(ranking_key))
    return _pick(ranked, cfg, [F.desc("score"), F.col("priority"), F.col("ticker"), F.col("side")])


def prediction_signals(
    predictions: DataFrame, cfg: SignalConfig = SignalConfig(),
    min_buy: float = 0.60, min_sell: float = 0.60, ranking_key: str = "neural_confidence_v1",
) -> DataFrame:
    """Ranked entries out of directional predictions that clear their side's confidence."""
    require_columns(predictions, ["reference_date", "ticker", "close", "suggested_action", "confidence"])
    rows = predictions.select(
        "reference_date",
        clean_ticker("ticker").alias("ticker"),
        clean_ticker("suggested_action").alias("side"),
        number(predictions, "close").alias("close"),
        number(predictions, "confidence").alias("score"),
        liquidity(predictions).alias("volume"),
        F.lit(ranking_key).alias("ranking_key"),
    ).where("close IS NOT NULL AND score IS NOT NULL AND ticker <> ''")
    buy = (F.col("side") == "BUY") & (F.col("score") >= min_buy)
    sell = (F.col("side") == "SELL") & (F.col("score") >= min_sell) & F.lit(cfg.allow_sell)
    return _pick(_levels(rows.where(buy | sell), cfg), cfg, [F.desc("score"), F.col("ticker"), F.col("side")])


def hybrid_signals(
    predictions: DataFrame, metrics: DataFrame | None = None, cfg: SignalConfig = SignalConfig(),
    min_buy: float = 0.60, min_sell: float = 0.60, model_weight: float = 0.7, heuristic_cap: int | None = SIGNALS_PER_DAY,
) -> DataFrame:
    """Prediction signals whose confidence is blended with the heuristic score.

    The day's ``heuristic_cap`` best heuristic signals (None: all) carry a score; others count as 0, and so does a
    missing confidence.
    """
    heuristic = conditional_signals(predictions, metrics, replace(cfg, top_n=heuristic_cap)).select(
        "reference_date", "ticker", F.col("side").alias("suggested_action"), F.col("score").alias("_heuristic")
    )
    blended = (
        predictions.withColumn("ticker", clean_ticker("ticker"))
        .withColumn("suggested_action", clean_ticker("suggested_action"))
        .join(heuristic, ["reference_date", "ticker", "suggested_action"], "left")
        .withColumn(
            "confidence",
            model_weight * F.coalesce(number(predictions, "confidence"), F.lit(0.0)) + (1 - model_weight) * F.coalesce("_heuristic", F.lit(0.0)),
        )
    )
    return prediction_signals(blended.drop("_heuristic"), cfg, min_buy, min_sell, "hybrid_confidence_v1")


def liquid_rows(daily: DataFrame, minimum: float) -> DataFrame:
    """Rows with at least ``minimum`` financial volume; a missing volume counts as 0."""
    return daily.where(F.coalesce(number(daily, "financial_volume"), F.lit(0.0)) >= minimum)


def source_snapshot(daily: DataFrame) -> DataFrame:
    """Content hash of a day's inputs.

    Row hashes are added up in two independent lanes, so the value does not depend on row order and no day's rows
    are gathered in one place. Numbers enter as whole millionths.
    """
    millionths = lambda c: F.floor(c * 1e6 + 0.5).cast("string")
    row = F.md5(F.concat_ws("|", clean_ticker("ticker"), millionths(F.col("close")), millionths(liquidity(daily))))
    lanes = [F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)")) for i in (1, 16)]
    return (
        daily.groupBy("reference_date")
        .agg(F.count(F.lit(1)).alias("rows"), lanes[0].alias("_a"), lanes[1].alias("_b"))
        .select(
            "reference_date",
            "rows",
            F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("rows", "_a", "_b")]), 256).alias(
                "source_snapshot"
            ),
        )
    )


def suggested_action(prob_up: Column, prob_down: Column, threshold: float) -> tuple[Column, Column]:
    """(action, confidence) of a prediction."""
    buy = (prob_up >= threshold) & (prob_up >= prob_down)
    sell = (prob_down >= threshold) & (prob_down > prob_up)
    action = F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD")
    return action, F.greatest(prob_up, prob_down)
