"""Market regime, exposure recommendation and regime filters on trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import avg_if, profit_factor, safe_div, share_of, status_chain, sum_if
from ..functions.frames import latest_by, with_one_row

# fixed values: recommendation per regime (action, text)
ACTIONS = {
    "stress": ("ficar_em_caixa", "Stress detectado: retorno curto negativo e baixa amplitude; recomendação é caixa."),
    "baixa_tendencia": ("bloquear_compras", "Tendência de baixa: bloquear compras direcionais e reduzir risco."),
    "alta_volatilidade": (
        "reduzir_posicao",
        "Volatilidade elevada: reduzir posição e limitar quantidade de operações.",
    ),
    "alta_tendencia": (
        "operar_normal",
        "Tendência de alta com amplitude saudável: operar normal dentro dos limites.",
    ),
    "baixa_volatilidade": ("operar_normal", "Volatilidade baixa: operar normal, monitorando rompimentos falsos."),
    "lateral": ("reduzir_posicao", "Mercado lateral: operar seletivamente com exposição reduzida."),
}
NORMAL_REGIMES = ("alta_tendencia", "baixa_volatilidade")


def market_regime_indicators(features: DataFrame) -> DataFrame:
    """One row per session with breadth, returns, volatility and the regime.

    The volatility percentile and the 60-session mean run over the session rows only
    (one per day), after the aggregation over all tickers.
    """
    series = W.partitionBy("ticker").orderBy("reference_date").rowsBetween(-19, 0)
    vol = F.stddev_pop(safe_div("close", "prior_close") - 1).over(series)
    days = (
        features.withColumn("volatility_20d", vol)
        .where("volatility_20d IS NOT NULL")
        .groupBy("reference_date")
        .agg(
            F.count(F.lit(1)).alias("eligible_tickers"),
            F.avg("return_5d").alias("market_return_5d"),
            F.avg("return_20d").alias("market_return_20d"),
            F.avg("volatility_20d").alias("realized_volatility_20d"),
            share_of(F.col("close") > F.col("sma_20")).alias("pct_above_sma_20"),
            share_of(F.col("close") > F.col("sma_50")).alias("pct_above_sma_50"),
            share_of(F.col("return_5d") > 0).alias("pct_positive_5d"),
            F.sum("financial_volume").alias("aggregate_financial_volume"),
            safe_div(F.sum("financial_volume"), F.sum("avg_volume_20d")).alias("aggregate_relative_volume"),
        )
    )
    recent = W.orderBy("reference_date").rowsBetween(-59, 0)
    ranked = days.withColumns(
        {
            "volatility_percentile": F.percent_rank().over(W.orderBy("realized_volatility_20d")),
            "avg_market_volatility_60d": F.avg("realized_volatility_20d").over(recent),
        }
    )
    above, r20, pct = F.col("pct_above_sma_20"), F.col("market_return_20d"), F.col("volatility_percentile")
    regime = status_chain(
        [
            ((F.col("market_return_5d") <= -0.04) & (above <= 0.30), "stress"),
            ((above >= 0.60) & (r20 > 0), "alta_tendencia"),
            ((above <= 0.40) & (r20 < 0), "baixa_tendencia"),
            (pct >= 0.75, "alta_volatilidade"),
            (pct <= 0.25, "baixa_volatilidade"),
        ],
        "lateral",
    )
    shown = ["market_return_5d", "market_return_20d", "realized_volatility_20d", "volatility_percentile",
             "pct_above_sma_20", "pct_above_sma_50", "pct_positive_5d", "aggregate_relative_volume"]
    return ranked.withColumns({"market_regime": regime, "regime_indicators_json": F.to_json(F.struct(*shown))})


def exposure_recommendation(regimes: DataFrame, policies: DataFrame) -> DataFrame:
    """Allowed action, exposure, trade count and risk per session and policy."""
    active = latest_by(policies.where("status = 'em_teste'"), ["policy_id"], [F.desc("updated_at")])
    regime = F.col("market_regime")
    normal = regime.isin(*NORMAL_REGIMES)
    table = F.create_map(*[x for r, v in ACTIONS.items() for x in (F.lit(r), F.array(F.lit(v[0]), F.lit(v[1])))])
    advice = F.element_at(table, regime)

    def choose(c: str) -> Column:
        return F.when(normal, F.col(f"{c}_normal")).otherwise(F.col(f"{c}_reduced"))

    cash = F.when(regime == "stress", F.col("exposure_cash")).otherwise(choose("exposure"))
    return with_one_row(regimes, active.drop("status", "updated_at")).withColumns(
        {
            "exposure_action": advice[0],
            "recommendation_reason": advice[1],
            "max_exposure_pct": cash,
            "max_trades": choose("max_trades"),
            "risk_per_trade_pct": choose("risk_per_trade"),
            "daily_loss_limit_pct": choose("daily_loss_limit"),
        }
    )


def _on_entry_day(trades: DataFrame, by_day: DataFrame, cols: list[str]) -> DataFrame:
    entered = trades.withColumn("reference_date", F.to_date("entry_timestamp"))
    # one row per session and policy: calendar-sized
    return entered.join(F.broadcast(by_day.select("reference_date", *cols)), "reference_date")


def strategy_regime_performance(trades: DataFrame, regimes: DataFrame) -> DataFrame:
    net = F.col("net_pnl_pct")
    mean, n = F.col("expectancy_net_pct"), F.col("trades")
    return (
        _on_entry_day(trades, regimes, ["market_regime"])
        .groupBy("strategy_id", "strategy_version", "market_regime")
        .agg(
            F.count(F.lit(1)).alias("trades"),
            F.avg(net).alias("expectancy_net_pct"),
            share_of(net > 0).alias("win_rate"),
            profit_factor(net).alias("profit_factor"),
            F.sum(net).alias("total_net_pnl_pct"),
        )
        .withColumn(
            "regime_effect_status",
            status_chain([(n < 30, "amostra_insuficiente"), (mean > 0, "favoravel")], "desfavoravel"),
        )
    )


def filter_effectiveness(trades: DataFrame, exposure: DataFrame) -> DataFrame:
    """What the regime filter would have kept and blocked."""
    net = F.col("net_pnl_pct")
    ok = F.col("exposure_action").isin("operar_normal", "reduzir_posicao")
    kept, blocked = F.col("filtered_expectancy_net_pct"), F.col("blocked_expectancy_net_pct")
    return (
        _on_entry_day(trades, exposure, ["exposure_action", "max_exposure_pct"])
        .groupBy("strategy_id", "strategy_version")
        .agg(
            F.count(F.lit(1)).alias("original_trades"),
            F.count_if(ok).alias("trades_after_filter"),
            F.avg(net).alias("original_expectancy_net_pct"),
            avg_if(ok, net).alias("filtered_expectancy_net_pct"),
            avg_if(~ok, net).alias("blocked_expectancy_net_pct"),
            safe_div(F.count_if(~ok), F.count(F.lit(1))).alias("blocked_trade_pct"),
            F.sum(net).alias("original_total_net_pnl_pct"),
            sum_if(ok, net * F.col("max_exposure_pct")).alias("exposure_adjusted_total_net_pnl_pct"),
        )
        .withColumn(
            "filter_effectiveness_status",
            status_chain(
                [
                    (F.col("original_trades") < 30, "amostra_insuficiente"),
                    (kept > F.col("original_expectancy_net_pct"), "filtro_melhorou_expectancy"),
                    (blocked < 0, "bloqueio_removeu_perdas"),
                ],
                "sem_melhoria_clara",
            ),
        )
    )
