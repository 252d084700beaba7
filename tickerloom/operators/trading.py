"""Paper trading, controlled operation and the daily evaluation of research evidence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import clean_ticker, failed_criteria, safe_div, status_chain, sum_if
from ..functions.frames import latest_by, top_n_by, with_one_row

# fixed values: order states
OPEN_STATES = ("aberta", "entrada_simulada")
CLOSED_STATES = ("encerrada", "stop", "target", "expire", "time_stop")
KEY = ["strategy_id", "strategy_version"]


def _open() -> Column:
    return F.col("order_status").isin(*OPEN_STATES)


def _closed() -> Column:
    return F.col("order_status").isin(*CLOSED_STATES)


def active(config: DataFrame, key: str, status: str) -> DataFrame:
    """Newest version per id among the rows with the given status."""
    return latest_by(config.where(F.col("status") == status), [key], [F.desc("updated_at")]).drop("status", "updated_at")


def paper_candidate_signals(signals: DataFrame, exposure: DataFrame, config: DataFrame, as_of: dt.date, days: int = 10) -> DataFrame:
    """Signals of the last ``days`` days with the regime verdict on trading them."""
    recent = signals.where(F.col("reference_date") >= F.lit(as_of - dt.timedelta(days=days)))
    by_day = exposure.select(
        "reference_date", F.col("market_regime").alias("regime_label"), "exposure_action",
        F.col("max_exposure_pct").alias("recommended_exposure_pct"), "max_trades",
    )
    act, side = F.col("exposure_action"), F.upper("side")
    return (
        with_one_row(recent, active(config, "config_id", "em_teste"))
        .join(F.broadcast(by_day), "reference_date", "left")
        .withColumns(
            {
                "max_trades_per_day": F.coalesce("max_trades", "max_daily_orders"),
                "paper_signal_status": status_chain(
                    [
                        (act == "ficar_em_caixa", "filtrado_regime_caixa"),
                        ((act == "bloquear_compras") & (side == "BUY"), "filtrado_bloqueio_compra"),
                        ((act == "bloquear_vendas") & (side == "SELL"), "filtrado_bloqueio_venda"),
                    ],
                    "candidato_paper",
                ),
            }
        )
    )


def paper_dashboard(orders: DataFrame, max_divergence: float = 0.5) -> DataFrame:
    """Orders per day, running result and adherence. The running sum sees one row per day."""
    n = F.count(F.lit(1))
    daily = orders.groupBy("reference_date").agg(
        F.count_if(_open()).alias("open_orders"),
        F.count_if(_closed()).alias("closed_orders"),
        n.alias("total_orders"),
        F.sum(F.coalesce("net_pnl_pct", F.lit(0.0))).alias("daily_net_pnl_pct"),
        F.avg("slippage_pct").alias("avg_slippage_pct"),
        F.avg(F.abs("divergence_pct")).alias("avg_abs_divergence_pct"),
        safe_div(F.count("simulated_entry_price"), n).alias("execution_rate"),
    )
    w = W.orderBy("reference_date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumns(
        {
            "accumulated_net_pnl_pct": F.sum("daily_net_pnl_pct").over(w),
            "adherence_status": status_chain(
                [
                    (F.col("total_orders") == 0, "sem_operacoes"),
                    (F.col("avg_abs_divergence_pct") > max_divergence, "divergencia_alta"),
                    (F.col("execution_rate") < 0.80, "baixa_execucao"),
                ],
                "aderente",
            ),
        }
    )


def paper_open_orders(orders: DataFrame) -> DataFrame:
    return orders.where(_open()).orderBy(F.desc("opened_at"), "paper_order_id")


def paper_closed_today(orders: DataFrame, as_of: dt.date) -> DataFrame:
    done = orders.where(_closed() & (F.col("reference_date") == F.lit(as_of)))
    return done.orderBy(F.desc("closed_at"), "paper_order_id")


def paper_adherence(orders: DataFrame) -> DataFrame:
    """Closed orders per strategy and ticker: expected against realised result."""
    n = F.count(F.lit(1))
    gap = F.col("avg_abs_divergence_pct")
    return (
        orders.where(_closed())
        .groupBy("strategy_id", "strategy_family", "strategy_version", "ticker")
        .agg(
            n.alias("paper_trades"),
            F.avg("expected_backtest_pnl_pct").alias("expected_backtest_pnl_pct"),
            F.avg("net_pnl_pct").alias("realized_paper_pnl_pct"),
            F.avg("slippage_pct").alias("avg_slippage_pct"),
            F.avg("divergence_pct").alias("avg_divergence_pct"),
            F.avg(F.abs("divergence_pct")).alias("avg_abs_divergence_pct"),
            safe_div(F.count("simulated_entry_price"), n).alias("execution_rate"),
        )
        .withColumn(
            "adherence_status",
            status_chain(
                [
                    (F.col("paper_trades") < 20, "amostra_paper_insuficiente"),
                    ((F.col("realized_paper_pnl_pct") > 0) & (gap <= 0.50), "aderente_positivo"),
                    (gap > 0.50, "divergencia_explicar"),
                ],
                "paper_negativo",
            ),
        )
    )


def paper_metrics(orders: DataFrame, family: str = "neural_eod") -> DataFrame:
    """Order statistics of one strategy family per version and date."""
    net = F.col("net_pnl_pct")
    n = F.count(F.lit(1))
    return (
        orders.where(F.col("strategy_family") == family)
        .groupBy(F.col("strategy_version").alias("model_version"), "reference_date")
        .agg(
            n.alias("total_orders"),
            F.count_if(_open()).alias("open_orders"),
            F.count_if(_closed()).alias("closed_orders"),
            safe_div(F.count("simulated_entry_price"), n).alias("fill_rate"),
            F.avg(net).alias("avg_return_pct"),
            safe_div(sum_if(net > 0, net), F.abs(sum_if(net < 0, net))).alias("profit_factor"),
            safe_div(F.count_if(net > 0), F.count(net)).alias("win_rate"),
            F.avg("slippage_pct").alias("avg_slippage_pct"),
            F.avg(F.abs("divergence_pct")).alias("avg_abs_backtest_divergence_pct"),
        )
    )


def operational_diary(log: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    recent = log.where(F.col("reference_date") >= F.lit(as_of - dt.timedelta(days=days)))
    return recent.orderBy(F.desc("event_timestamp"), "decision_id")


def build_paper_orders(
    signals: DataFrame, run_id: str, quantity: int = 100, cost_pct: float = 0.0005,
    slippage_pct: float = 0.001, max_orders: int = 5,
) -> DataFrame:
    """Simulated orders for each day's best signals, entered with slippage."""
    if quantity <= 0 or max_orders < 0 or min(cost_pct, slippage_pct) < 0:
        raise ValueError("quantity must be positive; costs and max_orders must not be negative")
    rows = signals.withColumns(
        {
            "ticker": clean_ticker("ticker"),
            "side": clean_ticker("side"),
            "rank": F.coalesce("rank", F.lit(999999)),
            "score": F.coalesce("score", F.lit(0.0)),
        }
    ).where("ticker <> '' AND side IN ('BUY', 'SELL') AND entry IS NOT NULL")
    picked = top_n_by(rows, ["reference_date"], [F.col("rank"), F.desc("score"), F.col("ticker")], max_orders, "_n")
    slipped = F.col("entry") * F.when(F.col("side") == "BUY", 1 + slippage_pct).otherwise(1 - slippage_pct)
    parts = [F.col(c).cast("string") for c in ("reference_date", "valid_for", "ticker", "side", "model_version", "rank")]
    return picked.select(
        F.substring(F.sha2(F.concat_ws("|", F.lit(run_id), *parts), 256), 1, 32).alias("paper_order_id"),
        F.lit("neural_eod").alias("strategy_id"),
        F.lit("neural_eod").alias("strategy_family"),
        F.col("model_version").alias("strategy_version"),
        "ticker", "side", "reference_date", "valid_for",
        F.col("entry").alias("expected_entry_price"),
        slipped.alias("simulated_entry_price"),
        F.lit(quantity).alias("quantity"),
        F.abs(slipped * quantity).alias("notional_brl"),
        F.lit(cost_pct).alias("estimated_cost_pct"),
        F.lit(slippage_pct).alias("slippage_pct"),
        F.lit("aberta").alias("order_status"),
        F.lit("paper trading neural sem capital real").alias("notes"),
    )


def strategy_committee(
    metrics: DataFrame, robustness: DataFrame, orders: DataFrame, checklist: DataFrame, risk_config: DataFrame
) -> DataFrame:
    """Seven-point checklist per strategy and the recommended status."""
    base = metrics.groupBy("strategy_id", "strategy_family", "strategy_version").agg(
        F.sum("trades").alias("trades"),
        F.avg("expectancy_net_pct").alias("expectancy_net_pct"),
        F.avg("profit_factor").alias("profit_factor"),
        F.min("max_drawdown_pct").alias("max_drawdown_pct"),
    )
    rob = robustness.groupBy(*KEY).agg(
        F.max("robustness_score").alias("robustness_score"),
        F.bool_or(F.col("oos_status") == "aprovado_oos").alias("_oos"),
    )
    paper = (
        orders.where(_closed())
        .groupBy(*KEY)
        .agg(
            F.count_distinct("reference_date").alias("paper_days"),
            F.count(F.lit(1)).alias("paper_trades"),
            F.avg("net_pnl_pct").alias("paper_expectancy_net_pct"),
            F.avg(F.abs("divergence_pct")).alias("avg_abs_divergence_pct"),
        )
    )
    notes = latest_by(checklist, KEY, [F.desc("updated_at")]).select(
        *KEY, "approval_status", "manual_decision", F.col("risk_limits_ok").alias("_limits")
    )
    limits = active(risk_config, "risk_config_id", "ativa").select(
        "min_robustness_score", "min_paper_days", "min_paper_trades"
    )

    def nz(c: str, v=0) -> Column:
        return F.coalesce(F.col(c), F.lit(v))

    joined = with_one_row(base, limits).join(rob, KEY, "left").join(paper, KEY, "left").join(notes, KEY, "left")
    checks = {
        "min_sample_ok": F.col("trades") >= 30,
        "positive_expectancy_ok": F.col("expectancy_net_pct") > 0,
        "drawdown_ok": F.col("max_drawdown_pct") >= -0.20,
        "oos_validation_ok": nz("_oos", False),
        "robustness_ok": nz("robustness_score") >= F.col("min_robustness_score"),
        "paper_trading_ok": (nz("paper_days") >= F.col("min_paper_days"))
        & (nz("paper_trades") >= F.col("min_paper_trades"))
        & (nz("paper_expectancy_net_pct", -999.0) > 0),
        "risk_limits_ok": nz("_limits", False),
    }
    decided = joined.withColumns(checks | {"manual_decision": nz("manual_decision", "pendente")})
    every = F.col("manual_decision") == "aprovar"
    for c in checks:
        every = every & F.col(c)
    return decided.withColumns(
        {
            "approval_status": nz("approval_status", "pesquisa"),
            "recommended_status": status_chain(
                [
                    (F.col("manual_decision") == "reprovar", "reprovada"),
                    (F.col("manual_decision") == "pausar", "pausada"),
                    (every, "piloto"),
                    (nz("paper_days") > 0, "paper_trading"),
                    (nz("robustness_score") > 0, "validacao"),
                ],
                "pesquisa",
            ),
        }
    )


def risk_limits(snapshots: DataFrame, risk_config: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Newest risk snapshot of the last ``days`` days per strategy / ticker / sector against the limits."""
    week = snapshots.where(F.col("reference_date") >= F.lit(as_of - dt.timedelta(days=days)))
    keys = [F.coalesce(F.col(c), F.lit("_ALL_")) for c in ("strategy_id", "ticker", "sector")]
    newest = latest_by(week, keys, [F.desc("snapshot_timestamp"), F.col("snapshot_id")])
    breached = F.col("breached_limit").isNotNull()
    near_day = F.col("daily_pnl_pct") <= -0.80 * F.col("max_daily_loss_pct")
    near_week = F.col("weekly_pnl_pct") <= -0.80 * F.col("max_weekly_loss_pct")
    full = F.col("open_positions") >= F.col("max_open_positions")
    return with_one_row(newest, active(risk_config, "risk_config_id", "ativa")).withColumns(
        {
            "risk_status": status_chain(
                [
                    (breached, "limite_violado"),
                    (near_day, "perto_limite_diario"),
                    (near_week, "perto_limite_semanal"),
                    (full, "limite_posicoes_atingido"),
                ],
                "dentro_dos_limites",
            ),
            "recommended_action": status_chain(
                [
                    (breached & F.col("auto_pause_on_limit_breach"), "pausar_estrategia_imediatamente"),
                    (breached, "bloquear_novas_ordens"),
                    (near_day, "reduzir_exposicao"),
                ],
                "monitorar",
            ),
        }
    )


def shutdown_alerts(limits: DataFrame) -> DataFrame:
    return limits.where("risk_status <> 'dentro_dos_limites'").orderBy(F.desc("snapshot_timestamp"), "snapshot_id")


# ------------------------------------------------------------------ daily evaluation

# fixed values: score thresholds of the decision
PROMOTE, PAPER, BLOCK = 80.0, 65.0, 35.0


def _decision(score: Column, blocking: Column) -> Column:
    return status_chain(
        [
            (blocking | (score < BLOCK), "blocked"),
            (score >= PROMOTE, "approved_candidate"),
            (score >= PAPER, "paper_trading_candidate"),
        ],
        "observe",
    )


def _evaluation(df: DataFrame, kind: str, subject: Column, version: Column, status: Column, fallback: str) -> DataFrame:
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_score")))
    reasons = F.when(F.size("_reasons") == 0, F.array(F.lit(fallback))).otherwise(F.col("_reasons"))
    return df.select(
        F.lit(kind).alias("evaluation_type"), subject.alias("subject_id"), version.alias("subject_version"),
        score.alias("score"), _decision(F.col("_score"), F.col("_blocking")).alias("decision"),
        status.alias("status"), reasons.alias("reasons"),
    )


def daily_evaluation(ranking: DataFrame, robustness: DataFrame, paper: DataFrame, min_days: int = 60) -> DataFrame:
    """Readiness score, decision and reasons for rankings, strategies and the newest paper day."""

    def nz(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    def points(ok: Column, n) -> Column:
        return F.when(ok, n).otherwise(0.0)

    corr, spread = nz("decile_return_correlation"), nz("top_minus_bottom_decile_return_5d")
    rate = nz("positive_day_rate")
    strong = (corr > 0.25) & (spread > 0)
    ranked = ranking.withColumns(
        {
            "_score": points(nz("portfolio_days") >= min_days, 20.0)
            + points(rate >= 0.50, F.least(F.lit(25.0), rate * 35.0))
            + points(nz("avg_excess_vs_random_5d") > 0, 25.0)
            + F.when(strong, 30.0).when(corr <= 0, 0.0).otherwise(10.0),
            "_reasons": failed_criteria(
                [
                    ("amostra_insuficiente_ranking", nz("portfolio_days") < min_days),
                    ("taxa_positiva_baixa", rate < 0.50),
                    ("nao_supera_aleatorio", nz("avg_excess_vs_random_5d") <= 0),
                    ("sem_monotonicidade", ~strong & (corr <= 0)),
                    ("monotonicidade_fraca", ~strong & (corr > 0)),
                ]
            ),
            "_blocking": ~strong & (corr <= 0),
        }
    )
    alerts = F.filter(F.transform(F.split(F.coalesce("overfitting_alerts", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    robust = robustness.withColumns({"_score": nz("robustness_score"), "_reasons": alerts})
    robust = robust.withColumn("_blocking", (F.size("_reasons") > 0) & (F.col("_score") < PAPER))
    newest = paper.orderBy(F.desc("reference_date")).limit(1)
    status = F.coalesce("adherence_status", F.lit("sem_operacoes"))
    papers = newest.withColumns(
        {
            "_score": points(nz("total_orders") > 0, 20.0)
            + points(status == "aderente", 35.0)
            + F.least(F.lit(25.0), nz("execution_rate") * 25.0)
            + points(nz("daily_net_pnl_pct") > 0, 20.0),
            "_reasons": F.array_compact(
                F.array(
                    F.when(nz("total_orders") <= 0, F.lit("sem_operacoes_paper_trading")),
                    F.when(status != "aderente", F.concat(F.lit("aderencia_"), status)),
                    F.when(nz("daily_net_pnl_pct") <= 0, F.lit("pnl_diario_nao_positivo")),
                )
            ),
            "_blocking": status == "divergencia_alta",
        }
    )
    text = F.coalesce
    unknown = F.lit("unknown")
    return (
        _evaluation(ranked, "ranking", text("ranking_model_id", unknown), text("ranking_model_version", unknown),
                    text("ranking_status", unknown), "ranking_aprovado_pelos_criterios_diarios")
        .unionByName(
            _evaluation(robust, "strategy_robustness", text("strategy_id", unknown), text("strategy_version", unknown),
                        text("oos_status", unknown), "robustez_aprovada_pelos_criterios_diarios"))
        .unionByName(
            _evaluation(papers, "paper_trading", F.lit("paper_trading_dashboard"), F.lit("phase6"), status,
                        "paper_trading_aprovado_pelos_criterios_diarios"))
    )
