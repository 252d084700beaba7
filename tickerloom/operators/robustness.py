"""Out-of-sample splits, walk-forward, stress tests and the robustness score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import failed_criteria, ntile_from_rank, profit_factor, safe_div, share_of, status_chain
from ..functions.frames import latest_by, sequence_in_groups, with_one_row

STRATEGY = ["strategy_id", "strategy_family", "strategy_version"]
KEY = ["strategy_id", "strategy_version"]
SPLITS = {"treino": "train", "validacao": "validation", "teste": "test"}


def active_policy(policies: DataFrame) -> DataFrame:
    return latest_by(policies.where("status = 'em_teste'"), ["policy_id"], [F.desc("updated_at")])


def _net(trades: DataFrame) -> DataFrame:
    return trades.where("net_pnl_pct IS NOT NULL")


def _summary() -> list[Column]:
    net = F.col("net_pnl_pct")
    return [
        F.count(F.lit(1)).alias("trades"),
        F.avg(net).alias("expectancy_net_pct"),
        F.sum(net).alias("total_net_pnl_pct"),
        share_of(net > 0).alias("win_rate"),
        profit_factor(net).alias("profit_factor"),
    ]


def window_status(trades: Column, mean: Column, factor: Column) -> Column:
    return status_chain(
        [
            (trades < 20, "amostra_insuficiente"),
            ((mean > 0) & (factor >= 1.2), "janela_favoravel"),
            (mean > 0, "janela_positiva_fraca"),
        ],
        "janela_negativa",
    )


def cost_status(trades: Column, normal: Column, stressed: Column) -> Column:
    return status_chain(
        [
            (trades < 30, "amostra_insuficiente"),
            (stressed > 0, "robusto_a_custos"),
            ((normal > 0) & (stressed <= 0), "sensivel_a_custos"),
        ],
        "sem_expectativa_liquida",
    )


def random_status() -> Column:
    above = (F.col("excess_expectancy_vs_random_pct") > 0) & (F.col("pct_days_above_random") >= 0.55)
    return status_chain(
        [(F.col("compared_days") < 20, "amostra_insuficiente"), (above, "supera_aleatorizacao")],
        "nao_supera_aleatorizacao",
    )


def oos_splits(trades: DataFrame, policies: DataFrame) -> DataFrame:
    """Train / validation / test by position of the trade within its strategy.

    A strategy may hold most of all trades, so positions come from per-day ranks plus
    day offsets (``sequence_in_groups``) and no strategy is sorted in one task.
    """
    ranked = sequence_in_groups(_net(trades), KEY, "reference_date", ["trade_id"], "trade_seq", "total_trades")
    policy = active_policy(policies).select("policy_id", "policy_version", "train_pct", "validation_pct")
    at = safe_div("trade_seq", "total_trades")
    return with_one_row(ranked, policy).withColumn(
        "validation_split",
        status_chain(
            [
                (at <= F.col("train_pct"), "treino"),
                (at <= F.col("train_pct") + F.col("validation_pct"), "validacao"),
            ],
            "teste",
        ),
    )


def oos_summary(splits: DataFrame, policies: DataFrame) -> DataFrame:
    """Split metrics side by side, degradation against training, verdict."""
    group = ["policy_id", "policy_version", *STRATEGY]
    per_split = splits.groupBy(*group, "validation_split").agg(
        F.min("reference_date").alias("_start"), F.max("reference_date").alias("_end"), *_summary()
    )
    wide = [F.min("_start").alias("period_start"), F.max("_end").alias("period_end")]
    for label, name in SPLITS.items():
        here = F.col("validation_split") == label
        wide.append(F.sum(F.when(here, F.col("trades")).otherwise(0)).alias(f"{name}_trades"))
        for m in ("expectancy_net_pct", "profit_factor"):
            wide.append(F.max(F.when(here, F.col(m))).alias(f"{name}_{m}"))
    base = F.col("train_expectancy_net_pct")

    def degradation(name: str) -> Column:
        return safe_div(base - F.col(f"{name}_expectancy_net_pct"), F.abs(base))

    limits = policies.select("policy_id", "policy_version", "min_trades_per_split", "max_oos_degradation_pct")
    least = F.least("train_trades", "validation_trades", "test_trades")
    return (
        per_split.groupBy(*group)
        .agg(*wide)
        .withColumns({f"{n}_degradation_pct": degradation(n) for n in ("validation", "test")})
        .join(F.broadcast(limits), ["policy_id", "policy_version"])
        .withColumn(
            "oos_status",
            status_chain(
                [
                    (least < F.col("min_trades_per_split"), "amostra_insuficiente"),
                    (
                        (F.col("validation_expectancy_net_pct") <= 0) | (F.col("test_expectancy_net_pct") <= 0),
                        "falha_fora_da_amostra",
                    ),
                    (F.col("test_degradation_pct") > F.col("max_oos_degradation_pct"), "degradacao_excessiva"),
                ],
                "aprovado_oos",
            ),
        )
        .drop("min_trades_per_split", "max_oos_degradation_pct")
    )


def walk_forward(trades: DataFrame) -> DataFrame:
    """Monthly buckets with trailing six-month statistics."""
    start = F.trunc("reference_date", "month")
    monthly = (
        _net(trades)
        .groupBy(*STRATEGY, start.alias("window_start"))
        .agg(*_summary())
        .withColumn("window_end", F.last_day("window_start"))
    )
    w6 = W.partitionBy(*KEY).orderBy("window_start").rowsBetween(-5, 0)
    mean = F.col("expectancy_net_pct")
    return monthly.withColumns(
        {
            "rolling_expectancy_6m": F.avg(mean).over(w6),
            "positive_windows_6m": F.count_if(mean > 0).over(w6),
            "walk_forward_status": window_status(F.col("trades"), mean, F.col("profit_factor")),
        }
    )


def subperiod_asset_group_tests(trades: DataFrame) -> DataFrame:
    """Metrics per month and per ticker quintile (ties within a ticker by trade id)."""
    ranked = sequence_in_groups(_net(trades), KEY, "ticker", ["trade_id"])
    group = ntile_from_rank(F.col("seq"), F.col("total"), 5).cast("int").cast("string")
    labels = F.array(
        F.struct(F.lit("subperiodo_mensal").alias("test_type"),
                 F.date_format("reference_date", "yyyy-MM").alias("bucket_label")),
        F.struct(F.lit("grupo_ativos_quintil").alias("test_type"),
                 F.concat(F.lit("grupo_"), group).alias("bucket_label")),
    )
    return (
        ranked.select(*STRATEGY, "net_pnl_pct", F.inline(labels))
        .groupBy(*STRATEGY, "test_type", "bucket_label")
        .agg(*_summary())
        .drop("win_rate")
    )


def cost_stress(trades: DataFrame, policies: DataFrame) -> DataFrame:
    """Expectancy under normal and multiplied costs and slippage."""
    policy = active_policy(policies).select("stressed_cost_multiplier", "stressed_slippage_multiplier")
    gross, cost, slip = (F.col(c) for c in ("gross_pnl_pct", "estimated_cost_pct", "slippage_pct"))
    more_cost = cost * F.col("stressed_cost_multiplier")
    more_slip = slip * F.col("stressed_slippage_multiplier")
    total = F.col("expectancy_stressed_total_pct")
    return (
        with_one_row(trades.where("gross_pnl_pct IS NOT NULL"), policy)
        .groupBy(*STRATEGY)
        .agg(
            F.count(F.lit(1)).alias("trades"),
            F.avg(gross).alias("expectancy_without_cost_pct"),
            F.avg(gross - cost - slip).alias("expectancy_normal_cost_pct"),
            F.avg(gross - more_cost - slip).alias("expectancy_stressed_cost_pct"),
            F.avg(gross - cost - more_slip).alias("expectancy_stressed_slippage_pct"),
            F.avg(gross - more_cost - more_slip).alias("expectancy_stressed_total_pct"),
        )
        .withColumn("cost_stress_status", cost_status(F.col("trades"), F.col("expectancy_normal_cost_pct"), total))
    )


def randomization_benchmark(trades: DataFrame) -> DataFrame:
    """Strategy day mean against the day mean of all trades.

    The day mean comes from one pre-aggregated row per strategy and day, so trades are
    never joined with each other.
    """
    daily = _net(trades).groupBy(*STRATEGY, "reference_date").agg(
        F.sum("net_pnl_pct").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    same_day = W.partitionBy("reference_date")
    days = daily.select(
        *STRATEGY,
        safe_div("_s", "_n").alias("own"),
        safe_div(F.sum("_s").over(same_day), F.sum("_n").over(same_day)).alias("all_"),
    )
    return (
        days.groupBy(*STRATEGY)
        .agg(
            F.count(F.lit(1)).alias("compared_days"),
            F.avg("own").alias("strategy_expectancy_net_pct"),
            F.avg("all_").alias("random_expectancy_net_pct"),
            F.avg(F.col("own") - F.col("all_")).alias("excess_expectancy_vs_random_pct"),
            share_of(F.col("own") > F.col("all_")).alias("pct_days_above_random"),
        )
        .withColumn("randomization_status", random_status())
    )


def parameter_sensitivity(config: DataFrame, metrics: DataFrame) -> DataFrame:
    newest = latest_by(metrics, KEY, [F.desc("metric_date"), F.col("side")]).select(
        *KEY, "trades", "expectancy_net_pct", "profit_factor", "max_drawdown_pct", "robustness_score"
    )

    def param(name: str) -> Column:
        return F.get_json_object("parameters_json", f"$.{name}")

    return config.join(newest, KEY, "left").withColumns(
        {
            "parameter_1_value": param("lookback_return_days"),
            "parameter_2_value": F.coalesce(param("target_pct"), param("top_n"), param("min_gap_pct")),
            "sensitivity_status": status_chain(
                [
                    (F.col("trades") < 30, "amostra_insuficiente"),
                    (F.col("robustness_score") >= 60, "parametros_estaveis"),
                    (
                        (F.col("expectancy_net_pct") > 0) & (F.col("profit_factor") >= 1.2),
                        "candidato_a_grade_parametros",
                    ),
                ],
                "parametros_fragil",
            ),
        }
    )


def trade_tests(trades: DataFrame, policies: DataFrame) -> DataFrame:
    """Walk-forward, cost stress and randomisation of each strategy version from one pass over the trades.

    Counts and sums per (strategy version, day) are all that the three tests need: a window over the day compares with
    all strategies, months and strategies add the days up. Only these sums are shuffled, never the trades, and the
    tests need no join with each other. A strategy version has one family.
    """
    net, gross, cost, slip = (F.col(c) for c in ("net_pnl_pct", "gross_pnl_pct", "estimated_cost_pct", "slippage_pct"))
    priced = gross.isNotNull() & cost.isNotNull() & slip.isNotNull()
    days = trades.groupBy(*KEY, "reference_date").agg(
        F.count(net).alias("n"),
        F.sum(net).alias("s"),
        F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)).alias("gain"),
        F.coalesce(F.sum(F.when(net < 0, net)), F.lit(0.0)).alias("loss"),
        F.count(gross).alias("gross_n"),
        F.sum(gross).alias("gross"),
        F.count_if(priced).alias("priced_n"),
        F.sum(F.when(priced, gross)).alias("priced"),
        F.sum(F.when(priced, cost)).alias("cost"),
        F.sum(F.when(priced, slip)).alias("slip"),
    )
    same_day = W.partitionBy("reference_date")
    compared = days.withColumns(
        {
            "own": safe_div("s", "n"),
            "others": safe_div(F.sum("s").over(same_day), F.sum("n").over(same_day)),
        }
    )
    added = ("n", "s", "gain", "loss", "gross_n", "gross", "priced_n", "priced", "cost", "slip")
    months = compared.groupBy(*KEY, F.trunc("reference_date", "month").alias("month")).agg(
        *[F.sum(c).alias(c) for c in added],
        F.count("own").alias("days"),
        F.sum(F.col("own") - F.col("others")).alias("excess"),
        F.count_if(F.col("own") > F.col("others")).alias("above"),
    )
    mean = safe_div("s", "n")
    favourable = window_status(F.col("n"), mean, safe_div("gain", F.abs("loss"))).isin("janela_favoravel", "janela_positiva_fraca")
    traded = F.col("n") > 0
    totals = months.groupBy(*KEY).agg(
        F.count_if(traded).alias("walk_forward_windows"),
        safe_div(F.count_if(traded & favourable), F.count_if(traded)).alias("pct_positive_walk_forward_windows"),
        F.avg(mean).alias("avg_walk_forward_expectancy_net_pct"),
        *[F.sum(c).alias(c) for c in ("gross_n", "gross", "priced_n", "priced", "cost", "slip", "days", "excess", "above")],
    )
    policy = active_policy(policies).select("stressed_cost_multiplier", "stressed_slippage_multiplier")

    def after(cost_factor: Column | int, slip_factor: Column | int) -> Column:
        return safe_div(F.col("priced") - F.col("cost") * cost_factor - F.col("slip") * slip_factor, "priced_n")

    stressed = after(F.col("stressed_cost_multiplier"), F.col("stressed_slippage_multiplier"))
    return (
        with_one_row(totals, policy)
        .withColumns(
            {
                "expectancy_without_cost_pct": safe_div("gross", "gross_n"),
                "expectancy_normal_cost_pct": after(1, 1),
                "expectancy_stressed_total_pct": stressed,
                "compared_days": F.col("days"),
                "excess_expectancy_vs_random_pct": safe_div("excess", "days"),
                "pct_days_above_random": safe_div("above", "days"),
            }
        )
        .select(
            *KEY, "walk_forward_windows", "pct_positive_walk_forward_windows", "avg_walk_forward_expectancy_net_pct",
            "expectancy_without_cost_pct", "expectancy_normal_cost_pct", "expectancy_stressed_total_pct",
            F.when(
                F.col("gross_n") > 0,
                cost_status(F.col("gross_n"), F.col("expectancy_normal_cost_pct"), F.col("expectancy_stressed_total_pct")),
            ).alias("cost_stress_status"),
            "excess_expectancy_vs_random_pct", "pct_days_above_random",
            F.when(F.col("days") > 0, random_status()).alias("randomization_status"),
        )
    )


def robustness_dashboard(oos: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per strategy of ``oos_summary``: the tests of ``trade_tests``, a 0-100 score and the alerts."""
    share = F.coalesce("pct_positive_walk_forward_windows", F.lit(0.0))

    def points(ok: Column, n: float) -> Column:
        return F.when(ok, n).otherwise(0.0)

    score = (
        points(F.col("oos_status") == "aprovado_oos", 35.0)
        + F.when(share >= 0.60, 25.0).otherwise(share * 25.0)
        + points(F.col("cost_stress_status") == "robusto_a_custos", 20.0)
        + points(F.col("randomization_status") == "supera_aleatorizacao", 20.0)
    )
    alerts = failed_criteria(
        [
            ("falha_ou_degradacao_fora_da_amostra", F.col("oos_status") != "aprovado_oos"),
            ("walk_forward_instavel", share < 0.50),
            ("resultado_sensivel_a_custos", F.col("cost_stress_status") != "robusto_a_custos"),
            ("nao_supera_benchmark_aleatorio", F.col("randomization_status") != "supera_aleatorizacao"),
        ]
    )
    return (
        oos.join(tests, KEY, "left")
        .withColumns(
            {
                "robustness_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)),
                "overfitting_alerts": F.array_join(alerts, ","),
            }
        )
    )
