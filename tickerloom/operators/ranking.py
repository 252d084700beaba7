"""Cross-sectional ranking of assets, top-n portfolios and ranking quality."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import avg_if, safe_div, share_of, status_chain
from ..functions.frames import with_one_row

MODEL = ["ranking_model_id", "ranking_model_version"]
FACTORS = [
    "relative_strength_factor",
    "short_momentum_factor",
    "relative_volume_factor",
    "volatility_factor",
    "mean_distance_factor",
    "candle_quality_factor",
    "index_regime_factor",
]


@dataclass(frozen=True)
class RankingModel:
    ranking_model_id: str
    ranking_model_version: str
    relative_strength: float
    short_momentum: float
    relative_volume: float
    volatility: float
    mean_distance: float
    candle_quality: float
    index_regime: float
    min_financial_volume: float = 1_000_000.0
    status: str = "em_teste"


def ranking_config(spark: SparkSession, models: list[RankingModel]) -> DataFrame:
    return spark.createDataFrame([asdict(m) for m in models])


def ranking_factors(features: DataFrame, min_volume: float = 1_000_000.0) -> DataFrame:
    """Seven factors per asset and day, the 5-day forward return and the market regime label.

    Assets trade at least ``min_volume`` (the published default); a model's own minimum above it applies later.
    Day averages are windows over ``reference_date``: the same exchange also serves the
    percent ranks, so the market summary needs no join.
    """
    series = W.partitionBy("ticker").orderBy("reference_date")
    day = W.partitionBy("reference_date")

    def pct(c: str | Column) -> Column:
        return F.percent_rank().over(day.orderBy(c))

    per_ticker = features.withColumns(
        {
            "volatility_20d": F.stddev_pop(safe_div("close", "prior_close") - 1).over(series.rowsBetween(-19, 0)),
            "distance_from_sma_20": safe_div("close", "sma_20") - 1,
            "close_location_value": safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
            "forward_return_5d": safe_div(F.lead("close", 5).over(series), "close") - 1,
        }
    )
    market = per_ticker.withColumns(
        {
            "breadth_above_sma_20": share_of(F.col("close") > F.col("sma_20")).over(day),
            "market_return_5d": F.avg("return_5d").over(day),
            "market_volatility_20d": F.avg("volatility_20d").over(day),
        }
    ).where(F.col("financial_volume") >= min_volume)
    breadth, move = F.col("breadth_above_sma_20"), F.col("market_return_5d")
    return market.withColumns(
        {
            "relative_strength_factor": pct("return_20d"),
            "short_momentum_factor": pct("return_5d"),
            "relative_volume_factor": pct("relative_volume_20d"),
            "volatility_factor": 1 - pct("volatility_20d"),
            "mean_distance_factor": 1 - pct(F.abs("distance_from_sma_20")),
            "candle_quality_factor": pct("close_location_value"),
            "index_regime_factor": F.when((breadth >= 0.55) & (move > 0), 1.0).otherwise(0.0),
            "market_regime_label": status_chain(
                [
                    ((breadth >= 0.60) & (move > 0), "favoravel"),
                    ((breadth <= 0.40) | (move < -0.03), "desfavoravel"),
                ],
                "neutro",
            ),
        }
    )


def daily_asset_ranking(factors: DataFrame, config: DataFrame) -> DataFrame:
    """Weighted score per model, position, decile, suggested action and confidence."""
    models = config.where("status = 'em_teste'")
    score = None
    for f in FACTORS:
        term = F.col(f.removesuffix("_factor")) * F.col(f)
        score = term if score is None else score + term
    w = W.partitionBy(*MODEL, "reference_date").orderBy(F.desc("final_score"), F.desc("financial_volume"), "ticker")
    ranked = (
        with_one_row(factors, models)
        .where("financial_volume >= min_financial_volume")
        .withColumn("final_score", score)
        .withColumns(
            {
                "ranking_position": F.row_number().over(w),
                "ranking_decile": F.ntile(10).over(w),
                "current_price": F.col("close"),
                "liquidity_value": F.col("financial_volume"),
                "estimated_risk": F.col("volatility_20d"),
            }
        )
    )
    s, pos = F.col("final_score"), F.col("ranking_position")
    breakdown = [*FACTORS, "return_5d", "return_20d", "relative_volume_20d", "distance_from_sma_20",
                 "close_location_value"]
    return ranked.select(
        *MODEL, "reference_date", "ranking_position", "ranking_decile", "ticker", "final_score", *FACTORS,
        "current_price", "liquidity_value", "estimated_risk", "market_regime_label", "forward_return_5d",
        F.to_json(F.struct(*breakdown)).alias("factor_breakdown_json"),
        status_chain(
            [
                (F.col("market_regime_label") == "desfavoravel", "evitar"),
                ((s >= 0.70) & (F.col("estimated_risk") <= 0.05), "operar"),
                (s >= 0.55, "observar"),
            ],
            "evitar",
        ).alias("action_suggestion"),
        status_chain([((s >= 0.75) & (pos <= 5), "alta"), ((s >= 0.60) & (pos <= 10), "media")], "baixa").alias(
            "confidence_label"
        ),
    )


def top_n_portfolios(ranking: DataFrame, sizes: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Average score, forward return and risk of the first n assets of each day."""
    members = ranking.where(F.col("ranking_position") <= max(sizes)).withColumn(
        "top_n", F.explode(F.array(*[F.when(F.col("ranking_position") <= n, n) for n in sizes]))
    )
    picked = F.collect_list(F.struct("ranking_position", "ticker"))
    return (
        members.where("top_n IS NOT NULL")
        .groupBy(*MODEL, "reference_date", "top_n")
        .agg(
            F.count(F.lit(1)).alias("selected_assets"),
            F.avg("final_score").alias("avg_score"),
            F.avg("forward_return_5d").alias("avg_forward_return_5d"),
            F.avg("estimated_risk").alias("avg_estimated_risk"),
            F.sort_array(picked)["ticker"].alias("selected_tickers"),
        )
    )


def ranking_performance(ranking: DataFrame, sizes: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Top-n returns against the day's universe mean, and decile monotonicity.

    Counts and sums per (model, day, decile) carry the deciles and the top-n portfolios alike; one window over the day
    adds the universe mean, and each model is summed up from its few rows per day.
    """
    ret = F.col("forward_return_5d")
    picked = {n: F.when(F.col("ranking_position") <= n, ret) for n in sizes}
    deciles = (
        ranking.where(ret.isNotNull())
        .groupBy(*MODEL, "reference_date", "ranking_decile")
        .agg(
            F.sum(ret).alias("_s"), F.count(ret).alias("_n"),
            *[f(x).alias(f"{name}{n}") for n, x in picked.items() for f, name in ((F.sum, "_s"), (F.count, "_n"))],
        )
    )
    day, own = W.partitionBy("reference_date"), W.partitionBy("reference_date", *MODEL)
    first = F.row_number().over(own.orderBy("ranking_decile")) == 1  # the row that speaks for the day
    rows = deciles.select(
        *MODEL,
        "ranking_decile",
        safe_div("_s", "_n").alias("_r"),
        safe_div(F.sum("_s").over(day), F.sum("_n").over(day)).alias("_mean"),
        *[F.when(first, safe_div(F.sum(f"_s{n}").over(own), F.sum(f"_n{n}").over(own))).alias(f"_top{n}") for n in sizes],
    )

    def portfolio(n: int) -> Column:
        top = F.col(f"_top{n}")
        return F.struct(
            F.lit(n).alias("top_n"),
            F.count(top).alias("portfolio_days"),
            F.avg(top).alias("avg_top_n_return_5d"),
            F.stddev_pop(top).alias("volatility_top_n_return_5d"),
            F.count_if(top > 0).alias("positive_days"),
            F.avg(top - F.col("_mean")).alias("avg_excess_vs_random_5d"),
        )

    corr, excess = F.col("decile_return_correlation"), F.col("avg_excess_vs_random_5d")
    return (
        rows.groupBy(*MODEL)
        .agg(
            F.array(*[portfolio(n) for n in sizes]).alias("_portfolios"),
            F.corr((11 - F.col("ranking_decile")).cast("double"), "_r").alias("decile_return_correlation"),
            avg_if(F.col("ranking_decile") == 1, "_r").alias("top_decile_return_5d"),
            avg_if(F.col("ranking_decile") == 10, "_r").alias("bottom_decile_return_5d"),
        )
        .select(*MODEL, F.inline("_portfolios"), "decile_return_correlation", "top_decile_return_5d", "bottom_decile_return_5d")
        .where("portfolio_days > 0")
        .withColumns(
            {
                "positive_day_rate": safe_div("positive_days", "portfolio_days"),
                "top_minus_bottom_decile_return_5d": F.col("top_decile_return_5d") - F.col("bottom_decile_return_5d"),
                "ranking_status": status_chain(
                    [
                        (F.col("portfolio_days") < 60, "amostra_insuficiente"),
                        ((corr > 0.25) & (excess > 0), "monotonicidade_promissora"),
                        (corr <= 0, "sem_monotonicidade"),
                    ],
                    "em_observacao",
                ),
            }
        )
    )


def ranking_latest(ranking: DataFrame, limit: int) -> DataFrame:
    """Ranking of the newest date, best positions first."""
    newest = ranking.agg(F.max("reference_date").alias("reference_date"))
    return ranking.join(F.broadcast(newest), "reference_date").orderBy("ranking_position", *MODEL).limit(limit)
