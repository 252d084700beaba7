"""Economic evidence of model decisions: policy filters, fold metrics, family evaluation, gate.

Rows of many families, seeds and folds live in one long table, so every candidate is
judged in one job. ``keys`` names the columns of a trial, e.g. family, seed, fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean_ticker, failed_criteria, safe_div
from ..functions.frames import daily_growth, equity_path, exact_median, top_n_by
from ..sources.io import cut

# fixed values: class order of the probability vector, protocol names
LABELS = ("down", "neutral", "up")
PROTOCOL = "neural_eod_protocol_v1"
GATE_ENGINE = "muen_gate_engine_v1"
RESEARCH_GATE = "research_walk_forward"
ROW = ["reference_date", "ticker"]


def _is_trade() -> Column:
    return F.coalesce(F.col("predicted_label"), F.lit("neutral")).isin("down", "up")


def _neutral_where(df: DataFrame, pred: Column) -> DataFrame:
    return df.withColumn(
        "predicted_label", F.when(F.coalesce(pred, F.lit(False)), "neutral").otherwise(F.col("predicted_label"))
    )


def directional_labels(df: DataFrame, p_min: float = 0.45, margin: float = 0.05) -> DataFrame:
    """Trade only where the better direction is likely enough and clearly above neutral."""
    if not 0 <= p_min <= 1 or margin < 0:
        raise ValueError("p_min must be in [0, 1] and margin must not be negative")
    best = F.greatest("prob_down", "prob_up")
    side = F.when(F.col("prob_down") >= F.col("prob_up"), "down").otherwise("up")
    sure = (best >= p_min) & (best - F.col("prob_neutral") >= margin)
    return df.withColumn("predicted_label", F.when(sure, side).otherwise("neutral"))


def fold_trade_budget(df: DataFrame, keys: Sequence[str], n: int | None) -> DataFrame:
    """Keep the ``n`` strongest trades per trial (ties: date, ticker), neutralise the others.

    The top-n is limited per task before its shuffle. Each trial's last place, one row a trial, is sent to the rows, so
    these are neither gathered nor shuffled; rows that are equal to it in all of this keep it together. ``df`` is read
    twice: pass stored rows where it is dear.
    """
    if n is None:
        return df
    if n <= 0:
        raise ValueError("n must be positive")
    strength = F.greatest("prob_down", "prob_up") - F.col("prob_neutral")
    place = F.struct(F.col("_s").isNotNull().alias("known"), F.coalesce("_s", F.lit(0.0)).alias("s"))
    at = F.struct(*ROW)
    trades = df.where(_is_trade()).select(*keys, *ROW, strength.alias("_s"))
    last = top_n_by(trades, list(keys), [F.desc("_s"), *[F.col(c) for c in ROW]], n, "_r").where(F.col("_r") == n)
    rows = _with_trial(df.withColumn("_s", strength), last.select(*keys, place.alias("_last"), at.alias("_at")), keys)
    beyond = (place < F.col("_last")) | ((place == F.col("_last")) & (at > F.col("_at")))
    return _neutral_where(rows, ~_is_trade() | F.coalesce(beyond, F.lit(False))).select(*df.columns)


def _with_trial(df: DataFrame, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beside their trial's row, if there is one; a missing key is a key. Trials are sent, rows stay where they are."""
    named = trials.withColumnsRenamed({k: f"_trial_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_trial_{k}")) for k in keys]
    return df.join(F.broadcast(named), reduce(and_, same), "left").drop(*[f"_trial_{k}" for k in keys])


def ticker_blocklist(df: DataFrame, blocked: Sequence[str]) -> DataFrame:
    names = sorted({b.strip().upper() for b in blocked if b.strip()})
    return _neutral_where(df, clean_ticker("ticker").isin(names)) if names else df


def champion_activity_filter(df: DataFrame, required: bool = True) -> DataFrame:
    """No trade where the champion stayed out (zero return)."""
    if not required:
        return df
    return _neutral_where(df, F.abs(F.coalesce("champion_net_return", F.lit(0.0))) <= 1e-12)


def _all_reached(limits: dict[str, tuple[Column, float | None]]) -> Column | None:
    out = None
    for value, limit in limits.values():
        if limit is not None:
            ok = F.coalesce(value >= limit, F.lit(False))
            out = ok if out is None else out & ok
    return out


def regime_liquidity_filter(df, return_5d=None, financial_volume_z20=None, volume_ratio_20d=None) -> DataFrame:
    """No trade below the momentum and liquidity minima; a missing value fails."""
    ok = _all_reached(
        {
            "r": (F.col("return_5d"), return_5d),
            "z": (F.col("financial_volume_z20"), financial_volume_z20),
            "v": (F.col("volume_ratio_20d"), volume_ratio_20d),
        }
    )
    return df if ok is None else _neutral_where(df, ~ok)


def neutral_extreme_event_filter(
    df, abs_return_5d=None, financial_volume_z20=None, volume_ratio_20d=None, volatility_20d=None
) -> DataFrame:
    """No trade where every configured extreme is reached."""
    hit = _all_reached(
        {
            "r": (F.abs("return_5d"), abs_return_5d),
            "z": (F.col("financial_volume_z20"), financial_volume_z20),
            "v": (F.col("volume_ratio_20d"), volume_ratio_20d),
            "s": (F.col("volatility_20d"), volatility_20d),
        }
    )
    return df if hit is None else _neutral_where(df, hit)


def _realised(df: DataFrame) -> DataFrame:
    label = F.col("predicted_label")
    r = F.when(label == "up", F.coalesce("buy_net_return", F.lit(0.0))).when(
        label == "down", F.coalesce("sell_net_return", F.lit(0.0))
    )
    return df.withColumn("model_net_return", F.coalesce(r, F.lit(0.0)))


def fold_drawdown_stop(df: DataFrame, keys: Sequence[str], limit: float | None) -> DataFrame:
    """Neutralise every row after the first one whose drawdown reaches ``limit``.

    Rows are ordered by (date, ticker). Up to the breach labels are unchanged, so the
    unmodified equity path finds it; the peak starts at 1. Rows without a return leave equity and peak
    as they are, so the path is made of the others, and the breach, one row a trial, is sent to the rows.
    """
    if limit is None:
        return df
    if not 0 < limit < 1:
        raise ValueError("limit must be between 0 and 1")
    moves = _realised(df).where("model_net_return <> 0").select(*keys, *ROW, "model_net_return")
    path = equity_path(moves, keys, "reference_date", ["ticker"], "model_net_return")
    peak = F.greatest(F.lit(1.0), "peak")
    at = F.struct(*ROW)
    breach = path.where((peak - F.col("equity")) / peak >= limit).groupBy(*keys).agg(F.min(at).alias("_breach"))
    return _neutral_where(_with_trial(df, breach, keys), at > F.col("_breach")).select(*df.columns)


def fold_economics(df: DataFrame, keys: Sequence[str], cost_multipliers: Sequence[float] = (1.0, 1.5)) -> DataFrame:
    """Economic metrics per trial. The multiplier labels the scenario; returns are already net."""
    if min(cost_multipliers) <= 0:
        raise ValueError("cost multipliers must be positive")
    rows = _realised(df).select(
        *keys, *ROW, "model_net_return", _is_trade().alias("_trade"),
        F.coalesce("champion_net_return", F.lit(0.0)).alias("_champion"),
    )
    rows = cut(rows, "fold-rows")  # the one stored stage: totals, median and daily growth read these few columns
    r = F.when(F.col("_trade"), F.col("model_net_return"))
    zero = F.lit(0.0)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_count"),
        F.count_if("_trade").alias("trades"),
        F.coalesce(F.avg(r), zero).alias("expectancy_net"),
        F.coalesce(F.sum(r), zero).alias("total_net_return"),
        F.coalesce(F.avg(F.when(F.col("_trade"), F.col("_champion"))), zero).alias("_champion"),
        F.coalesce(F.sum(F.when(r > 0, r)), zero).alias("_gain"),
        F.coalesce(F.sum(F.when(r < 0, -r)), zero).alias("_loss"),
        F.count_if(r > 0).alias("_wins"),
    )
    median = exact_median(rows.where("_trade"), keys, "model_net_return", "median_net_return")
    # a row without a return leaves equity and peak as they are, but a trial's first row starts its peak
    first = rows.groupBy(*keys).agg(F.min("reference_date").alias("_first"))
    day = F.col("reference_date")
    moves = _with_trial(rows, first, keys).where((F.col("model_net_return") != 0) | day.isNull() | (day == F.col("_first")))
    days = daily_growth(moves.drop("_first"), keys, "reference_date", ["ticker"], "model_net_return")
    drawdown = days.groupBy(*keys).agg(F.max("max_drawdown").alias("max_drawdown"))
    infinite = F.when(F.col("_gain") > 0, F.lit(float("inf"))).otherwise(zero)
    return (
        base.join(median, list(keys), "left")
        .join(drawdown, list(keys), "left")
        .withColumns(
            {
                "coverage": safe_div("trades", "rows_count"),
                "median_net_return": F.coalesce("median_net_return", zero),
                "profit_factor": F.coalesce(safe_div("_gain", "_loss"), infinite),
                "max_drawdown": F.coalesce("max_drawdown", zero),
                "positive_trade_ratio": F.coalesce(safe_div("_wins", "trades"), zero),
                "delta_expectancy_vs_champion": F.col("expectancy_net") - F.col("_champion"),
                "cost_multiplier": F.explode(F.array(*[F.lit(float(m)) for m in cost_multipliers])),
            }
        )
        .drop("_champion", "_gain", "_loss", "_wins", "rows_count")
    )


def daily_return_rows(df: DataFrame, keys: Sequence[str], protocol: str = PROTOCOL) -> DataFrame:
    """Model return beside the champion's, one row per decision."""
    champion = F.coalesce("champion_net_return", F.lit(0.0))
    trade = F.when(_is_trade(), 1).otherwise(0)
    return (
        _realised(df)
        .where("reference_date IS NOT NULL")
        .select(
            F.lit(protocol).alias("protocol_version"),
            *keys,
            "reference_date",
            F.nullif(clean_ticker("ticker"), F.lit("")).alias("ticker"),
            "model_net_return",
            champion.alias("champion_net_return"),
            (F.col("model_net_return") - champion).alias("delta_net_return"),
            trade.cast("double").alias("exposure"),
            trade.alias("trades"),
        )
    )


def model_economics_job(df: DataFrame, keys: Sequence[str], split: str = "dataset_split", **policy) -> DataFrame:
    """Decision policy and fold metrics for the research splits; train and holdout stay out.

    The trade budget comes before the blocklist: a blocked strong trade still uses budget.
    """
    rows = df.where(F.col(split).isin("validation", "test", "research"))
    keys = [*keys, split]
    needed = ["prob_down", "prob_neutral", "prob_up", "buy_net_return", "sell_net_return", "champion_net_return",
              "return_5d", "financial_volume_z20", "volume_ratio_20d", "volatility_20d"]
    rows = rows.select(*keys, *ROW, *[c for c in needed if c in rows.columns])
    rows = directional_labels(rows, policy.get("p_min", 0.45), policy.get("margin", 0.05))
    rows = fold_trade_budget(rows, keys, policy.get("max_trades"))
    rows = ticker_blocklist(rows, policy.get("blocked", ()))
    rows = champion_activity_filter(rows, policy.get("require_champion", False))
    rows = regime_liquidity_filter(rows, **policy.get("regime", {}))
    rows = neutral_extreme_event_filter(rows, **policy.get("extreme", {}))
    rows = fold_drawdown_stop(rows, keys, policy.get("drawdown_stop"))
    metrics = fold_economics(rows, keys, policy.get("cost_multipliers", (1.0, 1.5)))
    cost = F.replace(F.col("cost_multiplier").cast("string"), F.lit("."), F.lit("_"))
    return metrics.withColumn("fold_id", F.concat(F.col(split), F.lit("_cost_"), cost))


def family_evaluation(folds: DataFrame, family: Sequence[str]) -> DataFrame:
    """Evidence per family over all folds, seeds and cost scenarios.

    Rows without a seed count for no seed. Stable means at least two seeds, each with a positive upper median delta. Group sizes
    are folds x seeds x costs, a handful of rows.
    """
    delta = F.col("delta_expectancy_vs_champion")
    per_seed = (
        folds.where("seed IS NOT NULL")
        .groupBy(*family, "seed")
        .agg(F.sort_array(F.collect_list(delta)).alias("_d"))
        .withColumn("_upper", F.get("_d", F.floor(F.size("_d") / 2).cast("int")))
        .groupBy(*family)
        .agg(F.count(F.lit(1)).alias("seeds"), F.min("_upper").alias("_worst_seed"))
    )
    n = F.count(F.lit(1))
    base = folds.groupBy(*family).agg(
        F.count_distinct("fold_id").alias("folds"),
        F.median(delta).alias("median_delta_expectancy_vs_champion"),
        F.avg(delta).alias("mean_delta_expectancy_vs_champion"),
        F.min(delta).alias("worst_fold_delta_expectancy_vs_champion"),
        F.count_if(delta > 0).alias("positive_folds"),
        safe_div(F.count_if(delta > 0), n).alias("positive_fold_ratio"),
        F.median("expectancy_net").alias("median_expectancy_net"),
        F.max("max_drawdown").alias("max_drawdown"),
        F.sum("trades").alias("total_trades"),
        F.sort_array(F.collect_set("cost_multiplier")).alias("cost_multipliers"),
    )
    stable = (F.col("seeds") >= 2) & (F.col("_worst_seed") > 0)
    known = base.join(per_seed, list(family), "left").withColumn("seeds", F.coalesce("seeds", F.lit(0)).cast("long"))
    return known.withColumn("stable_across_seeds", F.coalesce(stable, F.lit(False))).drop("_worst_seed")


def research_gate(
    families: DataFrame, min_trades=30, min_positive_folds=4, min_median_delta=0.0, worst_fold=-0.02,
    max_drawdown=0.20, cost_stress=1.5, require_stable=True,
) -> DataFrame:
    """Hard criteria on family evidence: status, pass flag and the failed criteria."""
    failed = failed_criteria(
        [
            ("trades_insuficientes", F.col("total_trades") < min_trades),
            ("folds_positivos_insuficientes", F.col("positive_folds") < min_positive_folds),
            ("nao_supera_champion_mediana", F.col("median_delta_expectancy_vs_champion") <= min_median_delta),
            ("fold_catastrofico", F.col("worst_fold_delta_expectancy_vs_champion") < worst_fold),
            ("drawdown_excessivo", F.col("max_drawdown") > max_drawdown),
            ("stress_custo_ausente", ~F.array_contains("cost_multipliers", cost_stress)),
            ("seeds_instaveis", F.lit(require_stable) & ~F.col("stable_across_seeds")),
        ]
    )
    return families.withColumn("failed_criteria", failed).withColumns(
        {
            "gate_name": F.lit(RESEARCH_GATE),
            "passed": F.size("failed_criteria") == 0,
            "decision_status": F.when(F.size("failed_criteria") == 0, "passed").otherwise("rejected"),
            "gate_engine_version": F.lit(GATE_ENGINE),
        }
    )


def predicted_class() -> Column:
    """Most likely class; the first in class order wins a tie."""
    d, n, u = F.col("prob_down"), F.col("prob_neutral"), F.col("prob_up")
    return F.when((d >= n) & (d >= u), "down").when(n >= u, "neutral").otherwise("up")


def classification_metrics(df: DataFrame, keys: Sequence[str], truth: str = "label_class") -> DataFrame:
    """Coverage, precision, accuracy and the 3x3 confusion counts per key, from pair counts."""
    pairs = df.groupBy(*keys, F.col(truth).alias("_y"), predicted_class().alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )

    def total(pred: Column | None = None) -> Column:
        return F.sum(F.col("_n") if pred is None else F.when(pred, F.col("_n")).otherwise(0))

    y, p = F.col("_y"), F.col("_p")
    moves = p != "neutral"
    out = pairs.groupBy(*keys).agg(
        total().alias("rows_count"),
        total(moves).alias("_moves"),
        total(moves & (y == p)).alias("_hits"),
        total(y == p).alias("_right"),
        *[total((y == a) & (p == b)).alias(f"true_{a}_pred_{b}") for a in LABELS for b in LABELS],
    )
    zero = F.lit(0.0)

    def ratio(a, b) -> Column:
        return F.coalesce(safe_div(a, b), zero)

    out = out.withColumns(
        {
            "coverage": ratio("_moves", "rows_count"),
            "directional_precision": ratio("_hits", "_moves"),
            "accuracy": ratio("_right", "rows_count"),
        }
    )
    for c in LABELS:
        hit = F.col(f"true_{c}_pred_{c}")
        said = sum((F.col(f"true_{a}_pred_{c}") for a in LABELS), F.lit(0))
        real = sum((F.col(f"true_{c}_pred_{b}") for b in LABELS), F.lit(0))
        out = out.withColumns(
            {f"precision_{c}": ratio(hit, said), f"recall_{c}": ratio(hit, real), f"support_{c}": real}
        )
        pr, rc = F.col(f"precision_{c}"), F.col(f"recall_{c}")
        out = out.withColumn(f"f1_{c}", ratio(2 * pr * rc, pr + rc))
    return out.drop("_moves", "_hits", "_right")


def trial_key(protocol: Column, snapshot: Column, family: Column, fold: Column, seed: Column, commit: Column) -> Column:
    """Deterministic trial id: hash of the sorted key fields as JSON."""
    payload = F.to_json(
        F.struct(
            family.alias("candidate_family_hash"), commit.alias("code_commit"), snapshot.alias("dataset_snapshot"),
            fold.alias("fold_id"), protocol.alias("protocol_version"), seed.alias("seed"),
        )
    )
    return F.concat(F.lit("trial_"), F.substring(F.sha2(payload, 256), 1, 32))


def gate_decision_id(protocol: Column, snapshot: Column, family: Column, gate: Column, decided_at: Column) -> Column:
    payload = F.to_json(
        F.struct(
            family.alias("candidate_family_hash"), snapshot.alias("dataset_snapshot"),
            decided_at.cast("string").alias("decided_at"), gate.alias("gate_name"),
            protocol.alias("protocol_version"),
        )
    )
    return F.concat(F.lit("gate_"), F.substring(F.sha2(payload, 256), 1, 32))
