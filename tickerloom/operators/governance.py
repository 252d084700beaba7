"""Registry reads, scoring, promotion gates and champion diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import avg_if, failed_criteria, flag_list, status_chain
from ..functions.frames import first_rows, latest_by, sequence_in_groups, top_n_by, with_one_row
from .evidence import PROTOCOL, research_gate


def nz(c: str | Column, v=0.0) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(v))


# ------------------------------------------------------------------ champion diagnostics


def champion_snapshot_sanity(dataset: DataFrame) -> DataFrame:
    return dataset.agg(
        F.count(F.lit(1)).alias("rows_count"),
        F.count_if("champion_trade_active").alias("champion_active_rows"),
        F.count("champion_net_return").alias("champion_return_rows"),
        F.count_distinct("champion_strategy_id").alias("champion_strategy_ids"),
        F.min("reference_date").alias("min_reference_date"),
        F.max("reference_date").alias("max_reference_date"),
    )


CONTEXT = ["champion_trade_active", "label_class", "volatility_20d", "financial_volume_z20", "volume_ratio_20d",
           "return_5d", "log_return_5d"]


def _with_context(returns: DataFrame, dataset: DataFrame) -> DataFrame:
    return returns.join(dataset.select("ticker", "reference_date", *CONTEXT), ["ticker", "reference_date"], "left")


def champion_overlap(returns: DataFrame, dataset: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often the model traded together with, or against a neutral, champion."""
    on = nz("champion_trade_active", False)
    delta = F.col("delta_net_return")
    return (
        _with_context(returns.where("trades > 0"), dataset)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("traded_daily_rows"),
            F.count_if(on).alias("overlap_champion_active_rows"),
            F.count_if(~on).alias("against_champion_neutral_rows"),
            F.sum("trades").alias("total_trade_markers"),
            F.sum(F.when(on, F.col("trades")).otherwise(0)).alias("trades_when_champion_active"),
            F.sum(F.when(~on, F.col("trades")).otherwise(0)).alias("trades_when_champion_neutral"),
            F.avg(delta).alias("avg_delta"),
            avg_if(on, delta).alias("avg_delta_champion_active"),
            avg_if(~on, delta).alias("avg_delta_champion_neutral"),
            F.min(delta).alias("worst_delta"),
        )
    )


def champion_regime_averages(returns: DataFrame, dataset: DataFrame, keys: Sequence[str]) -> DataFrame:
    state = nz(F.col("champion_trade_active").cast("string"), "missing")
    return (
        _with_context(returns.where("trades > 0"), dataset)
        .groupBy(*keys, state.alias("champion_active"))
        .agg(
            F.count(F.lit(1)).alias("rows_count"),
            F.sum("trades").alias("trades"),
            F.avg("delta_net_return").alias("avg_delta"),
            F.min("delta_net_return").alias("worst_delta"),
            *[F.avg(c).alias(f"avg_{c}") for c in CONTEXT[2:]],
        )
    )


def champion_worst_rows(returns: DataFrame, dataset: DataFrame, limit: int | None = 50) -> DataFrame:
    """The rows with the worst result against the champion; context is joined to these only."""
    ties = [c for c in ("ticker", "family", "seed") if c in returns.columns]
    order = ["delta_net_return", "reference_date", *ties]
    worst = first_rows(returns, order, limit)
    return _with_context(dataset=dataset, returns=worst).orderBy(*order)


# ------------------------------------------------------------------ candidate scores


def candidate_score(df: DataFrame, max_layers: int = 4) -> DataFrame:
    """Leaderboard score of trained candidates, reject reasons and decision.

    Uses train / validation / test accuracy, directional precision, test coverage and
    ``hidden_units``.
    """
    precision, coverage = F.col("test_directional_precision"), F.col("test_coverage")
    overfit = F.greatest(nz("train_accuracy") - nz("test_accuracy"), F.lit(0.0))
    gap = F.least(F.abs(nz("validation_directional_precision") - nz("test_directional_precision")), F.lit(1.0))
    layers = F.coalesce(F.size("hidden_units"), F.lit(0))
    complexity = F.least(layers / max(max_layers, 1), F.lit(1.0)) * 0.05
    total = (
        0.30 * nz("test_directional_precision")
        + 0.20 * nz("validation_directional_precision")
        + 0.15 * nz("test_coverage")
        + 0.15 * nz("test_accuracy")
        + 0.10 * (1 - gap)
        - 0.10 * overfit
        - complexity
    )
    no_test = precision.isNull() & coverage.isNull() & F.col("test_accuracy").isNull()
    reasons = failed_criteria(
        [
            ("test_missing", no_test),
            ("coverage_test_below_minimum", coverage.isNull() | (coverage < 0.05)),
            ("directional_precision_test_below_baseline", precision.isNull() | (precision <= 0.34)),
            ("severe_train_test_overfit", overfit > 0.20),
        ]
    )
    return df.withColumns({"decision_reasons": reasons, "_total": total}).withColumns(
        {
            "score_total": F.round("_total", 6),
            "score_directional_precision": F.round(nz("test_directional_precision"), 6),
            "score_coverage": F.round(nz("test_coverage"), 6),
            "score_generalization": F.round(F.greatest(1 - overfit, F.lit(0.0)), 6),
            "score_stability": F.round(1 - gap, 6),
            "score_cost_penalty": F.round(complexity, 6),
            "decision": status_chain(
                [(F.size("decision_reasons") > 0, "reject"), (F.col("_total") >= 0.45, "shadow_candidate")],
                "keep_candidate",
            ),
        }
    ).drop("_total")


def parameter_count(units: str = "hidden_units", features: int = 30, classes: int = 3) -> Column:
    """Weights and biases of a dense network with these hidden layers."""
    previous = F.slice(F.concat(F.array(F.lit(features)), F.col(units)), 1, F.size(units))
    inner = F.aggregate(F.zip_with(previous, units, lambda p, u: (p + 1) * u), F.lit(0), lambda a, x: a + x)
    last = F.coalesce(F.try_element_at(units, F.lit(-1)), F.lit(features))
    return inner + (last + 1) * classes


def penalized_score(df: DataFrame, max_runtime_minutes: float = 240.0) -> DataFrame:
    """Candidate score minus penalties for parameters and run time."""
    params = F.least(parameter_count() / 150_000, F.lit(1.0)) * 0.05
    runtime = F.least(nz("runtime_minutes") / max(max_runtime_minutes, 1.0), F.lit(1.0)) * 0.05
    return candidate_score(df).withColumns(
        {
            "score_total": F.round(F.col("score_total") - params - runtime, 6),
            "score_cost_penalty": F.round(F.col("score_cost_penalty") + params + runtime, 6),
        }
    )


def ranked_by_score(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Position by score within ``keys``; score bands keep large groups out of one task."""
    band = -F.floor(nz("score_total") * 1000)
    order = [F.desc("score_total"), F.desc("score_directional_precision"), F.desc("score_coverage"), "candidate_id"]
    return sequence_in_groups(df.withColumn("_band", band), keys, "_band", order, out, "_size").drop("_band", "_size")


def diverse_top_candidates(scored: DataFrame, fraction: float = 0.20, per_family: int = 1) -> DataFrame:
    """Best candidates over all, at most ``per_family`` of one family, ``floor(n * fraction)`` in total."""
    order = [F.desc("score_total"), F.desc("score_directional_precision"), F.desc("score_coverage"), F.col("candidate_id")]
    heads = top_n_by(scored, ["candidate_family_hash"], order, max(1, per_family), "_f").drop("_f")
    size = scored.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * fraction)).alias("_k"))
    ranked = ranked_by_score(heads.withColumn("_all", F.lit(1)), ["_all"], "position")
    return with_one_row(ranked, size).where(F.col("position") <= F.col("_k")).drop("_all", "_k")


def evolution_leaderboard(evaluations: DataFrame, configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest evaluation per candidate with its configuration and run, ranked within the run."""
    newest = latest_by(evaluations, ["candidate_id"], [F.desc("created_at")])
    run = latest_by(runs, ["evolution_run_id"], [F.desc("started_at")]).select(
        "evolution_run_id", "strategy", F.col("status").alias("evolution_status")
    )
    joined = newest.join(configs, "candidate_id").join(run, "evolution_run_id", "left")
    return ranked_by_score(joined, ["evolution_run_id"], "rank_in_run")


def leaderboard_parents(leaderboard: DataFrame, limit: int | None) -> DataFrame:
    kept = leaderboard.where("decision <> 'reject'")
    return first_rows(kept, [F.desc("score_total"), F.desc("score_directional_precision"), "candidate_id"], limit)


def evolution_activity(runs: DataFrame, configs: DataFrame, decisions: DataFrame, since) -> DataFrame:
    """Runs per day and strategy with candidate, training and gate counts.

    Gate counts come from the decisions of the run's candidates, else from the run summary.
    """
    gates = (
        configs.select("evolution_run_id", F.lower("dedupe_hash").alias("_h"))
        .distinct()
        .join(decisions.select("decision_id", "passed", F.lower("candidate_family_hash").alias("_h")), "_h")
        .groupBy("evolution_run_id")
        .agg(
            F.count_distinct("decision_id").alias("_gates"),
            F.count_distinct(F.when(F.col("passed"), F.col("decision_id"))).alias("_passed"),
        )
    )

    def summary(name: str) -> Column:
        return F.get_json_object("summary_json", f"$.{name}").try_cast("long")

    done = F.lower("status") == "completed"
    return (
        runs.where(F.col("started_at") >= F.lit(since))
        .join(gates, "evolution_run_id", "left")
        .groupBy(F.to_date("started_at").alias("activity_date"), "strategy")
        .agg(
            F.count(F.lit(1)).alias("runs_count"),
            F.count_if(done).alias("completed_runs_count"),
            F.count_if(~done).alias("failed_runs_count"),
            F.sum(nz(summary("candidate_count"), 0)).alias("candidates_count"),
            F.sum(nz(summary("trained_count"), 0)).alias("trained_count"),
            F.sum(F.coalesce("_gates", summary("gate_decision_count"), F.lit(0))).alias("gate_decisions_count"),
            F.sum(nz("_passed", 0)).alias("approved_gate_decisions_count"),
        )
    )


# ------------------------------------------------------------------ registry reads

# fixed values: words that mark a phase-3 model in its id, version, metrics or notes
PHASE3_WORDS = ("phase3", "phase3_family", "residual_mlp", "wide_deep_mlp", "tabular_bottleneck_mlp")
FAMILY_PATH = "$.muen_economics.candidate_family_hash"


def _status_totals(df: DataFrame) -> list[Column]:
    status = F.lower("status")
    return [
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(status == "candidate").alias("candidate_runs"),
        F.count_if(status == "approved").alias("approved_runs"),
        F.count_if(status.isin("rejected", "reject")).alias("rejected_runs"),
        F.count_if(status.isin("running", "training", "in_progress")).alias("active_training_runs"),
    ]


def training_runs(registry: DataFrame, decisions: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Newest registry rows, each with the totals over the whole registry.

    A decision belongs to a model by version or by the family hash in its metrics: two
    equi joins on distinct keys instead of one OR condition. Totals are one aggregated row.
    """
    keys = decisions.select(F.lower("candidate_family_hash").alias("_k")).distinct()
    text = F.lower(F.concat_ws(" ", *[nz(c, "") for c in ("model_id", "model_version", "metrics_json", "notes")]))
    phase3 = F.lit(False)
    for word in PHASE3_WORDS:
        phase3 = phase3 | text.contains(word)
    by_version = keys.select(F.col("_k").alias("_v"), F.lit(True).alias("_by_version"))
    by_family = keys.select(F.col("_k").alias("_f"), F.lit(True).alias("_by_family"))
    marked = (
        registry.withColumns(
            {
                "_v": F.lower("model_version"),
                "_f": F.lower(F.get_json_object("metrics_json", FAMILY_PATH)),
                "is_phase3": phase3,
            }
        )
        .join(by_version, "_v", "left")
        .join(by_family, "_f", "left")
        .withColumn("has_gate_decision", nz("_by_version", False) | nz("_by_family", False))
        .drop("_v", "_f", "_by_version", "_by_family")
    )
    pending = (F.lower("status") == "candidate") & ~F.col("has_gate_decision")
    totals = marked.agg(
        *_status_totals(marked),
        F.count_if("is_phase3").alias("phase3_runs"),
        F.count_if(pending).alias("pending_gate_candidate_runs"),
    )
    newest = first_rows(marked, [F.desc("trained_at"), F.desc("created_at"), "model_version"], limit)
    return with_one_row(newest, totals)


def champion_latest(registry: DataFrame) -> DataFrame:
    """Newest approved model, with counts over the approved ones."""
    approved = registry.where(F.lower("status") == "approved")
    newest = approved.orderBy(F.desc("trained_at"), F.desc("created_at"), "model_version").limit(1)
    return with_one_row(newest, approved.agg(*_status_totals(approved)))


FAMILY_KEY = ["protocol_version", "dataset_snapshot", "candidate_family_hash"]
FAMILY_FACTS = ["folds", "seeds", "positive_folds", "positive_fold_ratio", "median_delta_expectancy_vs_champion",
                "median_expectancy_net", "max_drawdown", "total_trades", "stable_across_seeds"]


def gate_decisions(decisions: DataFrame, families: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Newest decisions with their family's newest evaluation and the totals."""
    rejected = (F.col("decision_status") == "rejected") | ~F.col("passed")
    passed = (F.col("decision_status") == "passed") | F.col("passed")
    totals = decisions.agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.count_if(rejected).alias("rejected_decisions"),
        F.count_if(passed).alias("passed_decisions"),
    )
    newest = first_rows(decisions, [F.desc("decided_at"), "decision_id"], limit)
    facts = latest_by(families, FAMILY_KEY, [F.desc("created_at")]).select(*FAMILY_KEY, *FAMILY_FACTS)
    shown = newest.withColumn("failed_criteria", F.array_join("failed_criteria", ", "))
    return with_one_row(shown.join(facts, FAMILY_KEY, "left"), totals)


def champion_gate(registry: DataFrame, decisions: DataFrame, families: DataFrame, model_version: str) -> DataFrame:
    """Newest decision on the family of one registered model."""
    row = registry.where(F.col("model_version") == model_version).orderBy(F.desc("created_at")).limit(1)
    family = row.select(F.get_json_object("metrics_json", FAMILY_PATH).alias("candidate_family_hash"))
    mine = decisions.join(F.broadcast(family), "candidate_family_hash", "left_semi")
    return gate_decisions(mine, families, 1)


def predictions_latest(predictions: DataFrame) -> DataFrame:
    keys = ["reference_date", "valid_for", "ticker", "model_id"]
    return latest_by(predictions, keys, [F.desc("created_at"), F.desc("job_run_id")])


def champion_predictions(predictions: DataFrame, model_version: str, limit: int | None = 100) -> DataFrame:
    mine = predictions.where(F.col("model_version") == model_version)
    newest = mine.agg(F.max("reference_date").alias("reference_date"))
    today = mine.join(F.broadcast(newest), "reference_date")
    keys = ["reference_date", "valid_for", "ticker", "model_version"]
    one = latest_by(today, keys, [F.desc("created_at"), F.desc("job_run_id")])
    return first_rows(one, [F.desc("confidence"), "ticker"], limit)


def champion_signals(signals: DataFrame, model_version: str, limit: int | None = 100) -> DataFrame:
    mine = signals.where(F.col("model_version").isin(model_version, f"neural:{model_version}"))
    newest = mine.agg(F.max("reference_date").alias("reference_date"))
    return first_rows(mine.join(F.broadcast(newest), "reference_date"), [F.asc_nulls_last("rank"), F.desc_nulls_last("score"), "ticker"], limit)


def registry_rows(manifests: DataFrame) -> DataFrame:
    """Flat registry columns out of ``metrics_json``: the test split, else validation."""

    def metric(split: str, name: str) -> Column:
        return F.get_json_object("metrics_json", f"$.{split}.{name}")

    tested = F.get_json_object("metrics_json", "$.test").isNotNull()

    def selected(name: str) -> Column:
        return F.when(tested, metric("test", name)).otherwise(metric("validation", name))

    return manifests.withColumns(
        {
            "directional_precision": selected("directional_precision").try_cast("double"),
            "coverage": selected("coverage").try_cast("double"),
            "confusion_matrix_json": selected("confusion_matrix"),
            "validation_accuracy": metric("validation", "accuracy").try_cast("double"),
            "test_accuracy": metric("test", "accuracy").try_cast("double"),
        }
    )


# ------------------------------------------------------------------ gates


def label_drift(train: str | Column, test: str | Column) -> Column:
    """Largest absolute share difference over all labels of two maps; 0 when one is absent."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (train, test))
    labels = F.array_union(F.map_keys(a), F.map_keys(b))
    gaps = F.transform(labels, lambda k: F.abs(nz(F.try_element_at(a, k)) - nz(F.try_element_at(b, k))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_max(gaps)).otherwise(F.lit(0.0))


def shadow_gate(
    df: DataFrame, min_test_accuracy=0.38, min_precision=0.34, min_coverage=0.20, min_test_rows=500,
    max_accuracy_gap=0.20, max_precision_gap=0.12, max_drift=0.15,
) -> DataFrame:
    """Seven criteria before a candidate may run in shadow, and three watch alerts."""
    out = df.withColumns(
        {
            "train_test_accuracy_gap": F.greatest(nz("train_accuracy") - nz("test_accuracy"), F.lit(0.0)),
            "validation_test_precision_gap": F.abs(
                nz("validation_directional_precision") - nz("test_directional_precision")
            ),
            "validation_test_coverage_drop": F.greatest(nz("validation_coverage") - nz("test_coverage"), F.lit(0.0)),
            "label_drift_pct": label_drift("label_distribution_train", "label_distribution_test"),
        }
    )
    failed = failed_criteria(
        [
            ("test_rows", nz("test_rows", 0) < min_test_rows),
            ("test_accuracy", nz("test_accuracy") < min_test_accuracy),
            ("test_directional_precision", nz("test_directional_precision") < min_precision),
            ("test_coverage", nz("test_coverage") < min_coverage),
            ("train_test_accuracy_gap", F.col("train_test_accuracy_gap") > max_accuracy_gap),
            ("validation_test_precision_gap", F.col("validation_test_precision_gap") > max_precision_gap),
            ("label_drift_pct", F.col("label_drift_pct") > max_drift),
        ]
    )
    alerts = failed_criteria(
        [
            ("overfit_watch", F.col("train_test_accuracy_gap") > max_accuracy_gap * 0.75),
            ("coverage_drop_watch", F.col("validation_test_coverage_drop") > 0.10),
            ("label_drift_watch", F.col("label_drift_pct") > max_drift * 0.75),
        ]
    )
    return _gated(out.withColumns({"failed_criteria": failed, "alerts": alerts}), "shadow_candidate", "blocked_for_shadow")


def _gated(df: DataFrame, yes: str, no: str) -> DataFrame:
    ok = F.size("failed_criteria") == 0
    return df.withColumns({"approved": ok, "gate_status": F.when(ok, yes).otherwise(no)})


def _limits(df: DataFrame, checks: list[tuple[str, str, float]]) -> DataFrame:
    """Checks are (metric, '<' | '<=' | '>', limit): the comparison that fails."""

    def fails(c: str, op: str, limit: float) -> Column:
        v = nz(c)
        if op == ">":  # losses and divergences count by size
            return F.abs(v) > limit
        return v < limit if op == "<" else v <= limit

    return df.withColumn("failed_criteria", failed_criteria([(c, fails(c, op, limit)) for c, op, limit in checks]))


#: Published limits of the gates: metric, the comparison that fails, limit. Losses and divergences count by size.
PAPER_LIMITS = {
    "profit_factor": ("<", 1.10), "win_rate": ("<", 0.50), "fill_rate": ("<", 0.40), "max_drawdown_pct": (">", 0.15),
    "trade_count": ("<", 30), "avg_return_pct": ("<=", 0.0), "cost_sensitivity_pct": (">", 0.25),
}
PROMOTION_LIMITS = {
    "oos_profit_factor": ("<", 1.15), "oos_win_rate": ("<", 0.52), "paper_profit_factor": ("<", 1.10), "paper_win_rate": ("<", 0.50),
    "paper_days": ("<", 120), "paper_trades": ("<", 50), "paper_max_drawdown_pct": (">", 0.12), "fill_rate": ("<", 0.40),
    "avg_abs_backtest_divergence_pct": (">", 0.05),
}


def _checks(published: dict[str, tuple[str, float]], own: Mapping[str, float]) -> list[tuple[str, str, float]]:
    unknown = set(own) - set(published)
    if unknown:
        raise ValueError(f"no such limits: {sorted(unknown)}")
    return [(name, op, own.get(name, limit)) for name, (op, limit) in published.items()]


def _either(df: DataFrame, name: str, other: str) -> DataFrame:
    """``name``, or ``other`` where it is missing or zero; a missing metric is zero."""
    found = [F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in (name, other) if c in df.columns]
    return df.withColumn(name, F.coalesce(*found, F.lit(0.0)))


def _with_metrics(df: DataFrame, published: dict) -> DataFrame:
    return df.withColumns({c: F.lit(0.0) for c in published if c not in df.columns})


def paper_gate(df: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    """Seven criteria on back-test metrics before paper trading; ``limits`` replace published ones by name.

    The number of trades is ``trade_count``, or ``trades`` where that is missing or zero; other missing metrics are zero.
    """
    df = _with_metrics(_either(df, "trade_count", "trades"), PAPER_LIMITS)
    return _gated(_limits(df, _checks(PAPER_LIMITS, limits or {})), "approved_for_paper", "blocked_for_paper")


def promotion_gate(df: DataFrame, min_approvals: int = 1, limits: Mapping[str, float] | None = None, require_approval: bool = True) -> DataFrame:
    """Ten criteria before controlled promotion; never more than a hybrid source with fallback.

    ``approvals`` is an array of approver names, ``limits`` replace published ones by name. The number of trades is
    ``paper_trades``, or ``trade_count`` where that is missing or zero.
    """
    df = _with_metrics(_either(df, "paper_trades", "trade_count"), PROMOTION_LIMITS)
    named = F.filter(F.coalesce("approvals", F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    approval = [("explicit_approval", "<", min_approvals)] if require_approval else []
    out = _limits(df.withColumn("explicit_approval", F.size(named)), _checks(PROMOTION_LIMITS, limits or {}) + approval)
    return _gated(out, "approved_for_controlled_promotion", "blocked_for_promotion").withColumns(
        {
            "effective_signal_source": F.when(F.col("approved"), "hybrid").otherwise("heuristic"),
            "fallback_signal_source": F.lit("heuristic"),
        }
    )


def _with_criteria(rows: DataFrame, criteria: DataFrame) -> DataFrame:
    active = latest_by(criteria.where("status = 'active'"), ["criteria_id"], [F.desc("updated_at")])
    return rows.join(F.broadcast(active.drop("status", "updated_at")), ["criteria_id", "criteria_version"])


def paper_gate_view(evaluations: DataFrame, criteria: DataFrame) -> DataFrame:
    """Newest evaluation per model version under its active criteria."""
    order = [F.desc("evaluation_date"), F.desc("created_at")]
    newest = latest_by(evaluations, ["model_id", "model_version"], order)
    status = F.when(F.col("approved_for_paper"), "liberado_paper").otherwise("bloqueado_backtest")
    return _with_criteria(newest, criteria).withColumn("paper_gate_status", status)


def promotion_gate_view(decisions: DataFrame, criteria: DataFrame) -> DataFrame:
    """Newest promotion decision per model version and the signal source that is safe to use."""
    order = [F.desc("promotion_date"), F.desc("created_at")]
    newest = latest_by(decisions, ["model_id", "model_version"], order)
    ok = F.col("promotion_status") == "approved_for_controlled_promotion"
    source = F.when(ok, F.col("promotion_signal_source")).otherwise(F.col("configured_fallback_signal_source"))
    return _with_criteria(newest, criteria).withColumn("safe_signal_source", source)


def active_promotion(decisions: DataFrame) -> DataFrame:
    ok = decisions.where("promotion_status = 'approved_for_controlled_promotion'")
    return latest_by(ok, ["model_id"], [F.desc("promotion_date"), F.desc("created_at")])


def champion_approval_checks(requests: DataFrame, registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approval plan per request: failed checks, warnings and whether an update is allowed."""
    reg = registry.select(F.col("model_version"), F.col("status").alias("current_status"), F.lit(True).alias("_reg"))
    gate = decisions.select(
        "decision_id", "gate_name", "decision_status", "passed",
        F.coalesce("failed_criteria", F.array().cast("array<string>")).alias("_criteria"),
        "candidate_family_hash", "protocol_version", "dataset_snapshot", F.lit(True).alias("_gate"),
    )
    joined = requests.join(reg, "model_version", "left").join(gate, "decision_id", "left")
    has_reg, has_gate = nz("_reg", False), nz("_gate", False)

    def blank(c: str) -> Column:
        return F.trim(nz(c, "")) == ""

    status = nz("current_status", "")
    checks = [(f"{c}_obrigatorio", blank(c)) for c in ("model_version", "decision_id", "approved_by", "approval_ticket")]
    checks += [
        ("registry_modelo_nao_encontrado", ~has_reg),
        ("registry_status_invalido_para_aprovacao", has_reg & ~status.isin("candidate", "approved")),
        ("gate_decision_nao_encontrada", ~has_gate),
        ("gate_name_invalido", has_gate & (nz("gate_name", "") != "research_walk_forward")),
        ("gate_status_nao_passou", has_gate & (nz("decision_status", "") != "passed")),
        ("gate_passed_false", has_gate & ~nz("passed", False)),
        ("gate_failed_criteria_presentes", has_gate & (F.size("_criteria") > 0)),
        ("muen_economics_missing", has_gate & F.array_contains("_criteria", "muen_economics_missing")),
    ]
    checks += [(f"{c}_ausente", has_gate & blank(c)) for c in FAMILY_KEY[::-1][:1] + FAMILY_KEY[:2]]
    approved_before = status == "approved"
    return joined.withColumn("failed_checks", failed_criteria(checks)).withColumns(
        {
            "approved": F.size("failed_checks") == 0,
            "already_approved": approved_before,
            "warnings": failed_criteria([("modelo_ja_aprovado", approved_before)]),
            "update_allowed": (F.size("failed_checks") == 0) & ~approved_before,
        }
    )


def approve_registry(registry: DataFrame, plans: DataFrame) -> DataFrame:
    """Registry with allowed approvals applied; only rows still ``candidate`` change."""
    notes = plans.where("update_allowed").select("model_version", F.col("approval_note").alias("_note"))
    hit = F.col("_note").isNotNull() & (F.col("status") == "candidate")
    return (
        registry.join(notes, "model_version", "left")
        .withColumns(
            {
                "notes": F.when(hit, F.concat_ws("\n", "notes", "_note")).otherwise(F.col("notes")),
                "status": F.when(hit, "approved").otherwise(F.col("status")),
            }
        )
        .drop("_note")
    )


def champion_audit(registry: DataFrame) -> DataFrame:
    """Snapshot / feature / label groups with more than one approved model."""
    group = ["training_dataset_snapshot", "feature_version", "label_version"]
    approved = registry.where("status = 'approved'")
    dup = approved.groupBy(*group).agg(
        F.count(F.lit(1)).alias("champions"), F.min("model_version").alias("first_model"),
        F.max("model_version").alias("last_model"),
    )
    return dup.where("champions > 1").withColumn(
        "warning", F.concat(F.lit("champions_duplicados:"), F.concat_ws(":", *group))
    )


def advisor_vs_control(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best advisor and control score per group and who won."""
    mine = F.col("origin") == "advisor"
    out = scores.groupBy(*keys).agg(
        F.count_if(mine).alias("advisor_count"),
        F.count_if(~mine).alias("control_count"),
        F.max(F.when(mine, F.col("score"))).alias("advisor_best_score"),
        F.max(F.when(~mine, F.col("score"))).alias("control_best_score"),
    )
    a, c = F.col("advisor_best_score"), F.col("control_best_score")
    return out.withColumns(
        {
            "advisor_won": nz(a > c, False),
            "summary": status_chain(
                [
                    (a.isNull(), "advisor_without_accepted_candidates"),
                    (c.isNull(), "control_without_candidates"),
                    (a > c, "advisor_outperformed_control"),
                ],
                "control_matched_or_outperformed_advisor",
            ),
        }
    )


# ------------------------------------------------------------------ fold evidence in the registry


def candidate_family_key(architecture: Column, hyper: Column) -> Column:
    """Stable family hash: architecture and training knobs without the random seed."""
    kept = F.map_filter(F.from_json(hyper, "map<string,string>"), lambda k, v: k != "random_seed")
    entries = F.array_sort(F.map_entries(kept))
    arch = F.array_sort(F.map_entries(F.from_json(architecture, "map<string,string>")))
    return F.sha2(F.concat_ws("|", F.to_json(arch), F.to_json(entries)), 256)


def legacy_fold_rekey(folds: DataFrame, configs: DataFrame, targets: DataFrame, prefix: str) -> DataFrame:
    """Old folds keyed by model version, re-keyed by the family of their configuration."""
    family = F.concat(F.lit(prefix), F.substring(candidate_family_key(F.col("architecture_json"), F.col("hyperparameters_json")), 1, 24))
    known = configs.select(F.col("model_version").alias("candidate_family_hash"), family.alias("_family"))
    rekeyed = folds.join(known, "candidate_family_hash").withColumn("candidate_family_hash", F.col("_family"))
    return rekeyed.drop("_family").join(targets, "candidate_family_hash", "left_semi")


def merge_fold_rows(*groups: DataFrame) -> DataFrame:
    """Fold rows of all groups, one per trial; later groups win. A row without a trial id stands for itself.

    Rows are dealt out before the first sort: a scan's task, which turns a few models into many folds, sorts nothing, and
    the rows of one trial are still reduced in several tasks.
    """
    merged = None
    for i, g in enumerate(groups):
        part = g.withColumn("_priority", F.lit(i))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    own = F.sha2(F.to_json(F.struct(*[c for c in merged.columns if c != "_priority"])), 256)
    named = F.nullif(F.col("trial_id").cast("string"), F.lit(""))
    merged = merged.withColumns({"_row": own, "_key": F.coalesce(F.concat(F.lit("id:"), named), F.concat(F.lit("row:"), own))})
    merged = merged.repartition("_key", "_row")
    return latest_by(merged, ["_key"], [F.desc("_priority"), F.col("_row")]).drop("_priority", "_row", "_key")


FOLD_SCHEMA = "struct<fold_id:string,trial_id:string,seed:long,trades:long,expectancy_net:double,max_drawdown:double,delta_expectancy_vs_champion:double,cost_multiplier:double>"
FAMILY_SCHEMA = "struct<folds:long,seeds:long,median_delta_expectancy_vs_champion:double,mean_delta_expectancy_vs_champion:double,worst_fold_delta_expectancy_vs_champion:double,positive_folds:long,median_expectancy_net:double,max_drawdown:double,total_trades:long,stable_across_seeds:boolean,cost_multipliers:array<double>>"
DAILY_SCHEMA = "struct<protocol_version:string,dataset_snapshot:string,candidate_family_hash:string,trial_id:string,fold_id:string,seed:long,reference_date:string,ticker:string,model_net_return:double,champion_net_return:double,delta_net_return:double,exposure:double,trades:long>"
ECONOMICS_SCHEMA = f"struct<protocol_version:string,dataset_snapshot:string,candidate_family_hash:string,seed:long,seed_count:long,fold_metrics:array<{FOLD_SCHEMA}>,family_evaluation:{FAMILY_SCHEMA},daily_returns:array<{DAILY_SCHEMA}>>"


def registry_economics(registry: DataFrame) -> DataFrame:
    """Economics of each model with protocol, snapshot and family defaults filled in."""
    text = F.get_json_object("metrics_json", "$.muen_economics")
    rows = registry.withColumns({"_e": F.from_json(text, ECONOMICS_SCHEMA), "_keys": F.json_object_keys(text)})
    return rows.select(
        "model_version",
        nz(F.size("_keys") > 0, False).alias("has_economics"),
        nz("_e.protocol_version", PROTOCOL).alias("protocol_version"),
        F.coalesce("_e.dataset_snapshot", "training_dataset_snapshot").alias("dataset_snapshot"),
        F.coalesce("_e.candidate_family_hash", "model_version").alias("candidate_family_hash"),
        nz("_e.seed_count", 1).alias("seed_count"),
        F.col("_e.seed").alias("_seed"),
        F.col("_e.fold_metrics").alias("fold_metrics"),
        F.col("_e.family_evaluation").alias("family_evaluation"),
        F.col("_e.daily_returns").alias("daily_returns"),
    )


def _has_folds() -> Column:
    return nz(F.size("fold_metrics") > 0, False)


def registry_daily_returns(registry: DataFrame) -> DataFrame:
    """One row per daily return found in the registry, for models that have folds.

    Protocol, snapshot and family are filled in as for the folds; empty entries are left out.
    """
    base = registry_economics(registry).where(_has_folds())
    rows = base.select(
        "model_version", *[F.col(c).alias(f"_{c}") for c in ("protocol_version", "dataset_snapshot", "candidate_family_hash")],
        F.inline(F.filter("daily_returns", _not_empty)),
    )
    filled = {c: F.coalesce(c, f"_{c}") for c in ("protocol_version", "dataset_snapshot", "candidate_family_hash")}
    return rows.withColumns(filled | {"reference_date": F.col("reference_date").try_cast("date")}).drop(*[f"_{c}" for c in filled])


def _not_empty(entry: Column) -> Column:
    return F.to_json(entry) != "{}"


def registry_rejects(registry: DataFrame) -> DataFrame:
    """What is missing in the registry's evidence: rows (model_version, level, position, reason).

    Levels are ``model`` (no economics, or economics without folds), ``fold`` (no fold id, no trades) and
    ``daily_return`` (empty entry, no readable date). Positions count from 1; they are 0 for a model.
    """
    base = registry_economics(registry)
    model = F.when(~F.col("has_economics"), "muen_economics_missing").when(~_has_folds(), "fold_metrics_missing")
    of_fold = lambda f: flag_list([("fold_id_missing", f["fold_id"].isNull()), ("trades_missing", f["trades"].isNull())])
    of_day = lambda d: F.when(~_not_empty(d), F.array(F.lit("daily_return_empty"))).otherwise(
        flag_list([("reference_date_missing", d["reference_date"].try_cast("date").isNull())])
    )
    levels = [base.select("model_version", F.lit("model").alias("level"), F.lit(0).alias("position"), model.alias("reason")).where("reason IS NOT NULL")]
    for level, column, reasons in (("fold", "fold_metrics", of_fold), ("daily_return", "daily_returns", of_day)):
        each = base.select("model_version", F.lit(level).alias("level"), F.posexplode(F.transform(column, reasons)).alias("_at", "_reasons"))
        levels.append(each.select("model_version", "level", (F.col("_at") + 1).alias("position"), F.explode("_reasons").alias("reason")))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def _stored_family() -> Column:
    """A stored family evaluation with its gaps filled."""
    m = "family_evaluation"
    zeros = ["median_delta_expectancy_vs_champion", "mean_delta_expectancy_vs_champion", "worst_fold_delta_expectancy_vs_champion", "median_expectancy_net", "max_drawdown"]
    parts = {c: nz(f"{m}.{c}", 0) for c in ("folds", "positive_folds", "total_trades")} | {c: nz(f"{m}.{c}") for c in zeros}
    parts |= {"seeds": nz(f"{m}.seeds", 1), "stable_across_seeds": nz(f"{m}.stable_across_seeds", False)}
    parts |= {"cost_multipliers": F.coalesce(f"{m}.cost_multipliers", F.array().cast("array<double>"))}
    order = [f.partition(":")[0] for f in FAMILY_SCHEMA[7:-1].split(",")]
    return F.when(F.col(m).isNotNull(), F.struct(*[parts[c].alias(c) for c in order]).cast(FAMILY_SCHEMA))


def registry_fold_metrics(registry: DataFrame) -> DataFrame:
    """One row per fold found in the registry, with a trial id."""
    folds = registry_economics(registry).select(
        "model_version", "protocol_version", "dataset_snapshot", "candidate_family_hash", "_seed",
        F.posexplode("fold_metrics").alias("_i", "f"),
    )
    cost = nz("f.cost_multiplier", 1.0)
    default_trial = F.concat_ws("_", "model_version", "f.fold_id", (F.col("_i") + 1).cast("string"),
                                F.replace(cost.cast("string"), F.lit("."), F.lit("_")))
    return folds.select(
        "model_version", "protocol_version", "dataset_snapshot", "candidate_family_hash",
        F.coalesce("f.trial_id", default_trial).alias("trial_id"),
        F.col("f.fold_id").alias("fold_id"),
        F.coalesce("f.seed", "_seed", F.lit(0)).alias("seed"),
        *[nz(f"f.{c}", 0 if c == "trades" else 0.0).alias(c)
          for c in ("trades", "expectancy_net", "max_drawdown", "delta_expectancy_vs_champion")],
        cost.alias("cost_multiplier"),
    )


def evaluate_candidate_evidence(registry: DataFrame) -> DataFrame:
    """Research gate on the evidence stored in the registry.

    A stored family evaluation is used, its gaps filled, otherwise it is built from the folds.
    Models without economics and those without folds are blocked, each with its reason. Folds of a model are a handful, so array
    functions on the row do the aggregation without a shuffle.
    """
    base = registry_economics(registry)
    folds = F.col("fold_metrics")

    def values(name: str) -> Column:
        return F.array_sort(F.transform(folds, lambda f: nz(f[name])))

    def median(a: Column) -> Column:
        n = F.size(a)
        return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2

    deltas, n = values("delta_expectancy_vs_champion"), F.size(folds)
    total = F.aggregate(folds, F.lit(0).cast("long"), lambda a, f: a + nz(f["trades"], 0))
    mean = F.aggregate(deltas, F.lit(0.0), lambda a, x: a + x) / n
    built = F.struct(
        F.size(F.array_distinct(F.transform(folds, lambda f: f["fold_id"]))).cast("long").alias("folds"),
        F.col("seed_count").alias("seeds"),
        median(deltas).alias("median_delta_expectancy_vs_champion"),
        mean.alias("mean_delta_expectancy_vs_champion"),
        F.array_min(deltas).alias("worst_fold_delta_expectancy_vs_champion"),
        F.size(F.filter(deltas, lambda d: d > 0)).cast("long").alias("positive_folds"),
        median(values("expectancy_net")).alias("median_expectancy_net"),
        F.array_max(values("max_drawdown")).alias("max_drawdown"),
        total.alias("total_trades"),
        ((F.col("seed_count") > 1) | (n == 1)).alias("stable_across_seeds"),
        F.array_sort(F.array_distinct(F.transform(folds, lambda f: nz(f["cost_multiplier"], 1.0)))).alias("cost_multipliers"),
    )
    found = _has_folds()
    family = F.when(found, F.coalesce(_stored_family(), built.cast(FAMILY_SCHEMA)))
    out = base.select("model_version", "protocol_version", "dataset_snapshot", "candidate_family_hash",
                      "has_economics", found.alias("_found"), family.alias("_m"))
    gated = research_gate(out.select("*", "_m.*").drop("_m"))
    return gated.withColumns(
        {
            "failed_criteria": F.when(F.col("_found"), F.col("failed_criteria"))
            .when(F.col("has_economics"), F.array(F.lit("fold_metrics_missing")))
            .otherwise(F.array(F.lit("muen_economics_missing"))),
            "decision_status": F.when(F.col("_found"), F.col("decision_status")).otherwise("blocked"),
            "passed": F.col("_found") & F.col("passed"),
        }
    ).drop("_found", "has_economics")
