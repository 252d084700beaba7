"""Queries over model registry, scores, gates and stored evidence, derived from the part table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import governance as gv
from .registry import cte, query
from .shared import shared
from .signal_queries import eod_signals, predictions
from .tables import Tables


def pct(mult: int, mod: int, base: int = 0) -> str:
    return f"CAST({base} + p_partkey * {mult} % {mod} AS DOUBLE) / CAST(100 AS DOUBLE)"


def named(prefix: str, value: str) -> str:
    return f"concat('{prefix}', CAST({value} AS STRING))"


# the same expressions run in Spark and in DuckDB
MODEL = {
    "k": "p_partkey",
    "candidate_id": named("c", "p_partkey"),
    "evolution_run_id": named("run", "p_partkey % 25"),
    "model_id": named("model", "p_partkey % 9"),
    "model_version": named("m", "p_partkey"),
    "candidate_family_hash": named("fam", "p_partkey % 60"),
    "dedupe_hash": named("FAM", "p_partkey % 60"),
    "status": "CASE p_partkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'candidate' WHEN 2 THEN 'candidate' WHEN 3 THEN 'rejected' ELSE 'training' END",
    "training_dataset_snapshot": named("snap", "p_partkey % 40"),
    "feature_version": named("f", "p_partkey % 3"),
    "label_version": named("l", "p_partkey % 2"),
    "train_accuracy": pct(7, 50, 40),
    "validation_accuracy": pct(11, 40, 30),
    "test_accuracy": pct(13, 40, 30),
    "validation_directional_precision": pct(17, 40, 25),
    "test_directional_precision": pct(19, 40, 25),
    "validation_coverage": pct(23, 60),
    "test_coverage": pct(29, 60),
    "test_rows": "200 + p_partkey * 31 % 900",
    "train_up": pct(3, 40, 30),
    "test_up": pct(5, 40, 30),
    "layers": "1 + p_partkey % 4",
    "runtime_minutes": "p_partkey % 300",
    "minute": "p_partkey * 13 % 1000",
}
cte("models", "SELECT " + ", ".join(f"{v} AS {k}" for k, v in MODEL.items())
    + ", TIMESTAMP '2024-01-01' + to_minutes(p_partkey * 13 % 1000) AS created_at FROM part")


def at_minute(c):
    return F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col(c))


@shared
def models(t: Tables):
    rows = t.read("part").select(*[F.expr(v).alias(k) for k, v in MODEL.items()])
    sizes = F.array(*[F.lit(n) for n in (64, 32, 16, 8)])
    return rows.withColumns(
        {
            "created_at": at_minute("minute"),
            "trained_at": at_minute("minute"),
            "hidden_units": F.slice(sizes, 1, F.col("layers").cast("int")),
            "notes": F.when(F.col("k") % 6 == 0, "Phase3 residual_mlp run"),
        }
    )


OVERFIT = "greatest(train_accuracy - test_accuracy, 0)"
GAP = "least(abs(validation_directional_precision - test_directional_precision), 1)"
cte(
    "scored",
    f"""
    SELECT *, CASE WHEN len(decision_reasons) > 0 THEN 'reject' WHEN raw >= 0.45 THEN 'shadow_candidate'
                   ELSE 'keep_candidate' END AS decision
    FROM (
        SELECT *, raw AS score_total, test_directional_precision AS score_directional_precision,
               test_coverage AS score_coverage, 1 - {OVERFIT} AS score_generalization, 1 - {GAP} AS score_stability,
               layers / 4.0::DOUBLE * 0.05 AS score_cost_penalty,
               list_filter([CASE WHEN test_coverage < 0.05 THEN 'coverage_test_below_minimum' END,
                   CASE WHEN test_directional_precision <= 0.34 THEN 'directional_precision_test_below_baseline' END,
                   CASE WHEN {OVERFIT} > 0.2 THEN 'severe_train_test_overfit' END], lambda x: x IS NOT NULL)
                   AS decision_reasons
        FROM (SELECT *, round(0.3 * test_directional_precision + 0.2 * validation_directional_precision
                     + 0.15 * test_coverage + 0.15 * test_accuracy + 0.1 * (1 - {GAP}) - 0.1 * {OVERFIT}
                     - layers / 4.0::DOUBLE * 0.05, 6) AS raw FROM models)
    )
    """,
    "models",
)


@shared
def scored(t: Tables):
    return gv.candidate_score(models(t))


SCORE = """candidate_id score_total:d score_directional_precision:d score_coverage:d score_generalization:d
           score_stability:d score_cost_penalty:d decision decision_reasons:a"""


@query("candidate_score", SCORE, "SELECT * FROM scored", "scored")
def _score(t: Tables):
    return scored(t)


_params = "(31 * 64 + CASE WHEN layers > 1 THEN 65 * 32 ELSE 0 END + CASE WHEN layers > 2 THEN 33 * 16 ELSE 0 END + CASE WHEN layers > 3 THEN 17 * 8 ELSE 0 END + (CASE layers WHEN 1 THEN 64 WHEN 2 THEN 32 WHEN 3 THEN 16 ELSE 8 END + 1) * 3)"
_penalty = f"(least({_params} / 150000.0::DOUBLE, 1) * 0.05 + least(runtime_minutes / 240.0::DOUBLE, 1) * 0.05)"


@query(
    "penalized_score",
    "candidate_id score_total:d score_cost_penalty:d",
    f"""SELECT candidate_id, round(score_total - {_penalty}, 6) AS score_total,
               round(score_cost_penalty + {_penalty}, 6) AS score_cost_penalty FROM scored""",
    "scored",
)
def _penalized(t: Tables):
    return gv.penalized_score(models(t))


BEST = "score_total DESC, score_directional_precision DESC, score_coverage DESC, candidate_id"


@query(
    "diverse_top_candidates",
    "candidate_id candidate_family_hash score_total:d position:n",
    f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {BEST}) AS position
                       FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY candidate_family_hash
                                                                             ORDER BY {BEST}) <= 2))
        WHERE position <= (SELECT floor(count(*) * 0.05) FROM scored)""",
    "scored",
)
def _diverse(t: Tables):
    return gv.diverse_top_candidates(scored(t), 0.05, 2)


# every fourth candidate was evaluated twice; the later evaluation scores a bit higher
cte(
    "board",
    f"""
    SELECT *, row_number() OVER (PARTITION BY evolution_run_id ORDER BY {BEST}) AS rank_in_run
    FROM (SELECT s.* EXCLUDE (score_total), score_total + CASE WHEN k % 4 = 0 THEN 0.01 ELSE 0 END AS score_total,
                 r.strategy, r.evolution_status
          FROM scored AS s LEFT JOIN (SELECT 'run' || CAST(n_nationkey AS VARCHAR) AS evolution_run_id,
                                             'strategy' || CAST(n_regionkey AS VARCHAR) AS strategy,
                                             CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'completed' END
                                                 AS evolution_status
                                      FROM nation) AS r USING (evolution_run_id))
    """,
    "scored",
)


@shared
def evolution_runs(t: Tables):
    k = F.col("n_nationkey")
    rows = t.read("nation").select(
        F.concat(F.lit("run"), k.cast("string")).alias("evolution_run_id"),
        F.concat(F.lit("strategy"), F.col("n_regionkey").cast("string")).alias("strategy"),
        F.explode(F.array(F.lit("running"), F.when(k % 4 == 0, "failed").otherwise("completed"))).alias("status"),
        k.alias("k"),
    )
    late = F.when(F.col("status") == "running", 0).otherwise(30)
    return rows.withColumns(
        {
            "started_at": F.lit("2024-02-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("k") % 6, mins=late),
            "summary_json": F.to_json(
                F.struct(
                    (F.col("k") + 3).alias("candidate_count"),
                    F.when(F.col("k") % 3 != 0, F.col("k") + 1).alias("trained_count"),
                    F.lit(2).alias("gate_decision_count"),
                )
            ),
        }
    )


@shared
def leaderboard(t: Tables):
    base = scored(t)
    cols = ["candidate_id", "score_total", "score_directional_precision", "score_coverage", "decision", "created_at"]
    again = base.where("k % 4 = 0").withColumns(
        {"score_total": F.col("score_total") + 0.01, "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")}
    )
    evaluations = base.select(*cols).unionByName(again.select(*cols))
    configs = base.select("candidate_id", "evolution_run_id", "model_id", "model_version", "candidate_family_hash")
    return gv.evolution_leaderboard(evaluations, configs, evolution_runs(t))


BOARD = "candidate_id evolution_run_id strategy evolution_status model_version score_total:d decision rank_in_run:n"


@query("evolution_leaderboard", BOARD, "SELECT * FROM board", "board")
def _board(t: Tables):
    return leaderboard(t)


@query(
    "leaderboard_parents",
    BOARD,
    "SELECT * FROM board WHERE decision <> 'reject' ORDER BY score_total DESC, score_directional_precision DESC, candidate_id LIMIT 25",
    "board",
)
def _parents(t: Tables):
    return gv.leaderboard_parents(leaderboard(t), 25)


cte(
    "decisions",
    """
    SELECT 'gate_' || CAST(k AS VARCHAR) AS decision_id, 'neural_eod_protocol_v1' AS protocol_version,
           training_dataset_snapshot AS dataset_snapshot,
           CASE WHEN k % 4 = 0 THEN 'fam' || CAST(k % 45 AS VARCHAR) ELSE model_version END AS candidate_family_hash,
           CASE WHEN k % 17 = 0 THEN 'holdout' ELSE 'research_walk_forward' END AS gate_name, k % 6 = 0 AS passed,
           CASE WHEN k % 6 = 0 THEN 'passed' ELSE 'rejected' END AS decision_status,
           CASE WHEN k % 6 = 0 THEN [] ELSE ['trades_insuficientes', 'seeds_instaveis'] END AS failed_criteria,
           created_at AS decided_at, k
    FROM models
    """,
    "models",
)


@shared
def decisions(t: Tables):
    k = F.col("k")
    family = F.when(k % 4 == 0, F.concat(F.lit("fam"), (k % 45).cast("string"))).otherwise(F.col("model_version"))
    none = F.array().cast("array<string>")
    return models(t).select(
        F.concat(F.lit("gate_"), k.cast("string")).alias("decision_id"),
        F.lit("neural_eod_protocol_v1").alias("protocol_version"),
        F.col("training_dataset_snapshot").alias("dataset_snapshot"),
        family.alias("candidate_family_hash"),
        F.when(k % 17 == 0, "holdout").otherwise("research_walk_forward").alias("gate_name"),
        (k % 6 == 0).alias("passed"),
        F.when(k % 6 == 0, "passed").otherwise("rejected").alias("decision_status"),
        F.when(k % 6 == 0, none)
        .otherwise(F.array(F.lit("trades_insuficientes"), F.lit("seeds_instaveis")))
        .alias("failed_criteria"),
        F.col("created_at").alias("decided_at"),
    )


@query(
    "evolution_activity",
    """activity_date strategy runs_count:n completed_runs_count:n failed_runs_count:n candidates_count:n
       trained_count:n gate_decisions_count:n approved_gate_decisions_count:n""",
    """
    SELECT activity_date, strategy, count(*) AS runs_count, count(*) FILTER (WHERE status = 'completed')
               AS completed_runs_count, count(*) FILTER (WHERE status <> 'completed') AS failed_runs_count,
           sum(k + 3) AS candidates_count, sum(CASE WHEN k % 3 <> 0 THEN k + 1 ELSE 0 END) AS trained_count,
           sum(coalesce(g, 2)) AS gate_decisions_count, sum(coalesce(p, 0)) AS approved_gate_decisions_count
    FROM (SELECT 'run' || CAST(n_nationkey AS VARCHAR) AS evolution_run_id, n_nationkey AS k, status,
                 'strategy' || CAST(n_regionkey AS VARCHAR) AS strategy,
                 DATE '2024-02-01' + CAST(n_nationkey % 6 AS INTEGER) AS activity_date
          FROM nation, LATERAL (SELECT unnest(['running', CASE WHEN n_nationkey % 4 = 0 THEN 'failed'
                                                               ELSE 'completed' END]) AS status) AS s) AS r
    LEFT JOIN (SELECT evolution_run_id, count(DISTINCT decision_id) AS g,
                      count(DISTINCT CASE WHEN passed THEN decision_id END) AS p
               FROM models AS m JOIN decisions AS d ON lower(d.candidate_family_hash) = lower(m.dedupe_hash)
               GROUP BY 1) AS x USING (evolution_run_id)
    WHERE activity_date >= DATE '2024-02-02' GROUP BY 1, 2
    """,
    "models decisions",
)
def _activity(t: Tables):
    return gv.evolution_activity(evolution_runs(t), models(t), decisions(t), dt.datetime(2024, 2, 2))


@shared
def registry(t: Tables):
    """Registry rows; metrics as JSON, economics for three of four models."""
    k = F.col("k")

    def fold(i: int):
        return F.struct(
            F.lit(f"fold_{i}").alias("fold_id"),
            ((k + i) % 25).alias("trades"),
            ((k * (i + 2) % 21 - 8) / 1000).alias("expectancy_net"),
            ((k * i % 30) / 100).alias("max_drawdown"),
            ((k * (i + 3) % 23 - 7) / 1000).alias("delta_expectancy_vs_champion"),
            F.when(k % 7 != 0, F.lit(1.0 if i % 2 else 1.5)).alias("cost_multiplier"),
        )

    economics = F.struct(
        F.when(k % 5 != 0, F.col("candidate_family_hash")).alias("candidate_family_hash"),
        F.when(k % 3 != 0, (1 + k % 2)).alias("seed_count"),
        F.lit(11).alias("seed"),
        F.array(*[fold(i) for i in range(1, 6)]).alias("fold_metrics"),
    )

    def split(name: str):
        return F.struct(
            F.col(f"{name}_accuracy").alias("accuracy"),
            F.col(f"{name}_directional_precision").alias("directional_precision"),
            F.col(f"{name}_coverage").alias("coverage"),
        )

    metrics = F.struct(
        split("validation").alias("validation"),
        F.when(k % 8 != 0, split("test")).alias("test"),
        F.when(k % 4 != 3, economics).alias("muen_economics"),
    )
    return models(t).withColumn("metrics_json", F.to_json(metrics))


cte(
    "registry_sql",
    """SELECT *, created_at AS trained_at, CASE WHEN k % 4 <> 3 AND k % 5 <> 0 THEN candidate_family_hash END AS json_family,
              CASE WHEN k % 6 = 0 THEN 'Phase3 residual_mlp run' END AS notes FROM models""",
    "models",
)


@query(
    "registry_rows",
    "model_version directional_precision:d coverage:d validation_accuracy:d test_accuracy:d",
    """SELECT model_version, CASE WHEN k % 8 <> 0 THEN test_directional_precision ELSE validation_directional_precision
                             END AS directional_precision,
              CASE WHEN k % 8 <> 0 THEN test_coverage ELSE validation_coverage END AS coverage, validation_accuracy,
              CASE WHEN k % 8 <> 0 THEN test_accuracy END AS test_accuracy FROM models""",
    "models",
)
def _registry_rows(t: Tables):
    raw = registry(t).select("model_version", "metrics_json")
    return gv.registry_rows(raw)


cte(
    "registry_marked",
    """SELECT r.*, lower(model_version) IN (SELECT lower(candidate_family_hash) FROM decisions)
              OR coalesce(lower(json_family) IN (SELECT lower(candidate_family_hash) FROM decisions), FALSE)
              AS has_gate_decision FROM registry_sql AS r""",
    "registry_sql decisions",
)


@query(
    "training_runs",
    """model_version status has_gate_decision:b total_runs:n candidate_runs:n approved_runs:n rejected_runs:n
       active_training_runs:n phase3_runs:n pending_gate_candidate_runs:n trained_at""",
    """
    SELECT * FROM (SELECT *, count(*) OVER () AS total_runs, count(*) FILTER (WHERE status = 'candidate') OVER ()
               AS candidate_runs, count(*) FILTER (WHERE status = 'approved') OVER () AS approved_runs,
           count(*) FILTER (WHERE status = 'rejected') OVER () AS rejected_runs,
           count(*) FILTER (WHERE status = 'training') OVER () AS active_training_runs,
           count(*) FILTER (WHERE notes IS NOT NULL) OVER () AS phase3_runs,
           count(*) FILTER (WHERE status = 'candidate' AND NOT has_gate_decision) OVER ()
               AS pending_gate_candidate_runs FROM registry_marked)
    ORDER BY trained_at DESC, created_at DESC, model_version LIMIT 200
    """,
    "registry_marked",
)
def _training_runs(t: Tables):
    return gv.training_runs(registry(t), decisions(t), 200)


@query(
    "champion_latest",
    "model_version status total_runs:n approved_runs:n trained_at",
    """SELECT *, count(*) OVER () AS total_runs, count(*) OVER () AS approved_runs FROM registry_sql
       WHERE status = 'approved' ORDER BY trained_at DESC, model_version LIMIT 1""",
    "registry_sql",
)
def _champion_latest(t: Tables):
    return gv.champion_latest(registry(t))


# two evaluations per family and snapshot; the later one counts
cte(
    "family_rows",
    """
    SELECT 'neural_eod_protocol_v1' AS protocol_version, training_dataset_snapshot AS dataset_snapshot,
           'fam' || CAST(k % 45 AS VARCHAR) AS candidate_family_hash, max(k) AS total_trades, count(*) AS folds
    FROM models GROUP BY 1, 2, 3
    """,
    "models",
)


@shared
def family_rows(t: Tables):
    base = (
        models(t)
        .groupBy(
            F.lit("neural_eod_protocol_v1").alias("protocol_version"),
            F.col("training_dataset_snapshot").alias("dataset_snapshot"),
            F.concat(F.lit("fam"), (F.col("k") % 45).cast("string")).alias("candidate_family_hash"),
        )
        .agg(F.max("k").alias("total_trades"), F.count(F.lit(1)).alias("folds"))
    )
    blank = {c: F.lit(None).cast("double") for c in gv.FAMILY_FACTS if c not in ("total_trades", "folds")}
    both = base.withColumns(blank).withColumn("created_at", F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-01-02"))))
    return both.withColumn("total_trades", F.when(F.col("created_at") == "2024-01-02", F.col("total_trades")).otherwise(-1))


@query(
    "gate_decisions",
    """decision_id candidate_family_hash decision_status passed:b failed_criteria total_decisions:n
       rejected_decisions:n passed_decisions:n folds:n total_trades:n""",
    """
    SELECT d.* EXCLUDE (failed_criteria), array_to_string(failed_criteria, ', ') AS failed_criteria, f.folds,
           f.total_trades
    FROM (SELECT *, count(*) OVER () AS total_decisions, count(*) FILTER (WHERE NOT passed) OVER ()
                     AS rejected_decisions, count(*) FILTER (WHERE passed) OVER () AS passed_decisions
          FROM decisions ORDER BY decided_at DESC, decision_id LIMIT 300) AS d
    LEFT JOIN family_rows AS f USING (dataset_snapshot, candidate_family_hash)
    """,
    "decisions family_rows",
)
def _gate_decisions(t: Tables):
    return gv.gate_decisions(decisions(t), family_rows(t), 300)


@query(
    "champion_gate",
    "decision_id candidate_family_hash decision_status total_decisions:n passed_decisions:n",
    """SELECT *, count(*) OVER () AS total_decisions, count(*) FILTER (WHERE passed) OVER () AS passed_decisions
       FROM decisions WHERE candidate_family_hash = (SELECT json_family FROM registry_sql WHERE model_version = 'm8')
       ORDER BY decided_at DESC, decision_id LIMIT 1""",
    "decisions registry_sql",
)
def _champion_gate(t: Tables):
    return gv.champion_gate(registry(t), decisions(t), family_rows(t), "m8")


# predictions of three models, every second one written twice
cte(
    "stored_predictions",
    """
    SELECT p.ticker, p.reference_date, p.reference_date + 1 AS valid_for, 'model' || CAST(j AS VARCHAR) AS model_id,
           'v' || CAST(j AS VARCHAR) AS model_version, p.confidence + j * 0.001::DOUBLE + c * 0.0001::DOUBLE
               AS confidence, p.suggested_action, 'run' || CAST(c AS VARCHAR) AS job_run_id
    FROM predictions AS p, (VALUES (0), (1), (2)) AS m(j), (VALUES (0), (1)) AS copies(c)
    WHERE c = 0 OR j = 1
    QUALIFY row_number() OVER (PARTITION BY p.ticker, p.reference_date, j ORDER BY c DESC) = 1
    """,
    "predictions",
)


@shared
def stored_predictions(t: Tables):
    j, c = F.col("j"), F.col("c")
    return (
        predictions(t)
        .withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(3)])))
        .withColumn("c", F.explode(F.when(j == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "ticker",
            "reference_date",
            F.date_add("reference_date", 1).alias("valid_for"),
            F.concat(F.lit("model"), j.cast("string")).alias("model_id"),
            F.concat(F.lit("v"), j.cast("string")).alias("model_version"),
            (F.col("confidence") + j * 0.001 + c * 0.0001).alias("confidence"),
            "suggested_action",
            F.concat(F.lit("run"), c.cast("string")).alias("job_run_id"),
            F.lit("2024-01-01").alias("created_at"),
        )
    )


PRED = "ticker reference_date valid_for model_version confidence:d suggested_action job_run_id"


@query("predictions_latest", PRED, "SELECT * FROM stored_predictions", "stored_predictions")
def _predictions_latest(t: Tables):
    return gv.predictions_latest(stored_predictions(t))


@query(
    "champion_predictions",
    PRED,
    """SELECT * FROM stored_predictions WHERE model_version = 'v1'
       AND reference_date = (SELECT max(reference_date) FROM stored_predictions)
       ORDER BY confidence DESC, ticker LIMIT 20""",
    "stored_predictions",
)
def _champion_predictions(t: Tables):
    return gv.champion_predictions(stored_predictions(t), "v1", 20)


@query(
    "champion_signals",
    "reference_date ticker side entry:d rank:n score:d",
    "SELECT * FROM eod_signals WHERE reference_date = (SELECT max(reference_date) FROM eod_signals)",
    "eod_signals",
)
def _champion_signals(t: Tables):
    return gv.champion_signals(eod_signals(t), "model_v1")


def crit(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in pairs) + "], lambda x: x IS NOT NULL)"


_drift = "abs(train_up - test_up)"
_pgap = "abs(validation_directional_precision - test_directional_precision)"
_shadow = [("test_rows", "test_rows < 500"), ("test_accuracy", "test_accuracy < 0.38"),
           ("test_directional_precision", "test_directional_precision < 0.34"), ("test_coverage", "test_coverage < 0.2"),
           ("train_test_accuracy_gap", f"{OVERFIT} > 0.2::DOUBLE"), ("validation_test_precision_gap", f"{_pgap} > 0.12::DOUBLE"),
           ("label_drift_pct", f"{_drift} > 0.15::DOUBLE")]
_watch = [("overfit_watch", f"{OVERFIT} > {0.20 * 0.75!r}::DOUBLE"),
          ("coverage_drop_watch", "greatest(validation_coverage - test_coverage, 0) > 0.1::DOUBLE"),
          ("label_drift_watch", f"{_drift} > {0.15 * 0.75!r}::DOUBLE")]


@query(
    "shadow_gate",
    "candidate_id approved:b gate_status failed_criteria:a alerts:a label_drift_pct:d",
    f"""SELECT *, len(failed_criteria) = 0 AS approved, CASE WHEN len(failed_criteria) = 0 THEN 'shadow_candidate'
               ELSE 'blocked_for_shadow' END AS gate_status
        FROM (SELECT *, {crit(_shadow)} AS failed_criteria, {crit(_watch)} AS alerts, {_drift} AS label_drift_pct
              FROM models)""",
    "models",
)
def _shadow_gate(t: Tables):
    # a label present in one distribution only counts as 0 in the other
    rows = models(t).withColumns(
        {
            "label_distribution_train": F.create_map(F.lit("up"), "train_up"),
            "label_distribution_test": F.create_map(F.lit("up"), "test_up", F.lit("flat"), F.lit(0.0)),
        }
    )
    return gv.shadow_gate(rows)


GATE = {
    "profit_factor": "CAST(80 + k * 7 % 90 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "win_rate": "CAST(40 + k * 3 % 30 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "fill_rate": "CAST(30 + k * 11 % 60 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "max_drawdown_pct": "CAST(-1 * (k * 13 % 25) AS DOUBLE) / CAST(100 AS DOUBLE)",
    "trade_count": "k * 17 % 90",
    "avg_return_pct": "CAST(k * 19 % 9 - 2 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "cost_sensitivity_pct": "CAST(k * 23 % 30 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "paper_days": "60 + k * 29 % 200",
    "approvals_n": "k % 4",
}
cte("gate_metrics", "SELECT model_version, k, " + ", ".join(f"{v} AS {n}" for n, v in GATE.items()) + " FROM models", "models")


@shared
def gate_metrics(t: Tables):
    return models(t).select("model_version", "model_id", "k", *[F.expr(v).alias(n) for n, v in GATE.items()])


_paper = [("profit_factor", "profit_factor < 1.1::DOUBLE"), ("win_rate", "win_rate < 0.5"), ("fill_rate", "fill_rate < 0.4::DOUBLE"),
          ("max_drawdown_pct", "abs(max_drawdown_pct) > 0.15::DOUBLE"), ("trade_count", "trade_count < 30"),
          ("avg_return_pct", "avg_return_pct <= 0"), ("cost_sensitivity_pct", "cost_sensitivity_pct > 0.25")]


@query(
    "paper_gate",
    "model_version approved:b gate_status failed_criteria:a",
    f"""SELECT *, len(failed_criteria) = 0 AS approved, CASE WHEN len(failed_criteria) = 0 THEN 'approved_for_paper'
               ELSE 'blocked_for_paper' END AS gate_status
        FROM (SELECT *, {crit(_paper)} AS failed_criteria FROM gate_metrics)""",
    "gate_metrics",
)
def _paper_gate(t: Tables):
    return gv.paper_gate(gate_metrics(t))


_promo = [("oos_profit_factor", "profit_factor < 1.15::DOUBLE"), ("oos_win_rate", "win_rate < 0.52::DOUBLE"),
          ("paper_profit_factor", "profit_factor < 1.1::DOUBLE"), ("paper_win_rate", "win_rate < 0.5"),
          ("paper_days", "paper_days < 120"), ("paper_trades", "trade_count < 50"),
          ("paper_max_drawdown_pct", "abs(max_drawdown_pct) > 0.12::DOUBLE"), ("fill_rate", "fill_rate < 0.4::DOUBLE"),
          ("avg_abs_backtest_divergence_pct", "cost_sensitivity_pct > 0.05::DOUBLE"), ("explicit_approval", "approvals_n = 0")]
cte(
    "promotions",
    f"""SELECT *, CASE WHEN len(failed_criteria) = 0 THEN 'approved_for_controlled_promotion'
                       ELSE 'blocked_for_promotion' END AS gate_status
        FROM (SELECT *, {crit(_promo)} AS failed_criteria FROM gate_metrics)""",
    "gate_metrics",
)


@shared
def promotions(t: Tables):
    rows = gate_metrics(t).withColumns(
        {
            "oos_profit_factor": F.col("profit_factor"),
            "oos_win_rate": F.col("win_rate"),
            "paper_profit_factor": F.col("profit_factor"),
            "paper_win_rate": F.col("win_rate"),
            "paper_trades": F.col("trade_count"),
            "paper_max_drawdown_pct": F.col("max_drawdown_pct"),
            "avg_abs_backtest_divergence_pct": F.col("cost_sensitivity_pct"),
            "approvals": F.array_repeat(F.lit("ana"), F.col("approvals_n").cast("int")),
        }
    )
    return gv.promotion_gate(rows)


@query(
    "promotion_gate",
    "model_version gate_status effective_signal_source failed_criteria:a",
    "SELECT *, CASE WHEN len(failed_criteria) = 0 THEN 'hybrid' ELSE 'heuristic' END AS effective_signal_source FROM promotions",
    "promotions",
)
def _promotion_gate(t: Tables):
    return promotions(t)


@shared
def promotion_log(t: Tables):
    """Stored promotion decisions, each preceded by an older blocked one."""
    ok = (F.col("trade_count") % 3 == 0).alias("ok")
    rows = gate_metrics(t).select("model_id", "model_version", "k", ok)
    when = F.explode(F.array(F.lit("2024-01-05"), F.lit("2024-01-06"))).alias("promotion_date")
    rows = rows.select("*", when)
    final = F.col("promotion_date") == "2024-01-06"
    yes, no = F.lit("approved_for_controlled_promotion"), F.lit("blocked_for_promotion")
    return rows.withColumns(
        {
            "promotion_status": F.when(final & F.col("ok"), yes).otherwise(no),
            "created_at": F.col("k"),
            "criteria_id": F.lit("core"),
            "criteria_version": F.when(F.col("k") % 10 == 0, "v0").otherwise("v1"),
            "approved_for_paper": F.col("ok"),
            "evaluation_date": F.col("promotion_date"),
        }
    )


@shared
def criteria(t: Tables):
    rows = [("core", "v1", "active", "2024-01-02", "hybrid", "heuristic"), ("core", "v0", "active", "2024-01-01", "x", "y")]
    return t.spark.createDataFrame(
        rows,
        "criteria_id string, criteria_version string, status string, updated_at string,"
        " promotion_signal_source string, configured_fallback_signal_source string",
    )


@query(
    "promotion_gate_view",
    "model_version promotion_status safe_signal_source",
    """SELECT model_version, CASE WHEN trade_count % 3 = 0 THEN 'approved_for_controlled_promotion'
                                  ELSE 'blocked_for_promotion' END AS promotion_status,
              CASE WHEN trade_count % 3 = 0 THEN 'hybrid' ELSE 'heuristic' END AS safe_signal_source
       FROM gate_metrics WHERE k % 10 <> 0""",
    "gate_metrics",
)
def _promotion_view(t: Tables):
    return gv.promotion_gate_view(promotion_log(t), criteria(t))


@query(
    "paper_gate_view",
    "model_version paper_gate_status",
    """SELECT model_version, CASE WHEN trade_count % 3 = 0 THEN 'liberado_paper' ELSE 'bloqueado_backtest' END
              AS paper_gate_status FROM gate_metrics WHERE k % 10 <> 0""",
    "gate_metrics",
)
def _paper_view(t: Tables):
    return gv.paper_gate_view(promotion_log(t), criteria(t))


@query(
    "active_promotion",
    "model_id model_version",
    """SELECT model_id, model_version FROM models JOIN (SELECT model_version, trade_count FROM gate_metrics)
              USING (model_version) WHERE trade_count % 3 = 0
       QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY k DESC) = 1""",
    "models gate_metrics",
)
def _active_promotion(t: Tables):
    return gv.active_promotion(promotion_log(t))


# one approval request per model; some point to other decisions or lack a ticket
cte(
    "approvals",
    f"""
    SELECT *, len(failed_checks) = 0 AS approved, len(failed_checks) = 0 AND current_status <> 'approved' AS update_allowed
    FROM (
        SELECT r.model_version, m.status AS current_status, {crit([
            ('approval_ticket_obrigatorio', "r.ticket = ''"),
            ('registry_status_invalido_para_aprovacao', "m.status NOT IN ('candidate', 'approved')"),
            ('gate_decision_nao_encontrada', 'd.decision_id IS NULL'),
            ('gate_name_invalido', "d.gate_name <> 'research_walk_forward'"),
            ('gate_status_nao_passou', "d.decision_status <> 'passed'"),
            ('gate_passed_false', 'NOT d.passed'),
            ('gate_failed_criteria_presentes', 'len(d.failed_criteria) > 0'),
        ])} AS failed_checks
        FROM (SELECT model_version, CASE WHEN k % 9 = 0 THEN '' ELSE 'T-1' END AS ticket,
                     'gate_' || CAST(k AS VARCHAR) AS decision_id FROM models) AS r
        JOIN models AS m USING (model_version) LEFT JOIN decisions AS d USING (decision_id))
    """,
    "models decisions",
)


@shared
def approvals(t: Tables):
    k = F.col("k")
    requests = models(t).select(
        "model_version",
        F.concat(F.lit("gate_"), k.cast("string")).alias("decision_id"),
        F.lit("ana").alias("approved_by"),
        F.when(k % 9 == 0, "").otherwise("T-1").alias("approval_ticket"),
    )
    return gv.champion_approval_checks(requests, registry(t), decisions(t))


@query(
    "champion_approval_checks",
    "model_version current_status approved:b update_allowed:b failed_checks:a",
    "SELECT * FROM approvals",
    "approvals",
)
def _approvals(t: Tables):
    return approvals(t)


@query(
    "approve_registry",
    "model_version status notes",
    """SELECT r.model_version, CASE WHEN a.update_allowed AND r.status = 'candidate' THEN 'approved' ELSE r.status END
              AS status, CASE WHEN a.update_allowed AND r.status = 'candidate'
                              THEN concat_ws(chr(10), r.notes, 'ok') ELSE r.notes END AS notes
       FROM registry_sql AS r JOIN approvals AS a USING (model_version)""",
    "registry_sql approvals",
)
def _approve(t: Tables):
    return gv.approve_registry(registry(t), approvals(t).withColumn("approval_note", F.lit("ok")))


@query(
    "champion_audit",
    "training_dataset_snapshot feature_version label_version champions:n warning",
    """SELECT training_dataset_snapshot, feature_version, label_version, count(*) AS champions,
              'champions_duplicados:' || training_dataset_snapshot || ':' || feature_version || ':' || label_version
                  AS warning
       FROM models WHERE status = 'approved' GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "models",
)
def _audit(t: Tables):
    return gv.champion_audit(models(t))


@query(
    "advisor_vs_control",
    "evolution_run_id advisor_count:n control_count:n advisor_best_score:d control_best_score:d advisor_won:b summary",
    """
    SELECT *, coalesce(advisor_best_score > control_best_score, FALSE) AS advisor_won,
           CASE WHEN advisor_best_score IS NULL THEN 'advisor_without_accepted_candidates'
                WHEN control_best_score IS NULL THEN 'control_without_candidates'
                WHEN advisor_best_score > control_best_score THEN 'advisor_outperformed_control'
                ELSE 'control_matched_or_outperformed_advisor' END AS summary
    FROM (SELECT evolution_run_id, count(*) FILTER (WHERE k % 3 = 0) AS advisor_count,
                 count(*) FILTER (WHERE k % 3 <> 0) AS control_count,
                 max(score_total) FILTER (WHERE k % 3 = 0) AS advisor_best_score,
                 max(score_total) FILTER (WHERE k % 3 <> 0) AS control_best_score FROM scored GROUP BY 1)
    """,
    "scored",
)
def _advisor(t: Tables):
    origin = F.when(F.col("k") % 3 == 0, "advisor").otherwise("control")
    rows = scored(t).withColumns({"origin": origin, "score": F.col("score_total")})
    return gv.advisor_vs_control(rows, ["evolution_run_id"])


# ------------------------------------------------------------------ stored evidence

cte(
    "stored_folds",
    """
    SELECT model_version, k, training_dataset_snapshot AS dataset_snapshot, 'fold_' || CAST(i AS VARCHAR) AS fold_id, i,
           CASE WHEN k % 5 <> 0 THEN candidate_family_hash ELSE model_version END AS candidate_family_hash,
           (k + i) % 25 AS trades, (k * (i + 2) % 21 - 8) / 1000.0::DOUBLE AS expectancy_net,
           (k * i % 30) / 100.0::DOUBLE AS max_drawdown, (k * (i + 3) % 23 - 7) / 1000.0::DOUBLE AS delta,
           CASE WHEN k % 7 = 0 OR i % 2 = 1 THEN 1.0 ELSE 1.5 END AS cost_multiplier,
           CASE WHEN k % 3 <> 0 THEN 1 + k % 2 ELSE 1 END AS seed_count
    FROM models, range(1, 6) AS r(i) WHERE k % 4 <> 3
    """,
    "models",
)


@query(
    "registry_fold_metrics",
    "model_version candidate_family_hash trial_id fold_id seed:n trades:n expectancy_net:d max_drawdown:d cost_multiplier:d",
    """SELECT *, 11 AS seed, model_version || '_' || fold_id || '_' || CAST(i AS VARCHAR) || '_'
              || replace(CAST(cost_multiplier AS VARCHAR), '.', '_') AS trial_id FROM stored_folds""",
    "stored_folds",
)
def _fold_metrics(t: Tables):
    return gv.registry_fold_metrics(registry(t))


_gate_crit = [("trades_insuficientes", "total_trades < 30"), ("folds_positivos_insuficientes", "positive_folds < 4"),
              ("nao_supera_champion_mediana", "median_delta <= 0"), ("fold_catastrofico", "worst_delta < -0.02"),
              ("drawdown_excessivo", "max_drawdown > 0.2"), ("stress_custo_ausente", "NOT stressed"),
              ("seeds_instaveis", "seed_count = 1")]


@query(
    "evaluate_candidate_evidence",
    "model_version candidate_family_hash decision_status passed:b failed_criteria:a total_trades:n median_delta_expectancy_vs_champion:d",
    f"""
    SELECT model_version, candidate_family_hash, total_trades, median_delta AS median_delta_expectancy_vs_champion,
           len(failed_criteria) = 0 AS passed, failed_criteria,
           CASE WHEN len(failed_criteria) = 0 THEN 'passed' ELSE 'rejected' END AS decision_status
    FROM (SELECT *, {crit(_gate_crit)} AS failed_criteria
          FROM (SELECT model_version, candidate_family_hash, seed_count, sum(trades) AS total_trades,
                       count(*) FILTER (WHERE delta > 0) AS positive_folds, median(delta) AS median_delta,
                       min(delta) AS worst_delta, max(max_drawdown) AS max_drawdown,
                       bool_or(cost_multiplier = 1.5) AS stressed FROM stored_folds GROUP BY 1, 2, 3))
    UNION ALL
    SELECT model_version, model_version, NULL, NULL, FALSE, ['muen_economics_missing'], 'blocked'
    FROM models WHERE k % 4 = 3
    """,
    "stored_folds models",
)
def _evidence(t: Tables):
    return gv.evaluate_candidate_evidence(registry(t))


@query(
    "merge_fold_rows",
    "trial_id fold_id trades:n",
    """SELECT fold_id, CASE WHEN k % 2 = 0 THEN trades + 100 ELSE trades END AS trades,
              model_version || '_' || fold_id || '_' || CAST(i AS VARCHAR) || '_'
              || replace(CAST(cost_multiplier AS VARCHAR), '.', '_') AS trial_id FROM stored_folds""",
    "stored_folds",
)
def _merge(t: Tables):
    folds = gv.registry_fold_metrics(registry(t)).select("trial_id", "fold_id", "trades", "model_version")
    even = folds.where("CAST(substring(model_version, 2) AS BIGINT) % 2 = 0")
    return gv.merge_fold_rows(folds, even.withColumn("trades", F.col("trades") + 100))


@query(
    "legacy_fold_rekey",
    "candidate_family_hash trial_id fold_id",
    """SELECT 'phase3_family_' || substr(sha256('[{"key":"layers","value":"' || layers || '"}]|[{"key":"runtime_minutes","value":"' || runtime_minutes || '"}]'), 1, 24)
              AS candidate_family_hash, model_version || '_' || fold_id || '_' || CAST(i AS VARCHAR) || '_' || replace(CAST(cost_multiplier AS VARCHAR), '.', '_') AS trial_id, fold_id
       FROM stored_folds JOIN (SELECT model_version, layers, runtime_minutes FROM models) USING (model_version)""",
    "stored_folds models",
)
def _rekey(t: Tables):
    folds = gv.registry_fold_metrics(registry(t)).withColumn("candidate_family_hash", F.col("model_version"))
    configs = models(t).select(
        "model_version",
        F.to_json(F.struct("layers")).alias("architecture_json"),
        F.to_json(F.struct("runtime_minutes", F.col("k").alias("random_seed"))).alias("hyperparameters_json"),
    )
    key = gv.candidate_family_key(F.col("architecture_json"), F.col("hyperparameters_json"))
    targets = configs.select(F.concat(F.lit("phase3_family_"), F.substring(key, 1, 24)).alias("candidate_family_hash"))
    return gv.legacy_fold_rekey(folds, configs, targets.distinct(), "phase3_family_")




@shared
def evidence_registry(t: Tables):
    """Registry rows with daily returns; some have no folds, some a stored family block with gaps, some entries gaps."""
    k = F.col("k")
    fold = lambda i: F.struct(
        F.when((k % 8 != 6) | F.lit(i != 2), F.lit(f"fold_{i}")).alias("fold_id"), F.when((k % 8 != 2) | F.lit(i != 3), (k + 9 * i) % 40).alias("trades"),
        ((k * (i + 3) % 23 - 7) / 1000).alias("delta_expectancy_vs_champion"), F.lit(1.0 if i % 2 else 1.5).alias("cost_multiplier"),
    )
    filled = lambda i: ~((k % 5 == 2) & F.lit(i == 2))
    day = lambda i: F.struct(
        F.when(filled(i), F.lit(f"fold_{i}")).alias("fold_id"),
        F.when(filled(i), F.when((k % 6 == 5) & F.lit(i == 3), "soon").otherwise(f"2024-01-0{i}")).alias("reference_date"),
        F.when(filled(i), F.concat(F.lit("T"), k.cast("string"))).alias("ticker"),
        F.when(filled(i), (k * i % 13 - 6) / 1000).alias("model_net_return"),
        F.when(filled(i) & (k % 2 == 1), F.lit("snap_own")).alias("dataset_snapshot"),
    )
    family = F.struct(F.lit(40).alias("total_trades"), F.lit(4).alias("positive_folds"), F.lit(0.01).alias("median_delta_expectancy_vs_champion"))
    economics = F.struct(
        F.when(k % 9 != 4, F.array(*[fold(i) for i in range(1, 5)])).otherwise(F.when(k % 2 == 0, F.array().cast("array<struct<fold_id:string,trades:bigint,delta_expectancy_vs_champion:double,cost_multiplier:double>>"))).alias("fold_metrics"),
        F.lit(2).alias("seed_count"),
        F.when(k % 9 == 1, family).alias("family_evaluation"),
        F.array(*[day(i) for i in range(1, 4)]).alias("daily_returns"),
    )
    empty = F.when(k % 7 == 5, F.lit('{"muen_economics":{}}')).when(k % 7 == 6, F.lit('{"muen_economics":[1]}'))
    return models(t).withColumn("metrics_json", F.coalesce(empty, F.to_json(F.struct(F.when(k % 4 != 3, economics).alias("muen_economics")))))


cte(
    "evidence_models",
    """SELECT model_version, k, training_dataset_snapshot AS snapshot, CASE WHEN k % 7 >= 5 OR k % 4 = 3 THEN 'muen_economics_missing' WHEN k % 9 = 4 THEN 'fold_metrics_missing' END AS missing FROM models""",
    "models",
)
cte("evidence_folds", "SELECT *, (k + 9 * i) % 40 AS n FROM evidence_models, range(1, 5) AS r(i) WHERE missing IS NULL", "evidence_models")


@query(
    "registry_daily_returns",
    "model_version protocol_version dataset_snapshot candidate_family_hash fold_id reference_date ticker model_net_return:d champion_net_return:d",
    f"""SELECT model_version, '{ev.PROTOCOL}' AS protocol_version, CASE WHEN k % 2 = 1 THEN 'snap_own' ELSE snapshot END AS dataset_snapshot, model_version AS candidate_family_hash,
              'fold_' || i AS fold_id, CASE WHEN NOT (k % 6 = 5 AND i = 3) THEN DATE '2024-01-01' + CAST(i - 1 AS INTEGER) END AS reference_date, 'T' || k AS ticker,
              (k * i % 13 - 6) / 1000.0::DOUBLE AS model_net_return, NULL::DOUBLE AS champion_net_return
       FROM evidence_models, range(1, 4) AS r(i) WHERE missing IS NULL AND NOT (k % 5 = 2 AND i = 2)""",
    "evidence_models",
)
def _daily_evidence(t: Tables):
    return gv.registry_daily_returns(evidence_registry(t))


@query(
    "registry_rejects",
    "model_version level position:n reason",
    """SELECT model_version, 'model' AS level, 0 AS position, missing AS reason FROM evidence_models WHERE missing IS NOT NULL
       UNION ALL SELECT model_version, 'fold', i, 'fold_id_missing' FROM evidence_folds WHERE k % 8 = 6 AND i = 2
       UNION ALL SELECT model_version, 'fold', i, 'trades_missing' FROM evidence_folds WHERE k % 8 = 2 AND i = 3
       UNION ALL SELECT model_version, 'daily_return', i, CASE WHEN k % 5 = 2 AND i = 2 THEN 'daily_return_empty' ELSE 'reference_date_missing' END
       FROM evidence_models, range(1, 4) AS r(i) WHERE coalesce(missing, '') <> 'muen_economics_missing' AND ((k % 5 = 2 AND i = 2) OR (k % 6 = 5 AND i = 3))""",
    "evidence_models evidence_folds",
)
def _rejects(t: Tables):
    return gv.registry_rejects(evidence_registry(t))


@query(
    "candidate_evidence_gaps",
    "model_version decision_status passed:b failed_criteria:a total_trades:n median_delta_expectancy_vs_champion:d",
    f"""
    SELECT *, len(failed_criteria) = 0 AS passed, CASE WHEN len(failed_criteria) = 0 THEN 'passed' ELSE 'rejected' END AS decision_status
    FROM (SELECT model_version, total_trades, median_delta AS median_delta_expectancy_vs_champion, {crit(_gate_crit)} AS failed_criteria
          FROM (SELECT model_version, CASE WHEN k % 9 = 1 THEN 1 ELSE 2 END AS seed_count, CASE WHEN k % 9 = 1 THEN 40 ELSE sum(CASE WHEN k % 8 = 2 AND i = 3 THEN 0 ELSE n END) END AS total_trades,
                       CASE WHEN k % 9 = 1 THEN 4 ELSE count(*) FILTER (WHERE delta > 0) END AS positive_folds, CASE WHEN k % 9 = 1 THEN 0.01 ELSE median(delta) END AS median_delta,
                       CASE WHEN k % 9 = 1 THEN 0 ELSE min(delta) END AS worst_delta, 0 AS max_drawdown, k % 9 <> 1 AS stressed
                FROM (SELECT *, (k * (i + 3) % 23 - 7) / 1000.0::DOUBLE AS delta FROM evidence_folds) GROUP BY model_version, k))
    UNION ALL BY NAME
    SELECT model_version, NULL AS total_trades, NULL AS median_delta_expectancy_vs_champion, FALSE AS passed, [missing] AS failed_criteria, 'blocked' AS decision_status
    FROM evidence_models WHERE missing IS NOT NULL
    """,
    "evidence_folds evidence_models",
)
def _evidence_gaps(t: Tables):
    return gv.evaluate_candidate_evidence(evidence_registry(t))


@query(
    "gate_decision_id",
    "model_version decision_id",
    f"""SELECT model_version, 'gate_' || left(sha256('{{"candidate_family_hash":"' || candidate_family_hash || '","dataset_snapshot":"' || training_dataset_snapshot || '","decided_at":"'
              || CAST(created_at AS VARCHAR) || '","gate_name":"{ev.RESEARCH_GATE}","protocol_version":"{ev.PROTOCOL}"}}'), 32) AS decision_id FROM models""",
    "models",
)
def _gate_ids(t: Tables):
    key = ev.gate_decision_id(F.lit(ev.PROTOCOL), F.col("training_dataset_snapshot"), F.col("candidate_family_hash"), F.lit(ev.RESEARCH_GATE), F.col("created_at"))
    return models(t).select("model_version", key.alias("decision_id"))


@query(
    "paper_gate_limits",
    "model_version approved:b failed_criteria:a trade_count:n",
    f"""SELECT model_version, failed_criteria, len(failed_criteria) = 0 AS approved, trade_count
        FROM (SELECT *, {crit([("profit_factor", "profit_factor < 1.3::DOUBLE"), ("win_rate", "win_rate < 0.5"), ("fill_rate", "fill_rate < 0.4::DOUBLE"),
                               ("max_drawdown_pct", "abs(max_drawdown_pct) > 0.2::DOUBLE"), ("trade_count", "trade_count < 40"), ("avg_return_pct", "avg_return_pct <= 0"), ("cost_sensitivity_pct", "cost_sensitivity_pct > 0.25")])} AS failed_criteria
              FROM (SELECT * REPLACE (CASE WHEN k % 3 = 0 OR trade_count = 0 THEN k % 100 ELSE trade_count END AS trade_count) FROM gate_metrics))""",
    "gate_metrics",
)
def _paper_limits(t: Tables):
    """Stricter limits; a third of the rows have their trades under the other name."""
    rows = gate_metrics(t).withColumns({"trades": F.col("k") % 100, "trade_count": F.when(F.col("k") % 3 != 0, F.col("trade_count"))})
    return gv.paper_gate(rows, {"profit_factor": 1.3, "max_drawdown_pct": 0.2, "trade_count": 40})
