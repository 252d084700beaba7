"""Barrier engine, labels, splits, fold evidence and gates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import barrier as bar
from tickerloom.operators import dataset as ds
from tickerloom.operators import evidence as ev
from tickerloom.operators import governance as gv

D0 = dt.date(2024, 1, 1)
BARS = "ticker string, session_date date, open double, high double, low double, close double, volume double"
SIGNALS = "id int, ticker string, side string, valid_from date, entry double, target double, stop double, horizon_days int"


def machine(side, entry, target, stop, bars):
    """Plain state machine over (date, high, low, close)."""
    if not bars:
        return "NO_DATA", None, None
    start = None
    for i, (_, hi, lo, _) in enumerate(bars):
        if start is None and not (hi >= entry if side == "SELL" else lo <= entry):
            continue
        start = i if start is None else start
        if hi >= stop if side == "SELL" else lo <= stop:
            return "STOP", i - start + 1, stop
        if lo <= target if side == "SELL" else hi >= target:
            return "TARGET", i - start + 1, target
    if start is None:
        return "EXPIRED_UNFILLED", None, None
    return "EXPIRED_MARK_TO_MARKET", len(bars) - start, bars[-1][3]


def test_barrier_equals_state_machine(spark):
    rnd = random.Random(3)
    bars, signals, want = [], [], {}
    for t in "ABC":
        px = 100.0
        for i in range(60):
            if rnd.random() < 0.15:  # gaps between sessions
                continue
            px *= 1 + rnd.gauss(0, 0.02)
            hi, lo = px * (1 + abs(rnd.gauss(0, 0.015))), px * (1 - abs(rnd.gauss(0, 0.015)))
            bars.append((t, D0 + dt.timedelta(days=i), px, hi, lo, px, 1.0))
    for n in range(300):
        t, side = rnd.choice("ABCZ"), rnd.choice(["BUY", "SELL"])
        day, h = D0 + dt.timedelta(days=rnd.randrange(-3, 63)), rnd.randrange(1, 11)
        sgn = 1 if side == "BUY" else -1
        entry = rnd.uniform(85, 115)
        target, stop = entry * (1 + sgn * 0.03), entry * (1 - sgn * 0.03)
        signals.append((n, t, side, day, entry, target, stop, h))
        path = sorted((b[1], b[3], b[4], b[5]) for b in bars if b[0] == t and b[1] >= day)[:h]
        want[n] = machine(side, entry, target, stop, path)
    out = bar.barrier_outcomes(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(bars, BARS), 10)
    rows = out.collect()
    assert len(rows) == 300
    for r in rows:
        reason, held, price = want[r.id]
        assert (r.exit_reason, r.holding_sessions) == (reason, held)
        assert r.exit_price == (pytest.approx(price) if price else None)


def one_signal(spark, side, bars, **costs):
    sgn = 1 if side == "BUY" else -1
    s = [(1, "A", side, D0, 10.0, 10 + sgn * 0.5, 10 - sgn * 0.5, 3)]
    rows = [("A", D0 + dt.timedelta(days=i), 10.0, hi, lo, c, 1.0) for i, (hi, lo, c) in enumerate(bars)]
    return bar.barrier_outcomes(spark.createDataFrame(s, SIGNALS), spark.createDataFrame(rows, BARS), 5, **costs).first()


def test_literal_barriers(spark):
    hit = one_signal(spark, "BUY", [(10.2, 9.9, 10.1), (10.6, 10.0, 10.5)])
    assert (hit.exit_reason, hit.exit_price, hit.holding_sessions) == ("TARGET", 10.5, 2)
    both = one_signal(spark, "BUY", [(10.6, 9.4, 10.0)])
    assert (both.exit_reason, both.net_return) == ("STOP", pytest.approx(-0.05))
    short = one_signal(spark, "SELL", [(10.1, 9.9, 10.0), (10.6, 9.9, 10.5)], cost_pct=0.01, borrow_cost_pct=0.001)
    assert (short.exit_reason, short.net_return) == ("STOP", pytest.approx(-0.05 - 0.01 - 0.002))
    idle = one_signal(spark, "BUY", [(10.6, 10.1, 10.5)])
    assert (idle.exit_reason, idle.entry_filled, idle.net_return) == ("EXPIRED_UNFILLED", False, 0.0)


def test_invalid_signal(spark):
    s = spark.createDataFrame([(1, "A", "BUY", D0, 0.0, 1.0, 1.0, 3), (2, "A", "BUY", D0, None, 1.0, 1.0, 3)], SIGNALS)
    bars = spark.createDataFrame([("A", D0, 1.0, 1.0, 1.0, 1.0, 1.0)], BARS)
    assert {r.exit_reason for r in bar.barrier_outcomes(s, bars, 5).collect()} == {"INVALID"}


def test_label_follows_later_bars(spark):
    rows = []
    for i in range(25):
        hi, lo = (105.0, 99.0) if i == 21 else (100.0, 98.0 if i == 20 else 99.0)
        rows.append(("A", D0 + dt.timedelta(days=i), 100.0, hi, lo, 100.0, 10.0))
    labels = ds.barrier_labels(spark.createDataFrame(rows, BARS), ds.LabelConfig())
    row = labels.where(F.col("reference_date") == F.lit(D0 + dt.timedelta(days=19))).first()
    assert (row.label_class, row.exit_reason, row.holding_sessions) == ("up", "TARGET", 2)
    assert labels.count() == 24


def dates(spark, n):
    return spark.createDataFrame([(D0 + dt.timedelta(days=i), "A") for i in range(n)], "reference_date date, ticker string")


def test_temporal_splits(spark):
    out = ds.temporal_splits(dates(spark, 80))
    got = {r.dataset_split: r["count"] for r in out.groupBy("dataset_split").count().collect()}
    assert (got["train"], got["validation"], got["test"]) == (52, 7, 7)


def test_walk_forward_plan(spark):
    cfg = ds.WalkForwardConfig(10, 2, 4, 3, 2, 4)
    plan = ds.walk_forward_plan(dates(spark, 35), cfg).orderBy("fold_id").collect()
    assert plan[0].train_sessions == 35 - 4 - 8 - 2 - 3 - 2
    assert plan[0].outer_test_sessions == 4 and plan[1].train_sessions == plan[0].train_sessions + 4
    assert (plan[0].locked_holdout_start, plan[0].locked_holdout_end) == (dt.date(2024, 2, 1), dt.date(2024, 2, 4))
    with pytest.raises(Exception, match="not enough sessions"):
        ds.walk_forward_plan(dates(spark, 20), cfg).collect()


def folds(spark, labels, buy, sell, champion=None):
    rows = [(1, D0 + dt.timedelta(days=i), "A", la, b, s, c)
            for i, (la, b, s, c) in enumerate(zip(labels, buy, sell, champion or [0.0] * len(labels)))]
    return spark.createDataFrame(
        rows, "fold int, reference_date date, ticker string, predicted_label string, buy_net_return double,"
        " sell_net_return double, champion_net_return double")  # fmt: skip


def test_fold_economics(spark):
    df = folds(spark, ["up", "down", "neutral", "up"], [0.05, 0.0, 0.0, -0.03], [0.0, 0.04, 0.0, 0.0], [0.01] * 4)
    row = ev.fold_economics(df, ["fold"], [1.5]).first()
    assert (row.trades, row.coverage) == (3, 0.75)
    assert row.profit_factor == pytest.approx(3.0) and row.median_net_return == pytest.approx(0.04)
    assert row.delta_expectancy_vs_champion == pytest.approx(0.02 - 0.01)
    assert row.max_drawdown == pytest.approx(0.03)
    only_wins = ev.fold_economics(folds(spark, ["up"], [0.1], [0.0]), ["fold"]).first()
    assert only_wins.profit_factor == float("inf")
    none = ev.fold_economics(folds(spark, ["neutral"], [0.1], [0.0]), ["fold"]).first()
    assert (none.trades, none.profit_factor, none.median_net_return) == (0, 0.0, 0.0)


def test_drawdown_stop(spark):
    df = folds(spark, ["up"] * 4, [0.1, -0.2, 0.05, 0.05], [0.0] * 4)
    out = ev.fold_drawdown_stop(df, ["fold"], 0.15).orderBy("reference_date").collect()
    assert [r.predicted_label for r in out] == ["up", "up", "neutral", "neutral"]


def test_directional_labels_and_budget(spark):
    rows = [(1, D0, "A", 0.5, 0.5, 0.0), (1, D0, "B", 0.1, 0.7, 0.2), (1, D0, "C", 0.44, 0.3, 0.26), (1, D0, "D", 0.3, 0.46, 0.44)]
    df = spark.createDataFrame(rows, "fold int, reference_date date, ticker string, prob_down double, prob_up double, prob_neutral double")
    lab = ev.directional_labels(df)
    got = {r.ticker: r.predicted_label for r in lab.collect()}
    assert got == {"A": "down", "B": "up", "C": "neutral", "D": "neutral"}
    kept = {r.ticker: r.predicted_label for r in ev.fold_trade_budget(lab, ["fold"], 1).collect()}
    # A and B are both 0.5 above neutral up to rounding; exactly one trade stays
    assert sum(v != "neutral" for v in kept.values()) == 1


def test_family_gate(spark):
    rows = [("f", s, f"fold_{i}_cost_{c}", 10, 0.03, 0.1, 0.02 + i * 0.001, c) for s in (1, 2) for i in range(5) for c in (1.0, 1.5)]
    schema = "family string, seed int, fold_id string, trades int, expectancy_net double, max_drawdown double, delta_expectancy_vs_champion double, cost_multiplier double"
    df = spark.createDataFrame(rows, schema)
    gate = ev.research_gate(ev.family_evaluation(df, ["family"])).first()
    assert gate.passed and gate.median_delta_expectancy_vs_champion == pytest.approx(0.022)
    single = ev.research_gate(ev.family_evaluation(df.where("seed = 1 AND cost_multiplier = 1.0"), ["family"])).first()
    assert single.failed_criteria == ["stress_custo_ausente", "seeds_instaveis"]
    assert single.decision_status == "rejected"


def test_label_drift_and_parameter_count(spark):
    row = spark.range(1).select(
        gv.label_drift(F.create_map(F.lit("up"), F.lit(0.5)), F.create_map(F.lit("down"), F.lit(0.2))).alias("d"),
    ).first()
    assert row.d == pytest.approx(0.5)
    units = spark.createDataFrame([([64, 32],), ([],)], "hidden_units array<int>")
    assert [r[0] for r in units.select(gv.parameter_count()).collect()] == [31 * 64 + 65 * 32 + 33 * 3, 31 * 3]


def test_backtest_metrics_grouping_sets(spark):
    rows = [(D0, "a", "BUY", 3, True, 0.1, D0, D0 + dt.timedelta(days=1)), (D0, "A", "SELL", 3, True, -0.05, D0, D0)]
    df = spark.createDataFrame(rows, "reference_date date, ticker string, side string, horizon_days int, entry_hit boolean,"
                               " return_pct double, entry_fill_date date, exit_date date")  # fmt: skip
    out = bar.backtest_metrics(df, D0)
    everyone = out.where("ticker IS NULL AND side IS NULL").first()
    assert (everyone.signals, everyone.fills, everyone.win_rate) == (2, 2, 0.5)
    assert everyone.profit_factor == pytest.approx(2.0) and everyone.avg_days_in_trade == 1.5
    assert out.count() == 1 + 2 + 1 + 2


def test_trade_budget_and_drawdown_stop_do_not_shuffle_the_rows(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        (seed, day + dt.timedelta(i // 3), f"T{i % 3}", 0.5, 0.1 + (i % 5) / 100, 0.4, ["up", "down", "neutral", None][i % 4], -0.05, 0.02, i)
        for seed in (1, 2, None) for i in range(60)
    ]
    df = spark.createDataFrame(
        rows, "seed int, reference_date date, ticker string, prob_down double, prob_neutral double, prob_up double, predicted_label string,"
        " buy_net_return double, sell_net_return double, no int",
    )
    kept = ev.fold_trade_budget(df, ["seed"], 7)
    assert kept.columns == df.columns
    for seed in (1, 2, None):
        order = sorted((r for r in rows if r[0] == seed and r[6] in ("up", "down")), key=lambda r: (r[4] - r[3], r[1], r[2]))
        want = {r[9]: r[6] for r in order[:7]}
        got = {r.no: r.predicted_label for r in kept.where(F.col("seed").eqNullSafe(F.lit(seed))).collect()}
        assert got == {i: want.get(i, "neutral") for i in range(60)}
    stop = ev.fold_drawdown_stop(df.where("seed IS NOT NULL"), ["seed"], 0.2)
    equity, peak, hit, want = 1.0, 1.0, False, []
    for r in rows[:60]:
        want.append("neutral" if hit else r[6])
        equity *= 1 + {"up": -0.05, "down": 0.02}.get(r[6], 0.0)
        peak = max(peak, equity)
        hit = hit or (peak - equity) / peak >= 0.2
    assert hit and [r.predicted_label for r in stop.where("seed = 2").orderBy("no").collect()] == want
    for out in (kept, stop):
        plan = out._jdf.queryExecution().executedPlan().toString()
        left = plan.split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in left and "Exchange hashpartitioning" not in left


def test_drawdown_of_a_trial_that_starts_without_a_trade(spark):
    df = folds(spark, ["neutral", "up", "up", "neutral", "up"], [0.5, -0.1, -0.1, 0.3, 0.05], [0.0] * 5)
    assert abs(ev.fold_economics(df, ["fold"]).first().max_drawdown - 0.19) < 1e-12
    late = folds(spark, ["up", "neutral", "up"], [-0.1, 0.0, -0.1], [0.0] * 3)
    assert abs(ev.fold_economics(late, ["fold"]).first().max_drawdown - 0.1) < 1e-12
