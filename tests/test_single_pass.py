"""Tests of trades, ranking quality and bars that are taken in one pass, against the separate operators or plain loops."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest

from tickerloom.operators import indicators, ranking, robustness

DAY = dt.date(2024, 1, 1)
POLICY = dict(
    policy_id="p", policy_version="v", status="em_teste", stressed_cost_multiplier=2.0, stressed_slippage_multiplier=3.0, updated_at="2024-01-01"
)


def trades(spark, n=3000):
    rng = random.Random(7)

    def value():
        return None if rng.random() < 0.05 else round(rng.gauss(0.1, 1), 3)

    rows = []
    for _ in range(n):
        name = rng.choice(["hot", "hot", "hot", "a", "b", "rare"] if rng.random() < 0.5 else ["hot"])
        rows.append((name, "family " + name, "v1", DAY + dt.timedelta(rng.randrange(150)), value(), value(), value(), value()))
    rows.append(("unpriced", "family unpriced", "v1", DAY, 1.0, None, 0.1, 0.1))
    rows.append(("no net", "family no net", "v1", DAY, None, 1.0, 0.1, 0.1))
    fields = "strategy_id string, strategy_family string, strategy_version string, reference_date date, net_pnl_pct double, gross_pnl_pct double, estimated_cost_pct double, slippage_pct double"
    return spark.createDataFrame(rows, fields)


def test_trade_tests_equal_the_separate_tests(spark):
    df, policies = trades(spark), spark.createDataFrame([POLICY])
    got = {r.strategy_id: r.asDict() for r in robustness.trade_tests(df, policies).collect()}
    assert set(got) == {"hot", "a", "b", "rare", "unpriced", "no net"}
    months = defaultdict(list)
    for r in robustness.walk_forward(df).collect():
        months[r.strategy_id].append(r)
    costs = {r.strategy_id: r for r in robustness.cost_stress(df, policies).collect()}
    rand = {r.strategy_id: r for r in robustness.randomization_benchmark(df).collect()}
    for name, row in got.items():
        windows = months[name]
        assert row["walk_forward_windows"] == len(windows)
        if windows:
            good = [w.walk_forward_status in ("janela_favoravel", "janela_positiva_fraca") for w in windows]
            assert row["pct_positive_walk_forward_windows"] == pytest.approx(sum(good) / len(good))
            assert row["avg_walk_forward_expectancy_net_pct"] == pytest.approx(sum(w.expectancy_net_pct for w in windows) / len(windows))
        for source, columns in (
            (costs, ["expectancy_without_cost_pct", "expectancy_normal_cost_pct", "expectancy_stressed_total_pct", "cost_stress_status"]),
            (rand, ["excess_expectancy_vs_random_pct", "pct_days_above_random", "randomization_status"]),
        ):
            for c in columns:
                want = source[name][c] if name in source else None
                assert row[c] == (pytest.approx(want, abs=1e-12) if isinstance(want, float) else want), (name, c)


def test_trade_tests_of_no_trades(spark):
    assert robustness.trade_tests(trades(spark).limit(0), spark.createDataFrame([POLICY])).count() == 0


def test_ranking_performance_against_loops(spark):
    rng = random.Random(3)
    rows = [
        (m, "v", DAY + dt.timedelta(d), p, (p - 1) // 3 + 1, None if rng.random() < 0.15 or (d == 4 and p <= 3) else rng.gauss(0.01, 0.02))
        for m in ("x", "y") for d in range(70) for p in range(1, 31) if not (m == "y" and d > 30)
    ]
    fields = "ranking_model_id string, ranking_model_version string, reference_date date, ranking_position int, ranking_decile int, forward_return_5d double"
    got = {(r.ranking_model_id, r.top_n): r for r in ranking.ranking_performance(spark.createDataFrame(rows, fields)).collect()}
    assert set(got) == {(m, n) for m in "xy" for n in (3, 5, 10)}
    mean = lambda xs: sum(xs) / len(xs)
    by_day = defaultdict(list)
    for m, _, d, p, q, r in rows:
        if r is not None:
            by_day[d].append(r)
    for (m, n), row in got.items():
        tops, deciles = defaultdict(list), defaultdict(list)
        for m2, _, d, p, q, r in rows:
            if m2 == m and r is not None:
                deciles[d, q].append(r)
                if p <= n:
                    tops[d].append(r)
        tops = {d: mean(v) for d, v in tops.items()}
        points = [(11 - q, mean(v)) for (_, q), v in deciles.items()]
        mx, my = mean([a for a, _ in points]), mean([b for _, b in points])
        spread = math.sqrt(sum((a - mx) ** 2 for a, _ in points) * sum((b - my) ** 2 for _, b in points))
        assert row.portfolio_days == len(tops) and row.positive_days == sum(v > 0 for v in tops.values())
        assert row.avg_top_n_return_5d == pytest.approx(mean(list(tops.values())))
        assert row.avg_excess_vs_random_5d == pytest.approx(mean([v - mean(by_day[d]) for d, v in tops.items()]))
        centre = mean(list(tops.values()))
        assert row.volatility_top_n_return_5d == pytest.approx(math.sqrt(mean([(v - centre) ** 2 for v in tops.values()])))
        assert row.decile_return_correlation == pytest.approx(sum((a - mx) * (b - my) for a, b in points) / spread)
        assert row.top_decile_return_5d == pytest.approx(mean([b for a, b in points if a == 10]))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_for_newest_bars_and_their_windows(spark):
    fields = "ticker string, session_date date, close double, high double, low double, updated_at timestamp"
    at = dt.datetime(2024, 1, 1)
    rows = [("A", DAY, 1.0, 1.0, 1.0, at), ("A", DAY, 2.0, 2.0, 2.0, at + dt.timedelta(1)), ("B", DAY, 3.0, 3.0, 3.0, at)]
    daily = spark.createDataFrame(rows, fields)
    assert sorted(r.close for r in indicators.dedup_daily(daily).collect()) == [2.0, 3.0]
    assert plan_of(indicators.indicators(indicators.dedup_daily(daily))).count("Exchange hashpartitioning") == 1


def test_robustness_tests_share_one_aggregate(spark):
    plan = plan_of(robustness.trade_tests(trades(spark, 10), spark.createDataFrame([POLICY])))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("Scan ExistingRDD") == 2  # trades once, the policy once
