"""Limits that can be off, and rows without ids, seeds, confidence or with repeated keys."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import frames
from tickerloom.operators import barrier as bar
from tickerloom.operators import evidence as ev
from tickerloom.operators import governance as gv
from tickerloom.operators import ops
from tickerloom.operators import ranking as rk
from tickerloom.operators import signals as sig
from tickerloom.sources import io, parsers
from tickerloom.streaming import quotes as sq

DAY = dt.date(2024, 1, 2)


def predictions(spark, n=12, confidence=0.9):
    rows = [(DAY, f"T{i:02d}", 10.0 + i, "BUY", confidence, 1e6 * (i + 1), 9.0 + i, 11.0 + i, 10.0 + i) for i in range(n)]
    return spark.createDataFrame(rows, "reference_date date, ticker string, close double, suggested_action string, confidence double, volume double, low double, high double, open double")


@pytest.mark.parametrize(("top_n", "rows"), [(None, 12), (7, 7), (5, 5), (0, 0)])
def test_signals_obey_top_n(spark, top_n, rows):
    cfg = sig.SignalConfig(top_n=top_n)
    assert sig.prediction_signals(predictions(spark), cfg).count() == rows
    daily = predictions(spark)
    assert sig.conditional_signals(daily, None, cfg).count() == rows


def test_hybrid_keeps_missing_confidence_and_scores_all(spark):
    df = predictions(spark, 8, None)
    cfg = sig.SignalConfig(top_n=None, allow_sell=False)
    got = sig.hybrid_signals(df, None, cfg, min_buy=0.01, heuristic_cap=None).collect()
    assert len(got) == 8 and all(0 < r.score <= 0.3 for r in got)
    assert sig.hybrid_signals(df, None, cfg, min_buy=0.01, heuristic_cap=3).count() == 3


def test_repeated_metrics_count_once(spark):
    metrics = spark.createDataFrame([("T01", "BUY", 0.2, 0.5, "2024-01-01"), ("T01", "BUY", 0.9, 3.0, "2023-01-01")], "ticker string, side string, win_rate double, profit_factor double, as_of_date string")
    got = sig.conditional_candidates(predictions(spark, 2), metrics, sig.SignalConfig(allow_sell=False)).where("ticker = 'T01'").collect()
    assert [r.win_rate for r in got] == [0.2]


def test_longer_horizons_are_an_error_not_a_loss(spark):
    signals = spark.createDataFrame(
        [("s", "x", "f", "v", "c", "A", "BUY", DAY, dt.datetime(2024, 1, 2), 10.0, 20.0, 5.0, 10)],
        "signal_id string, strategy_id string, strategy_family string, strategy_version string, config_version string, ticker string, side string, reference_date date, signal_timestamp timestamp_ntz,"
        " expected_entry_price double, target_price double, stop_price double, max_horizon_days int",
    )
    days = [(f"2024-01-{d:02d}",) for d in range(1, 25)]
    bars = spark.createDataFrame(days, "d string").select(F.lit("A").alias("ticker"), F.to_date("d").alias("session_date"), *[F.lit(10.0).alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    assert [r.exit_reason for r in bar.baseline_trade_outcomes(signals, bars, max_horizon=10).collect()] == ["expiration"]
    with pytest.raises(Exception, match="above max_horizon"):
        bar.baseline_trade_outcomes(signals, bars).collect()


def test_universe_and_pages_without_cap(spark):
    tickers = spark.createDataFrame([(f"A{i:03d}", True) for i in range(120)], "ticker string, active boolean")
    assert io.active_universe(tickers, ["IBOV"]).count() == 121
    assert io.active_universe(tickers, ["IBOV"], 50).count() == 50
    checks = spark.createDataFrame([(DAY, dt.datetime(2024, 1, 2), f"c{i}") for i in range(250)], "check_date date, created_at timestamp, check_name string")
    assert ops.ops_dq_latest(checks, DAY).count() == 200
    assert ops.ops_dq_latest(checks, DAY, limit=None).count() == 250


def test_portfolios_name_all_their_assets(spark):
    rows = [("m", "v", DAY, i, f"T{i}", 0.5, 0.1, 0.2) for i in range(1, 21)]
    ranking = spark.createDataFrame(rows, "ranking_model_id string, ranking_model_version string, reference_date date, ranking_position int, ticker string, final_score double, forward_return_5d double, estimated_risk double")
    assert len(rk.top_n_portfolios(ranking, (15,)).first().selected_tickers) == 15


def test_fold_rows_without_a_trial_id_stand_for_themselves(spark):
    schema = "trial_id string, fold_id string, trades long"
    old = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("", "c", 3), ("t", "d", 4)], schema)
    new = spark.createDataFrame([("t", "d", 9), (None, "a", 1)], schema)
    assert sorted((r.fold_id, r.trades) for r in gv.merge_fold_rows(old, new).collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 9)]


def test_missing_seeds_are_no_seed(spark):
    rows = [("f", None, "1", 0.1, 0.1, 0.1, 5, 1.0), ("f", 7, "2", 0.2, 0.1, 0.1, 5, 1.0), ("g", None, "1", 0.1, 0.1, 0.1, 5, 1.0)]
    folds = spark.createDataFrame(rows, "family string, seed int, fold_id string, delta_expectancy_vs_champion double, expectancy_net double, max_drawdown double, trades long, cost_multiplier double")
    assert {r.family: (r.seeds, r.stable_across_seeds) for r in ev.family_evaluation(folds, ["family"]).collect()} == {"f": (1, False), "g": (0, False)}


def test_entities_are_decoded(spark):
    pages = ["R$&#32;&#49;2,50", "&#x31;0.5&nbsp;<b>1</b>", "7 &lt;x&gt; &bogus; &amp;"]
    got = [r.t for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").orderBy("i").select(parsers._text(F.col("h")).alias("t")).collect()]
    assert got == ["R$ 12,50", "10.5 1", "7   &"]


def test_klines_of_two_intervals_and_a_replay(spark, tmp_path):
    path = str(tmp_path / "klines")
    handle = sq.upsert_klines(path, lambda: dt.datetime(2024, 1, 1))

    def kline(close_ms, volume):
        return json.dumps([0, "10", "11", "9", "10", volume, close_ms, "50", 3, "1", "1", "0"])

    schema = "exchange string, symbol string, interval string, kline string"
    first = [("X", "BTCUSDT", "1m", kline(59_999, "5")), ("X", "BTCUSDT", "1h", kline(3_599_999, "7")), ("Y", "BTCUSDT", "1m", kline(59_999, "8")), ("X", "BTCUSDT", "1m", kline(59_998, "4"))]
    handle(spark.createDataFrame(first, schema), 0)
    stored = lambda: sorted((r.exchange, r.interval, r.base_volume) for r in spark.read.parquet(path).collect())
    want = [("X", "1h", 7.0), ("X", "1m", 5.0), ("Y", "1m", 8.0)]
    assert stored() == want
    handle(spark.createDataFrame(first, schema), 0)
    assert stored() == want


def test_configuration_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(frames, "MOST_CONFIG_ROWS", 3)
    one = spark.range(2)
    assert frames.with_one_row(one, spark.range(3).withColumnRenamed("id", "k")).count() == 6
    with pytest.raises(Exception, match="more than 3 rows"):
        frames.with_one_row(one, spark.range(4).withColumnRenamed("id", "k")).count()


def test_daily_growth_gives_the_drawdown_of_the_path(spark):
    rows = [("a", f"2024-01-{d:02d}", f"t{i}", ((d * 7 + i * 5) % 11 - 5) / 50) for d in range(1, 15) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, day string, ticker string, r double")
    path = frames.equity_path(df, ["k"], "day", ["ticker"], "r").agg(F.max((F.col("peak") - F.col("equity")) / F.col("peak"))).first()[0]
    days = frames.daily_growth(df, ["k"], "day", ["ticker"], "r").agg(F.max("max_drawdown")).first()[0]
    assert abs(path - days) < 1e-12


def test_fold_rows_are_dealt_out_before_they_are_sorted(spark):
    rows = spark.createDataFrame([("t1", "f", 1), ("t1", "f", 2), ("", "g", 3), (None, "g", 3), (None, "h", 3)], "trial_id string, fold_id string, trades long")
    out = gv.merge_fold_rows(rows, rows.where("trades = 1").withColumn("trades", F.lit(9).cast("long")))
    assert sorted((r.trial_id or "", r.fold_id, r.trades) for r in out.collect()) == [("", "g", 3), ("", "g", 3), ("", "h", 3), ("t1", "f", 9)]
    below = out._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_COL")[-1]
    assert "Sort" not in below and "WindowGroupLimit" not in below
