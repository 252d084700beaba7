"""Rolling features put together from slices of five rows, against plain arithmetic; stored and unread inputs of decisions."""

import datetime as dt
import statistics

import pytest

from tickerloom.operators import dataset as ds
from tickerloom.operators import indicators as ind
from tickerloom.plans import catalog
from tickerloom.plans import registry

DAY = dt.date(2024, 1, 1)


def candles(spark, closes, volumes):
    rows = [("A", DAY + dt.timedelta(i), c, c + 1 + i % 7, c - 1 - i % 5, c, v) for i, (c, v) in enumerate(zip(closes, volumes))]
    return spark.createDataFrame(rows, "ticker string, session_date date, open double, high double, low double, close double, volume double")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rolling_values(spark):
    closes = [100 + (i * 37 % 23) * 0.7 for i in range(90)]
    volumes = [float(50 + i * 13 % 17) for i in range(90)]
    volumes[70] = None
    rows = ind.eod_feature_table(candles(spark, closes, volumes), 1).orderBy("reference_date").collect()
    returns = [None] + [b / a - 1 for a, b in zip(closes, closes[1:])]
    for i, r in enumerate(rows):
        for n in (5, 10, 20, 60):
            part = returns[max(0, i - n + 1) : i + 1]
            want = statistics.stdev(part) if len(part) == n and None not in part else None
            assert r[f"volatility_{n}d"] == (want if want is None else pytest.approx(want, rel=1e-9)), (i, n)
        for n in (20, 60):
            top = max(c + 1 + j % 7 for j, c in enumerate(closes) if i - n < j <= i) if i >= n - 1 else None
            assert r[f"distance_high_{n}d_pct"] == (top if top is None else pytest.approx((closes[i] - top) / closes[i]))
        sma = sum(closes[i - 49 : i + 1]) / 50 if i >= 49 else None
        assert r.distance_sma_50d_pct == (sma if sma is None else pytest.approx((closes[i] - sma) / closes[i]))
        known = i >= 19 and not i - 19 <= 70 <= i
        assert (r.volume_ratio_20d is not None) == known


def test_equal_values_have_no_spread(spark):
    rows = ind.eod_feature_table(candles(spark, [0.1] * 70, [0.7] * 70), 61).collect()
    assert {(r.volatility_60d, r.financial_volume_z20) for r in rows} == {(0.0, None)}


def test_frames_stay_short(spark):
    """Each row adds up at most five others, and the arrays of next bars are made after the features."""
    bars = candles(spark, [1.0], [1.0])
    plan = plan_of(ind.eod_feature_table(bars))
    assert "RowFrame, -4, currentrow$()" in plan
    assert not any(f"RowFrame, -{n}, currentrow$()" in plan for n in (9, 19, 49, 59))
    plan = plan_of(ds.training_dataset(bars))
    assert plan.index("collect_list") < plan.index("RowFrame, -4, currentrow$()")  # the top of a plan comes first


def test_rounding(spark):
    values = [0.123456789, -0.123456749, 1e6 + 0.12345678, 123456789012.345, float("nan"), None, -0.0, 2.5e-8]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.x for r in df.select(registry._SPARK["d"]("x").alias("x")).collect()]
    assert got[:4] == [0.1234568, -0.1234567, 1000000.1234568, 123456789012.345]
    assert str(got[4]) == "nan" and got[5] is None and str(got[6]) == "0.0" and got[7] == 0.0


def test_decisions_read_what_they_need(spark):
    """Labels and class counts need no champion; the budget reads stored rows."""
    sf = "/root/testdata/sf0.001"
    for name in ("ticker_blocklist", "classification_metrics"):
        assert "trade:" not in plan_of(catalog.QUERIES[name](spark, sf)), name
    for name in ("fold_trade_budget", "champion_overlap"):
        plan = plan_of(catalog.QUERIES[name](spark, sf))
        assert "l_suppkey" not in plan, name


def test_decisions_make_bars_once(spark):
    """Rows are stored before they are split, so the dates of the splits do not make the bars a second time."""
    for name in ("ticker_blocklist", "classification_metrics", "regime_liquidity_filter", "neutral_extreme_event_filter", "directional_labels"):
        assert "l_suppkey" not in plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")), name
