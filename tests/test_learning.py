"""The weighted network, prediction rows, exact medians, checks inside plans, evidence out of JSON."""

import datetime as dt
import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import frames
from tickerloom.operators import dataset as ds
from tickerloom.operators import governance as gv
from tickerloom.operators import learning as ln

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        a, b = rng.normal(size=2)
        label = "up" if a * b > 0.4 else "down" if a * b < -0.6 else "neutral"
        rows.append((f"T{i % 7}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 7), dt.date(2024, 6, 3), "train" if i < 600 else "test", label, None if i % 50 == 3 else float(a), float(b), 10.0 + i, True))
    rows.append(("T9", dt.date(2024, 1, 1), dt.date(2024, 6, 3), "train", None, 1.0, 1.0, 5.0, False))
    shape = "ticker string, reference_date date, valid_for date, dataset_split string, label_class string, a double, b double, close double, has_zero_volume boolean"
    return spark.createDataFrame(rows, shape).repartition(5)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    x, target, weight = rng.normal(size=(30, 2)), rng.integers(0, 3, 30), rng.uniform(0.5, 2, 30)
    net = ln.Network.start(FEATURES, (4, 3), 7)
    grads, loss = net.gradient(x, target, weight)
    for layer, g in enumerate(grads):
        for at in [(0, 0), (2, -1), (1, 1)]:
            moved = net.matrices()
            moved[layer][at] += 1e-6
            slope = (ln.Network.of(FEATURES, moved).gradient(x, target, weight)[1] - loss) / 1e-6
            assert slope == pytest.approx(g[at], abs=1e-3)


def test_gradient_of_a_table_is_that_of_its_rows(spark):
    rng = np.random.default_rng(2)
    x, target, weight = rng.normal(size=(50, 2)), rng.integers(0, 3, 50), rng.uniform(0.5, 2, 50)
    rows = spark.createDataFrame([(a.tolist(), int(t), float(w)) for a, t, w in zip(x, target, weight)], "x array<double>, target int, weight double").repartition(7)
    net = ln.Network.start(FEATURES, (3,), 3)
    grads, loss, total = ln.weighted_gradient(rows, net)
    want, want_loss = net.gradient(x, target, weight)
    assert total == pytest.approx(weight.sum()) and loss == pytest.approx(want_loss / weight.sum())
    assert all(np.allclose(g, w / weight.sum()) for g, w in zip(grads, want))


def test_training_learns_what_no_line_can_and_minds_the_weights(spark, data):
    net, scaler = ln.train_classifier(data, FEATURES, hidden=(12,), steps=60, rate=0.3)
    assert net == ln.train_classifier(data, FEATURES, hidden=(12,), steps=60, rate=0.3)[0]
    scored = ln.score_predictions(net, scaler, data.where("label_class IS NOT NULL"), ln.ModelCard("m", "v", threshold=0.4))
    test = scored.where("dataset_split = 'test'").toPandas()
    best = test[["prob_down", "prob_neutral", "prob_up"]].to_numpy().argmax(axis=1)
    truth = test["label_class"].map({"down": 0, "neutral": 1, "up": 2}).to_numpy()
    assert (best == truth).mean() > 0.8 > (truth == np.bincount(truth).argmax()).mean()
    assert np.allclose(test[["prob_down", "prob_neutral", "prob_up"]].sum(axis=1), 1)
    weights = {r.label_class: r.weight for r in ln.class_weights(data.where("label_class IS NOT NULL")).collect()}
    counts = {r.label_class: r["count"] for r in data.where("label_class IS NOT NULL").groupBy("label_class").count().collect()}
    assert weights["up"] == pytest.approx(900 / (3 * counts["up"]) * 1.25) and weights["neutral"] == pytest.approx(900 / (3 * counts["neutral"]))


def test_scoring_equals_the_matrices(spark, data):
    net = ln.Network.start(FEATURES, (5,), 11)
    scaler = ds.fit_scaler(data, FEATURES)
    got = ln.class_probabilities(ds.apply_scaler(data, scaler, FEATURES), net).toPandas()
    x = got[FEATURES].to_numpy()
    first, last = net.matrices()
    z = np.maximum(x @ first[:, :-1].T + first[:, -1], 0) @ last[:, :-1].T + last[:, -1]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(got[["prob_down", "prob_neutral", "prob_up"]].to_numpy(), p)


def test_prediction_rows(spark, data):
    net, scaler = ln.Network.start(FEATURES, (), 0), ds.fit_scaler(data, FEATURES)
    card = ln.ModelCard("m", "v2", threshold=0.3, run_id="r", created_at=dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc))
    rows = ln.score_predictions(net, scaler, data, card, dt.date(2024, 7, 1))
    one = rows.where("ticker = 'T9'").first()
    assert (one.valid_for, one.model_version, one.suggested_action, one.decision_threshold, one.close, one.financial_volume) == (dt.date(2024, 7, 1), "v2", "BUY", 0.3, 5.0, None)
    assert json.loads(one.metadata_json) == {"flags": {"has_missing_ohlcv": False, "has_zero_volume": False, "is_suspicious_candle": False}, "history_days": None}
    snap = lambda df: {(r.reference_date, r.source_snapshot) for r in ln.score_predictions(net, scaler, df, card, dt.date(2024, 7, 1)).collect()}
    assert snap(data) == snap(data.repartition(2).orderBy(F.desc("b")))
    assert len(snap(data) & snap(data.where("NOT (ticker = 'T9')"))) == len(snap(data)) - 1
    assert rows.select("feature_snapshot").distinct().count() == 901
    with pytest.raises(Exception, match="another feature version"):
        ln.score_predictions(net, scaler, data.withColumn("feature_version", F.lit("old")), card).collect()
    assert ln.score_predictions(net, scaler, data.limit(0), card).count() == 0


def test_median_with_an_outlier(spark):
    """One value of 1e12 among many, which puts all others into one slice of equal width."""
    n = 300_001
    rows = spark.range(n).select(F.lit("k").alias("key"), F.when(F.col("id") == 5, 1e12).otherwise(F.pmod(F.col("id") * 7919, F.lit(n)) / 7.0).alias("value")).repartition(4)
    values = [1e12 if i == 5 else i * 7919 % n / 7.0 for i in range(n)]
    out = frames.exact_median(rows, ["key"], "value", "m")
    assert [r.m for r in out.collect()] == [statistics.median(values)]
    ends = rows.agg(F.percentile_approx("value", [0.5 - 2 / 2048, 0.5 + 2 / 2048], 2048)).first()[0]
    assert sum(ends[0] <= v <= ends[1] for v in values) < n * 6 / 2048


def test_median_of_small_and_even_groups(spark):
    groups = {"a": [3.0], "b": [1.0, 2.0], "c": [5.0] * 9 + [1.0], "d": [-1.0, None, 4.0, 1e300]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "key string, value double")
    got = {r.key: r.m for r in frames.exact_median(rows, ["key"], "value", "m").collect()}
    assert got == {k: statistics.median(v for v in vs if v is not None) for k, vs in groups.items()}


def test_building_a_walk_forward_plan_starts_no_job(spark):
    days = spark.range(20).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("reference_date"))
    cfg = ds.WalkForwardConfig(10, 2, 4, 3, 2, 4)
    spark.sparkContext.setJobGroup("plans", "built only")
    plan, split = ds.walk_forward_plan(days, cfg), ds.holdout_split(days, cfg)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    assert ds.walk_forward_plan(days.limit(0), cfg).count() == 0
    for late in (plan, split):
        with pytest.raises(Exception, match="not enough sessions"):
            late.collect()
    spark.sparkContext.setJobGroup("rest", "")


def test_evidence_levels(spark):
    fold = {"fold_id": "f1", "trades": 3, "delta_expectancy_vs_champion": 0.01}
    texts = {
        "none": {}, "odd": {"muen_economics": "x"}, "empty": {"muen_economics": {}}, "no_folds": {"muen_economics": {"seed": 1, "daily_returns": [{"ticker": "A", "reference_date": "2024-01-02"}]}},
        "no_rows": {"muen_economics": {"fold_metrics": []}}, "good": {"muen_economics": {"fold_metrics": [fold, {"trades": 1}], "daily_returns": [{}, {"ticker": "A", "reference_date": "x"}, {"ticker": "B", "reference_date": "2024-01-03", "protocol_version": "own"}]}},
        "stored": {"muen_economics": {"fold_metrics": [fold], "family_evaluation": {"total_trades": 50, "positive_folds": 5, "median_delta_expectancy_vs_champion": 0.1}}},
    }
    rows = [(m, json.dumps(t), "snap") for m, t in texts.items()] + [("null", None, "snap"), ("broken", "{", "snap")]
    registry = spark.createDataFrame(rows, "model_version string, metrics_json string, training_dataset_snapshot string")
    got = {r.model_version: (r.decision_status, r.failed_criteria) for r in gv.evaluate_candidate_evidence(registry).collect()}
    assert all(got[m] == ("blocked", ["muen_economics_missing"]) for m in ("none", "odd", "empty", "null", "broken"))
    assert got["no_folds"] == got["no_rows"] == ("blocked", ["fold_metrics_missing"])
    assert got["stored"] == ("rejected", ["stress_custo_ausente", "seeds_instaveis"]) and got["good"][0] == "rejected"
    daily = [(r.model_version, r.ticker, r.reference_date, r.protocol_version, r.dataset_snapshot) for r in gv.registry_daily_returns(registry).collect()]
    assert sorted(daily, key=str) == [("good", "A", None, gv.PROTOCOL, "snap"), ("good", "B", dt.date(2024, 1, 3), "own", "snap")]
    rejects = {(r.model_version, r.level, r.position, r.reason) for r in gv.registry_rejects(registry).collect() if r.model_version in ("good", "no_rows")}
    assert rejects == {("no_rows", "model", 0, "fold_metrics_missing"), ("good", "fold", 2, "fold_id_missing"), ("good", "daily_return", 1, "daily_return_empty"), ("good", "daily_return", 2, "reference_date_missing")}


def test_gate_limits(spark):
    row = {"profit_factor": 1.2, "win_rate": 0.6, "fill_rate": 0.5, "max_drawdown_pct": -0.1, "avg_return_pct": 0.01, "cost_sensitivity_pct": 0.1}
    df = spark.createDataFrame([{**row, "trade_count": 0, "trades": 40}, {**row, "trade_count": 20, "trades": 90}])
    assert [r.failed_criteria for r in gv.paper_gate(df).collect()] == [[], ["trade_count"]]
    assert [r.failed_criteria for r in gv.paper_gate(df, {"trade_count": 10, "profit_factor": 1.5}).collect()] == [["profit_factor"]] * 2
    assert gv.paper_gate(df.drop("trade_count", "win_rate")).first().failed_criteria == ["win_rate"]
    with pytest.raises(ValueError, match="no such limits"):
        gv.paper_gate(df, {"wins": 1})
    good = {"oos_profit_factor": 1.2, "oos_win_rate": 0.6, "paper_profit_factor": 1.2, "paper_win_rate": 0.6, "paper_days": 130, "paper_max_drawdown_pct": 0.05, "fill_rate": 0.5, "avg_abs_backtest_divergence_pct": 0.01, "trade_count": 60}
    some = spark.createDataFrame([{**good, "approvals": ["a"]}, {**good, "approvals": [" "]}])
    assert [r.failed_criteria for r in gv.promotion_gate(some).collect()] == [[], ["explicit_approval"]]
    assert [r.failed_criteria for r in gv.promotion_gate(some, limits={"paper_days": 140}, require_approval=False).collect()] == [["paper_days"]] * 2


def test_named_price_containers(spark):
    from tickerloom.sources import parsers

    box = '<div jsname="ip75Cb" class="q">{}</div>'
    pages = [
        box.format('<span class="a YMlKec b">1&#8211;2 R$ 3,50</span>'), box.format("<i class='YMlKec'> </i>") + box.format("<i class='YMlKec'>7.5</i>"),
        box.format('<i class="xYMlKec">1</i>'), "<div jsname='other'><i class='YMlKec'>1</i></div>", box.format("<i class='YMlKec\">1</i>"), '<div jsname="ip75Cb"><i class="YMlKec">9', "", None,
        box.format('<i class="YMlKec"><b>no</b></i><i class="YMlKec">4.25</i>'),
    ]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").orderBy("i").select(parsers._first_text(parsers._named_texts(F.col("h"))).alias("t")).collect()
    assert [r.t for r in got] == ["1–2 R$ 3,50", "7.5", None, None, None, None, None, None, "4.25"]
