"""A sample of registered queries against their DuckDB SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import canon

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "intraday_candles_15m", "session_shifts", "ticker_coverage", "indicators", "baseline_trade_outcomes",
    "barrier_outcomes", "backtest_metrics", "conditional_signals", "ranking_performance", "oos_summary",
    "barrier_labels", "training_runs", "champion_approval_checks", "evaluate_candidate_evidence", "parse_cotahist",
    "upsert_daily", "stream_candles_15m", "merge_signals", "late_quotes_raw", "late_quotes_candles", "kline_batches", "key_scan",
    "archive_lines", "score_predictions", "train_classifier", "registry_daily_returns", "registry_rejects", "candidate_evidence_gaps",
    "gate_decision_id", "legacy_fold_rekey", "source_snapshot", "dq_results", "incident_texts", "paper_gate_limits",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    got = canon(entry.queries()[name](spark, SF).toArrow())
    want = canon(duck.sql(entry.oracle_sql()[name]).to_arrow_table())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
