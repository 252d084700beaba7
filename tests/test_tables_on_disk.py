"""Partitioned tables: pruning, windowed merge, replayed and late batches, the end of a stream; the entry without its corpus part."""

import datetime as dt
import glob
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import candles as cdl
from tickerloom.sources import io
from tickerloom.streaming import quotes as sq

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DAY = "2024-05-06"
QUOTES = "ticker string, quote_date date, quote_time string, price double, seq long, captured_at timestamp_ntz"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 5).alias("k"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 40).cast("int")).alias("d"), "id")
    path = str(tmp_path / "t")
    io.append(rows.repartition("d"), path, ["d"], ["k"])
    return spark.read.parquet(path)


def test_scans_prune_partitions(spark, table, tmp_path, monkeypatch):
    one = io.partition_scan(table, "d", dt.date(2024, 1, 7), ["id"])
    plan = executed(one)
    assert "PartitionFilters: [isnotnull(d" in plan and "(d#" in plan.split("PartitionFilters")[1] and one.count() == 10
    assert "ReadSchema: struct<id:bigint>" in plan
    span = io.range_scan(table, "d", dt.date(2024, 1, 3), dt.date(2024, 1, 4))
    assert "(d#" in executed(span).split("PartitionFilters")[1].split("PushedFilters")[0] and span.count() == 20
    assert io.range_scan(table, "d", None, dt.date(2024, 1, 1)).count() == 10 and io.range_scan(table, "d").count() == 400
    assert io.partition_scan(table, "d", None).count() == 0
    listed = io.key_scan(table, [2, None], "k", ["k"])
    assert "PushedFilters: [In(k" in executed(listed) or "EqualTo(k" in executed(listed)
    assert listed.count() == 80
    days = spark.createDataFrame([(dt.date(2024, 1, 2), 1), (dt.date(2024, 1, 9), 1), (dt.date(2024, 1, 5), 0), (None, 1)], "d date, wanted int")
    days.write.parquet(f"{tmp_path}/days")
    met = io.key_scan(table, spark.read.parquet(f"{tmp_path}/days").where("wanted = 1"), "d")
    assert "dynamicpruning" in executed(met) and met.count() == 20
    named = io.touched(table, days, "d")
    assert "d#" in executed(named).split("PartitionFilters")[1].split("PushedFilters")[0] and named.count() == 30
    monkeypatch.setattr(io, "MOST_NAMED_PARTITIONS", 2)
    assert io.touched(table, days, "d").count() == 30


def test_merge_leaves_old_and_untouched_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "signals")
    shape = "signal_id string, strategy_id string, score int, day date"
    stored = [("old", "a", 1, dt.date(2023, 1, 10)), ("same", "a", 1, dt.date(2024, 5, 6)), ("rest", "a", 1, dt.date(2024, 5, 6)), ("far", "a", 1, dt.date(2024, 5, 7))]
    io.append(spark.createDataFrame(stored, shape), path, ["day"])
    stamp = lambda: {p: (os.stat(p).st_mtime_ns, os.stat(p).st_ino) for p in glob.glob(f"{path}/day=*/*.parquet")}
    before = stamp()
    new = [("old", "b", 2, dt.date(2023, 1, 10)), ("same", "b", 2, dt.date(2024, 5, 6)), ("same", "b", 3, dt.date(2024, 5, 6)), ("new", "b", 2, dt.date(2024, 5, 8)), ("later", "b", 2, dt.date(2024, 7, 1))]
    for _ in range(2):
        io.merge_recent(spark, path, spark.createDataFrame(new, shape), ["signal_id"], "day", dt.date(2024, 6, 1), 365, [F.desc("score")], ["strategy_id"])
        got = {(r.signal_id, r.strategy_id, r.score) for r in spark.read.parquet(path).collect()}
        assert got == {("old", "a", 1), ("same", "a", 3), ("rest", "a", 1), ("far", "a", 1), ("new", "b", 2), ("later", "b", 2)}
    untouched = [p for p in before if "2023-01-10" in p or "2024-05-07" in p]
    assert len(untouched) == 2 and all(stamp()[p] == before[p] for p in untouched)
    assert not [p for p in before if "2024-05-06" in p and p in stamp()]
    assert not glob.glob(f"{io.checkpoint_dir(spark)}/upsert-*")
    io.merge_recent(spark, path, spark.createDataFrame([], shape), ["signal_id"], "day", dt.date(2024, 6, 1))
    assert spark.read.parquet(path).count() == 6


def quotes(spark, rows):
    full = [(t, dt.date.fromisoformat(DAY), at, p, n, dt.datetime.fromisoformat(f"{DAY} {seen}")) for t, at, p, n, seen in rows]
    return spark.createDataFrame(full, QUOTES)


def test_replayed_batches_add_nothing(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "candles")
    handle = sq.rebuild_days(raw, out)
    handle(quotes(spark, [("T", "10:00:00", 1.0, 1, "10:00:01"), ("T", "10:05:00", 2.0, 2, "10:05:01")]), 0)
    late = quotes(spark, [("T", "10:05:00", 5.0, 9, "10:20:00"), ("T", "10:05:00", 7.0, 10, "10:10:00"), ("T", "10:01:00", 3.0, 3, "10:01:00")])
    for _ in range(3):
        handle(late, 1)
        assert spark.read.parquet(raw).groupBy("batch").count().orderBy("batch").collect() == [("quotes-0", 2), ("quotes-1", 3)]
        assert [(r.open, r.high, r.close, r.samples) for r in spark.read.parquet(out).collect()] == [(1.0, 5.0, 5.0, 3)]
    sq.rebuild_days(raw, out, "other")(quotes(spark, [("U", "10:00:00", 4.0, 1, "10:00:00")]), 0)
    assert spark.read.parquet(raw).count() == 6 and spark.read.parquet(out).count() == 2


def test_a_heartbeat_closes_the_last_buckets(spark, tmp_path):
    rows = [("T", f"{10 + i // 12:02d}:{i % 12 * 5:02d}:00", float(i % 7), i, "20:00:00") for i in range(40)]
    rows += [("T", "10:15:00", 50.0, 2, "19:00:00"), ("T", "10:15:00", 60.0, 1, "21:00:00")]  # older, then newer capture
    src = quotes(spark, rows)
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    beats = sq.clock(spark, str(tmp_path / "clock"))
    stream = sq.stream_quotes(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), beats=beats)
    candles = sq.finish_candles(sq.stream_candles(stream))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sq.run_to_table(candles, out, state)
    assert spark.read.parquet(out).count() < 14
    for hour in (20, 23):
        sq.heartbeat(spark, str(tmp_path / "clock"), dt.datetime(2024, 5, 6, hour, tzinfo=dt.timezone.utc))
        sq.run_to_table(candles, out, state)
    cols = ["ticker", "candle_at", "open", "high", "low", "close", "samples"]
    got = [tuple(r) for r in spark.read.parquet(out).select(*cols).orderBy("candle_at").collect()]
    newest = src.where("NOT (quote_time = '10:15:00' AND captured_at < TIMESTAMP_NTZ'2024-05-06 21:00:00')")
    assert got == [tuple(r) for r in cdl.build_intraday_candles(newest).select(*cols).orderBy("candle_at").collect()] and len(got) == 14


def test_entry_without_the_corpus_part(tmp_path):
    """The registry imports, and an empty folder is no package, when the corpus operators and their pipeline are absent."""
    copy = str(tmp_path / "copy")
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(HERE, copy, ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'barrier_outcomes' in q; print(sorted(n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run().stdout.strip() == "[]", run().stderr
    os.makedirs(f"{copy}/tickerloom/llm")
    if os.path.exists(f"{HERE}/corpus_pipeline.py"):
        shutil.copy(f"{HERE}/corpus_pipeline.py", copy)
    assert run().stdout.strip() == "[]", run().stderr


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.checkpoint_dir(Session)
    Session.conf["spark.master"] = "local[2]"
    assert os.path.isdir(io.checkpoint_dir(Session))


def test_kline_stamps(spark):
    from tickerloom.sources import parsers

    raw = spark.createDataFrame([("BTCUSDT", '[0,"10","11","9","10","5",59999,"50",3,"1","1","0"]', None, "1h")], "symbol string, kline string, exchange string, interval string")
    row = parsers.normalize_klines(raw, dt.datetime(2024, 1, 1), "X", "1m", "feed", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), "r1")[0].first()
    assert (row.exchange, row.interval, row.source, row.job_run_id) == ("X", "1h", "feed", "r1") and row.ingested_at.year == 2024
