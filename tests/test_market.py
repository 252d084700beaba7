"""Candles, calendar, parsers, sinks and the streaming handlers on literal cases."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import calendar as cal
from tickerloom.operators import candles as cdl
from tickerloom.operators import indicators as ind
from tickerloom.operators import signals as sig
from tickerloom.sources import io, parsers
from tickerloom.streaming import quotes as sq

QUOTES = [("aaaa3", "2024-05-06", "10:00:00", 10.0, 1), ("AAAA3 ", "2024-05-06", "10:05:00", 10.5, 2),
          ("AAAA3", "2024-05-06", "10:18:00", 11.0, 3), ("AAAA3", "2024-05-06", "bad", 11.0, 4)]
QUOTE_SCHEMA = "ticker string, quote_date string, quote_time string, price double, seq int"


def test_intraday_candles_and_rollup(spark):
    df = cdl.build_intraday_candles(spark.createDataFrame(QUOTES, QUOTE_SCHEMA))
    first, second = df.orderBy("candle_at").collect()
    assert (first.open, first.high, first.close, first.samples, first.flags) == (10.0, 10.5, 10.5, 2, ["NO_VOLUME_SOURCE"])
    assert second.flags == ["NO_VOLUME_SOURCE", "SINGLE_QUOTE_BUCKET"]
    hour = cdl.rollup_candles(df).collect()
    assert len(hour) == 1 and (hour[0].open, hour[0].close, hour[0].flags) == (10.0, 11.0, ["ROLLED_UP"])


def test_timeframe_aliases(spark):
    df = spark.createDataFrame([("M15",), (" d ",), ("",), (None,), ("5m",)], "t string")
    assert [r[0] for r in df.select(cdl.timeframe(F.col("t"))).collect()] == ["15m", "1D", "1D", "1D", "5m"]


def test_sessions_skip_holidays(spark):
    bounds = spark.createDataFrame([(dt.date(2023, 12, 20), dt.date(2024, 1, 10))], "first_day date, last_day date")
    off = spark.createDataFrame([(dt.date(2024, 1, d), True) for d in (1, 2)], "holiday_date date, active boolean")
    k = cal.trading_calendar(bounds, off)
    day = spark.createDataFrame([(dt.date(2023, 12, 29),), (dt.date(2023, 12, 30),)], "day date")
    out = cal.previous_session(cal.next_session(cal.add_sessions(day, "day", 0, k, "same"), "day", k), "day", k)
    fri, sat = out.orderBy("day").collect()
    assert fri.next_session == sat.next_session == sat.same == dt.date(2024, 1, 3)
    assert fri.same == dt.date(2023, 12, 29)
    assert (fri.previous_session, sat.previous_session) == (dt.date(2023, 12, 28), dt.date(2023, 12, 29))


def daily_line(factor=1):
    body = ["01", "20240506", "02", "NTCO3".ljust(12), "010".ljust(32)]
    body += [f"{round(p * 100):013d}" for p in (17.16, 17.51, 17.12)] + ["0" * 13, f"{1727:013d}", "0" * 26]
    return "".join(body) + "15390" + f"{5800800:018d}" + f"{10053902100:018d}" + "0" * 22 + f"{factor:07d}"


@pytest.mark.parametrize("factor", [1, 10])
def test_daily_lines(spark, factor):
    lines = spark.createDataFrame([(daily_line(factor),), ("99" + daily_line()[2:],)], "value string")
    row = parsers.parse_daily_lines(lines, ["ntco3"]).collect()
    assert len(row) == 1
    assert (row[0].open, row[0].close) == pytest.approx((17.16 / factor, 17.27 / factor))
    assert (row[0].volume, row[0].trades, row[0].session_date) == (5800800, 15390, dt.date(2024, 5, 6))
    assert parsers.parse_daily_lines(lines, ["OTHER"]).count() == 0


def test_unzip_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("DAY.TXT", daily_line() + "\r\n" + daily_line())
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.md", "x")
    rows = parsers.unzip_lines(spark, str(tmp_path), "OTHER.TXT").collect()
    assert len(rows) == 3 and sum(r.value is None for r in rows) == 1
    assert {r.missing_file for r in rows} == {"OTHER.TXT"}


def kline(open_ms, low="9", volume="5", n=12):
    return json.dumps([open_ms, "10", "12", low, "11", volume, open_ms + 899999, "50", 3, "1", "2", "0"][:n])


def test_klines(spark):
    rows = [("BTCUSDT", kline(0)), ("ETHBTC", kline(10**13)), ("ETHBRL", kline(0, "13", "-1")), ("BTCUSDT", kline(0, n=10)), ("BRL", kline(0))]
    good, bad = parsers.normalize_klines(spark.createDataFrame(rows, "symbol string, kline string"), dt.datetime(2024, 1, 1))
    got = {r.symbol: r for r in good.collect()}
    assert set(got) == {"BTCUSDT", "ETHBRL"} and bad.count() == 2
    assert (got["BTCUSDT"].base_asset, got["BTCUSDT"].quote_asset, got["BTCUSDT"].flags) == ("BTC", "USDT", [])
    assert got["ETHBRL"].flags == ["INVALID_OHLC_RANGE", "NEGATIVE_VOLUME"]


def test_page_price(spark):
    pages = [
        ("PETR4", '<div class="x YMlKec fxKbKc">R$31.79</div>', 31.79),
        ("A", '<div data-last-price="-"></div>{"price":{"raw":1,234.5}}', 1234.5),
        ("B", '<div jsname="ip75Cb" class="q"><div class="YMlKec">R$ 10,50</div></div>', 10.5),
        ("C", "<title>c - Google Finance</title><div data-last-price='7'></div>", None),
        ("D", "<p>nothing</p>", None),
    ]
    df = spark.createDataFrame([p[:2] for p in pages], "ticker string, html string")
    got = {r.ticker: r.price for r in parsers.extract_page_price(df).collect()}
    assert got == {p[0]: p[2] for p in pages}


def test_upsert_and_partition_rewrite(spark, tmp_path):
    schema = "k int, d date, v string, c string"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    table = spark.createDataFrame([(1, d1, "a", "old"), (2, d2, "b", "old")], schema)
    new = spark.createDataFrame([(2, d2, "x", "new"), (2, d2, "y", "new"), (3, d2, "z", "new")], schema)
    out = io.upsert(table, new, ["k", "d"], [F.desc("v")], ["c"])
    assert {(r.k, r.v, r.c) for r in out.collect()} == {(1, "a", "old"), (2, "y", "old"), (3, "z", "new")}
    path = str(tmp_path / "t")
    io.append(table, path, ["d"], ["k"])
    io.upsert_partitions(spark, path, new, ["k"], "d", [F.desc("v")])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    io.replace_partitions(new.where("k = 3"), path, ["d"])
    assert {r.k for r in spark.read.parquet(path).collect()} == {1, 3}
    assert io.has_rows(spark.read.parquet(path), F.col("k") == 3)


def test_late_quotes_rebuild_their_day(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "candles")
    handle = sq.rebuild_days(raw, out)
    df = spark.createDataFrame(QUOTES[:3], QUOTE_SCHEMA).withColumn("quote_date", F.to_date("quote_date"))
    handle(df.where("seq < 3"), 0)
    late = df.where("seq = 3").unionByName(df.where("seq = 1"))
    handle(late, 1)
    handle(late, 1)  # a replay changes nothing
    rows = spark.read.parquet(out).orderBy("candle_at").collect()
    assert [(r.open, r.close, r.samples) for r in rows] == [(10.0, 10.5, 2), (11.0, 11.0, 1)]


def test_stream_equals_batch_on_closed_buckets(spark, tmp_path):
    day = "2024-05-06"
    quotes = [("T", day, f"{10 + i // 12:02d}:{i % 12 * 5:02d}:00", float(i % 7), i) for i in range(40)]
    quotes += [quotes[3], ("T", day, "16:00:00", 1.0, 99)]
    src = spark.createDataFrame(quotes, QUOTE_SCHEMA)
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    candles = sq.finish_candles(sq.stream_candles(sq.stream_quotes(stream)))
    sq.run_to_table(candles, str(tmp_path / "out"), str(tmp_path / "state"))
    cols = ["ticker", "candle_at", "open", "high", "low", "close", "samples"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()}
    batch = cdl.build_intraday_candles(src.dropDuplicates()).where("candle_at < TIMESTAMP_NTZ'2024-05-06 15:30:00'")
    assert got == {tuple(r) for r in batch.select(*cols).collect()} and len(got) == 14


def test_closed_klines_are_upserted(spark, tmp_path):
    path = str(tmp_path / "k")
    handle = sq.upsert_klines(path, lambda: dt.datetime(2024, 1, 1))
    schema = "symbol string, kline string"
    handle(spark.createDataFrame([("BTCUSDT", kline(0)), ("BTCUSDT", kline(900000))], schema), 0)
    handle(spark.createDataFrame([("BTCUSDT", kline(0, volume="6"))], schema), 1)
    got = {r.event_time.timestamp(): r.base_volume for r in spark.read.parquet(path).collect()}
    assert got == {0.0: 6.0, 900.0: 5.0}


def test_mean_reversion_rule(spark):
    row = dict(ticker="A", reference_date=dt.date(2024, 1, 2), open=95.0, close=96.0, sma_20=97.0, sma_50=90.0, rsi_14=30.0,
               return_3d=-0.05, return_5d=0.0, return_20d=0.1, relative_volume_20d=1.0, financial_volume=1e6,
               avg_volume_20d=1e6, prior_high_20d=110.0, prior_close=100.0, gap_pct=-0.05)
    got = {r.strategy_family: r for r in sig.baseline_signals(spark.createDataFrame([row])).collect()}
    assert set(got) == {"reversao_media_diaria", "ranking_forca_relativa"}
    hit = got["reversao_media_diaria"]
    assert (hit.target_price, hit.ranking_score) == pytest.approx((96 * 1.03, 0.05))
    assert hit.signal_id == "baseline_daily_mean_reversion_v1:A:2024-01-02:BUY"


def test_conditional_signals_limits_and_levels(spark):
    day = dt.date(2024, 1, 2)
    rows = [(day, f"T{i}", 99.0, 100.0, 1e6 * (i + 1)) for i in range(6)]
    df = spark.createDataFrame(rows, "reference_date date, ticker string, open double, close double, financial_volume double")
    out = sig.conditional_signals(df, None, sig.SignalConfig(x_pct=0.05, target_pct=0.2, stop_pct=0.1)).orderBy("rank").collect()
    assert len(out) == 5 and len({r.ticker for r in out}) == 5 and out[0].ticker == "T5"
    assert (out[0].side, out[0].entry, out[0].target, out[0].stop) == ("SELL", 105.0, 84.0, 115.5)
    assert sig.conditional_signals(df, None, sig.SignalConfig(top_n=0)).count() == 0
    with pytest.raises(ValueError):
        sig.SignalConfig(target_pct=0)


def test_prediction_signals_filter(spark):
    day = dt.date(2024, 1, 2)
    rows = [(day, "A", 10.0, "BUY", 0.65), (day, "B", 10.0, "HOLD", 0.9), (day, "C", 10.0, "SELL", 0.55)]
    df = spark.createDataFrame(rows, "reference_date date, ticker string, close double, suggested_action string, confidence double")
    assert [(r.ticker, r.rank) for r in sig.prediction_signals(df).collect()] == [("A", 1)]


def test_return_windows_count(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "ticker string, session_date date, close double")
    assert ind.return_windows(df, 20, 5, 0.01).count() == 60 - 5 - 20
