"""Queries over tables that are partitioned on disk: scans, merges, late and replayed batches."""

from __future__ import annotations

import datetime as dt
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import candles as cdl
from ..sources import archives, io, parsers
from ..streaming import quotes as sq
from .registry import query
from .shared import shared
from .signal_queries import baseline_of
from .source_queries import daily_lines, klines
from .tables import Tables


def new_path(t: Tables, name: str) -> str:
    return f"{io.checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@shared
def bars_by_day(t: Tables):
    """The bars as a table on disk: one folder per session, sorted by ticker inside."""
    path = new_path(t, "bars_by_day")
    io.append(t.bars.repartition("session_date"), path, ["session_date"], ["ticker"])
    return t.spark.read.schema(t.bars.schema).parquet(path)


@query("partition_scan", "ticker close:d volume:d", "SELECT * FROM bars WHERE session_date = DATE '2024-03-05'", "bars")
def _partition(t: Tables):
    return io.partition_scan(bars_by_day(t), "session_date", dt.date(2024, 3, 5), ["ticker", "close", "volume"])


@query(
    "range_scan", "ticker session_date open:d close:d",
    "SELECT * FROM bars WHERE session_date BETWEEN DATE '2024-03-04' AND DATE '2024-06-28'", "bars",
)
def _range(t: Tables):
    return io.range_scan(bars_by_day(t), "session_date", dt.date(2024, 3, 4), dt.date(2024, 6, 28), ["ticker", "session_date", "open", "close"])


@query(
    "key_scan", "ticker session_date close:d",
    """SELECT * FROM bars WHERE session_date IN (SELECT holiday_date FROM holidays WHERE active)
       AND ticker IN (SELECT ticker FROM tickers WHERE active)""", "bars holidays tickers",
)
def _keys(t: Tables):
    """Both kinds of key: days, which prune partitions at run time, and tickers, which are joined."""
    days = t.holidays.where("active").withColumnRenamed("holiday_date", "session_date")
    return io.key_scan(io.key_scan(bars_by_day(t), days, "session_date"), t.tickers.where("active"), "ticker", ["ticker", "session_date", "close"])


MERGE_DAY = dt.date(2025, 6, 30)  # its window opens on 2024-06-30


@query(
    "merge_signals",
    "signal_id strategy_id ticker reference_date side target_price:d ranking_score:d created_at",
    """SELECT signal_id, CASE WHEN reference_date < DATE '2024-10-01' THEN 'first' ELSE 'view' END AS strategy_id, ticker, reference_date, side, target_price,
              ranking_score + CASE WHEN reference_date >= DATE '2024-06-30' THEN 1 ELSE 0 END AS ranking_score,
              CASE WHEN reference_date >= DATE '2024-06-30' THEN 'merged' ELSE 'stored' END AS created_at
       FROM bsignals WHERE reference_date < DATE '2024-10-01' OR reference_date >= DATE '2024-06-30'""",
    "bsignals",
)
def _merge(t: Tables):
    """The contract table holds signals up to September; the view repeats all with another score."""
    cols = ["signal_id", "strategy_id", "ticker", "side", "target_price", "ranking_score", "created_at", "reference_date"]
    rows = baseline_of(t)
    stored = rows.where("reference_date < DATE'2024-10-01'").withColumns({"created_at": F.lit("stored"), "strategy_id": F.lit("first")})
    view = rows.withColumns({"created_at": F.lit("merged"), "strategy_id": F.lit("view"), "ranking_score": F.col("ranking_score") + 1})
    path = new_path(t, "signals")
    io.append(stored.select(*cols).repartition("reference_date"), path, ["reference_date"])
    io.merge_recent(t.spark, path, view.select(*cols), ["signal_id"], "reference_date", MERGE_DAY, keep_from_target=["strategy_id"])
    return t.spark.read.schema(stored.select(*cols).schema).parquet(path)


# ------------------------------------------------------------------ micro-batches

@shared
def delivered(t: Tables):
    """(raw table, candle table) after two batches, the second of late quotes, which is replayed twice."""
    raw, candles = new_path(t, "raw_quotes"), new_path(t, "candles")
    handle = sq.rebuild_days(raw, candles)
    late = (F.col("seq") % 10 == 3) | ((F.col("seq") % 7 == 1) & (F.dayofmonth("quote_date") % 4 == 0))
    handle(t.quotes.where(~late), 0)
    for _ in range(3):
        handle(t.quotes.where(late), 1)
    return raw, candles


@query(
    "late_quotes_raw", "quote_date batch rows:n first_seq:n",
    """SELECT quote_date, CASE WHEN seq % 10 = 3 OR (seq % 7 = 1 AND day(quote_date) % 4 = 0) THEN 'quotes-1' ELSE 'quotes-0' END AS batch,
              count(*) AS rows, min(seq) AS first_seq FROM quotes GROUP BY ALL""", "quotes",
)
def _late_raw(t: Tables):
    raw = t.spark.read.parquet(delivered(t)[0])
    return raw.groupBy("quote_date", "batch").agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq"))


@query(
    "late_quotes_candles", "ticker candle_at open:d high:d low:d close:d samples:n data_quality_flags",
    "SELECT *, array_to_string(flags, ',') AS data_quality_flags FROM newest_candles", "newest_candles",
)
def _late_candles(t: Tables):
    return t.spark.read.parquet(delivered(t)[1])


@query(
    "kline_batches",
    "exchange symbol interval event_date base_volume:d source ingested_at job_run_id",
    """SELECT unnest(['X', 'X', 'Y']) AS exchange, ticker || quote_asset AS symbol, unnest(['1d', '1h', '1d']) AS interval, session_date AS event_date,
              volume * CASE WHEN trades % 6 = 0 THEN -1 ELSE 1 END AS base_volume, 'feed' AS source,
              CASE WHEN session_date >= DATE '2024-07-01' THEN TIMESTAMP '2024-11-02 00:00:00' ELSE TIMESTAMP '2024-11-01 00:00:00' END AS ingested_at,
              CASE WHEN session_date >= DATE '2024-07-01' THEN 'run-1' ELSE 'run-0' END AS job_run_id
       FROM kline_rows WHERE whole AND session_date < DATE '2024-11-01'""",
    "kline_rows",
)
def _kline_batches(t: Tables):
    """Klines of two exchanges and two intervals in two batches that overlap, the second one replayed."""
    kinds = F.array(*[F.struct(F.lit(e).alias("exchange"), F.lit(i).alias("interval")) for e, i in (("X", "1d"), ("X", "1h"), ("Y", "1d"))])
    day = F.timestamp_millis(F.get(F.from_json("kline", "array<string>"), F.lit(0)).cast("long")).cast("date")
    rows = io.cut(klines(t), "klines").withColumns({"kind": F.explode(kinds), "day": day}).select("symbol", "kline", "kind.*", "day")
    path = new_path(t, "klines")
    for n, part in enumerate([rows, *[rows.where("day >= DATE'2024-07-01'")] * 2]):
        now = dt.datetime(2024, 11, 1 + min(n, 1))
        handle = sq.upsert_klines(path, lambda: dt.datetime(2024, 11, 1), source="feed", ingested_at=now, run_id=f"run-{min(n, 1)}")
        handle(part.drop("day"), min(n, 1))
    return t.spark.read.parquet(path).withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))


# ------------------------------------------------------------------ archives


def _pack(folder: str):
    """Function of one session's lines that writes them as an archive, among other members."""

    def pack(key, lines):
        store, path = archives.store_of(folder)
        store.create_dir(path, recursive=True)
        day, month = key[0], key[0][:6]
        with store.open_output_stream(f"{path}/{day}.zip") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            if month != "202405":
                archive.writestr("A_NOTES.TXT" if month != "202407" else "notes.md", "01 not a price line\r\n")
            archive.writestr("OTHER.TXT" if month == "202405" else "DAY.TXT", "\r\n".join(lines["value"]) + "\r\n", compresslevel=1)
        return pd.DataFrame({"day": [day], "lines": [len(lines)]})

    return pack


@query(
    "archive_lines",
    "month member missing_file ticker session_date open:d close:d volume:d",
    """SELECT strftime(session_date, '%Y%m') AS month, CASE WHEN strftime(session_date, '%Y%m') = '202405' THEN 'OTHER.TXT' ELSE 'DAY.TXT' END AS member,
              CASE WHEN strftime(session_date, '%Y%m') = '202405' THEN 'DAY.TXT' END AS missing_file, ticker, session_date, open, close, volume FROM bars""",
    "bars",
)
def _archives(t: Tables):
    """The daily lines as one archive a session, some with other text first, one without the expected member."""
    folder = new_path(t, "archives")
    lines = daily_lines(t).withColumn("day", F.substring("value", 3, 8))
    lines.groupBy("day").applyInPandas(_pack(folder), "day string, lines long").agg(F.sum("lines")).collect()
    read = archives.read_archives(t.spark, folder, "DAY.TXT")
    return parsers.parse_daily_lines(read).withColumn("month", F.regexp_extract("path", r"(\d{6})\d\d\.zip$", 1))


# ------------------------------------------------------------------ rows of the daily file


@query(
    "target_date_rows",
    "on_target:b ticker session_date close:d",
    "SELECT session_date = DATE '2024-03-05' AS on_target, ticker, session_date, close FROM bars",
    "bars",
)
def _target(t: Tables):
    """Daily lines split into those of the expected day and the others."""
    same, others = parsers.split_target_date(parsers.parse_daily_lines(daily_lines(t)), dt.date(2024, 3, 5))
    return same.withColumn("on_target", F.lit(True)).unionByName(others.withColumn("on_target", F.lit(False)))


@query(
    "daily_storage_rows",
    "ticker candle_at reference_date timeframe close:d volume:d trades:n financial_volume:d traded_quantity:n source ingested_at data_quality_flags",
    """SELECT ticker, CAST(session_date AS TIMESTAMP) AS candle_at, session_date AS reference_date, '1D' AS timeframe, close, volume, trades, financial_volume,
              volume AS traded_quantity, 'daily_file' AS source, TIMESTAMP '2024-12-20 21:00:00' AS ingested_at, CASE WHEN high = low THEN 'NO_RANGE' END AS data_quality_flags
       FROM bars""",
    "bars",
)
def _daily_storage(t: Tables):
    return cdl.daily_candle_rows(parsers.parse_daily_lines(daily_lines(t)), "daily_file", dt.datetime(2024, 12, 20, 21))
