"""Structured Streaming path for quotes: candles, roll-up, late data and closed klines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import flag_list
from ..operators.candles import build_intraday_candles, candle_rows, prepare_quotes
from ..functions.frames import latest_by
from ..sources.io import replace_partitions, table_exists, touched, upsert_partitions
from ..sources.parsers import normalize_klines


def _newest(df: DataFrame):
    """Order of quotes of one ticker and time: by capture time where there is one, then by ``seq``."""
    return F.struct(*[c for c in ("captured_at", "seq") if c in df.columns])


def heartbeat(spark: SparkSession, folder: str, at: dt.datetime) -> None:
    """Add a row to the clock of a stream: all quotes before ``at`` have been delivered."""
    spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def clock(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the heartbeats in ``folder``; the first one is written here, so that the folder exists."""
    if not table_exists(spark, folder):
        heartbeat(spark, folder, dt.datetime(1970, 1, 2, tzinfo=dt.timezone.utc))
    return spark.readStream.schema("ts timestamp").parquet(folder)


def stream_quotes(stream: DataFrame, delay: str = "15 minutes", beats: DataFrame | None = None) -> DataFrame:
    """Typed quotes with event time and watermark, one for each ticker and time: the newest (see ``_newest``).

    ``beats`` is a ``clock``: its rows move the watermark on when no quotes come, so that a heartbeat after the last
    quote closes all buckets. They have no price and make no candle.
    """
    ticks = prepare_quotes(stream).withColumn("ts", F.col("ts").cast("timestamp"))
    ticks = ticks.select("ticker", "ts", F.struct("price", "seq").alias("quote"), _newest(ticks).alias("newest"))
    if beats is not None:
        ticks = ticks.unionByName(beats.select(F.lit("").alias("ticker"), "ts", F.lit(None).cast(ticks.schema["quote"].dataType).alias("quote"), F.lit(None).cast(ticks.schema["newest"].dataType).alias("newest")))
    one = ticks.withWatermark("ts", delay).groupBy("ticker", "ts").agg(F.max_by("quote", "newest").alias("quote"))
    return one.select("ticker", "ts", "quote.price", "quote.seq")


def stream_candles(ticks: DataFrame, size: str = "15 minutes") -> DataFrame:
    """Tumbling OHLC candles; emitted once the watermark has passed the bucket (append mode)."""
    at = F.struct("ts", "seq")
    candles = ticks.groupBy("ticker", F.window("ts", size).alias("w")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.count("price").alias("samples"),
    )
    return candles.where("samples > 0")  # none but heartbeats


def stream_rollup(candles: DataFrame, size: str = "1 hour") -> DataFrame:
    """Second windowed aggregation on closed candles."""
    at = F.window_time("w")
    return candles.withColumn("at", at).groupBy("ticker", F.window("at", size).alias("w")).agg(
        F.min_by("open", "at").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "at").alias("close"),
    )


def finish_candles(candles: DataFrame) -> DataFrame:
    """Storage columns of streamed candles."""
    out = candles.withColumn("candle_at", F.col("w.start").cast("timestamp_ntz")).drop("w")
    if "samples" in out.columns:
        single = ("SINGLE_QUOTE_BUCKET", F.col("samples") == 1)
        out = out.withColumn("flags", flag_list([("NO_VOLUME_SOURCE", F.lit(True)), single]))
    return out


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is available and append the closed rows to a parquet table."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def store_batch(batch: DataFrame, batch_id: int, path: str, stream: str, partition: str) -> None:
    """Store a micro-batch in a table by ``partition`` and batch; a replay overwrites what its first run has written.

    The last folder level names stream and batch, so the table logs which batches it holds, and nothing is added twice,
    whether the first run ended before or after the commit. Another query needs another ``stream`` name, since its
    batches are numbered from zero again.
    """
    rows = batch.withColumn("batch", F.lit(f"{stream}-{batch_id}"))
    replace_partitions(rows, path, [partition, "batch"])


def rebuild_days(raw_path: str, candle_path: str, stream: str = "quotes") -> Callable[[DataFrame, int], None]:
    """Batch handler for late data: store the quotes, then rebuild the days they touch.

    A replayed batch changes neither table. Of quotes with equal ticker, date and time the newest counts, and each
    touched day is overwritten as a whole partition; other days are not read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        store_batch(batch, batch_id, raw_path, stream, "quote_date")
        raw = touched(spark.read.schema(batch.withColumn("batch", F.lit("")).schema).parquet(raw_path), batch, "quote_date")
        newest = latest_by(prepare_quotes(raw), ["ticker", "quote_date", "quote_time"], [_newest(batch).desc()])
        replace_partitions(candle_rows(build_intraday_candles(newest.select(*batch.columns))), candle_path, ["reference_date"])

    return handle


def upsert_klines(path: str, now: Callable[[], dt.datetime], **stamps) -> Callable[[DataFrame, int], None]:
    """Batch handler: closed klines upserted into a table by event date.

    The key is exchange, symbol, interval and event time, as far as the batch has these columns; of several rows
    with one key the one that closed last stays, in the first batch as in later ones. ``stamps`` are the further
    arguments of ``normalize_klines``, such as source and run id.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        good, _ = normalize_klines(batch, now(), **stamps)
        rows = good.withColumn("event_date", F.to_date("event_time"))
        keys = [c for c in ("exchange", "symbol", "interval", "event_time") if c in rows.columns]
        order = [F.desc("close_time"), *[F.col(c) for c in sorted(set(rows.columns) - set(keys) - {"close_time"})]]
        if table_exists(batch.sparkSession, path):
            upsert_partitions(batch.sparkSession, path, rows, keys, "event_date", order)
        else:
            replace_partitions(latest_by(rows, keys, order), path, ["event_date"])

    return handle
