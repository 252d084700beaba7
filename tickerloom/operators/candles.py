"""Candle building, roll-up, validation and projection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean_ticker, flag_list
from ..functions.frames import latest_by, require_columns

# fixed values: timeframe aliases and their length in minutes
TIMEFRAME_ALIASES = {"d": "1D", "1d": "1D", "15m": "15m", "m15": "15m", "1h": "1h", "h1": "1h"}
TIMEFRAME_MINUTES = {"1D": 1440, "15m": 15, "1h": 60}
BUCKETS = {"15m": "15 minutes", "1h": "1 hour"}


def timeframe(c: Column) -> Column:
    """Canonical timeframe; blank or NULL means daily, unknown text is kept."""
    text = F.trim(c)
    aliases = F.create_map(*[F.lit(v) for kv in TIMEFRAME_ALIASES.items() for v in kv])
    filled = F.when(F.coalesce(text, F.lit("")) == "", F.lit("1D")).otherwise(text)
    return F.coalesce(F.try_element_at(aliases, F.lower(filled)), filled)


def prepare_quotes(quotes: DataFrame) -> DataFrame:
    """Typed quotes with event time ``ts``; unusable rows are dropped."""
    require_columns(quotes, ["ticker", "quote_date", "quote_time", "price"])
    stamp = F.concat_ws(" ", F.col("quote_date").cast("string"), F.col("quote_time").cast("string"))
    return (
        quotes.withColumn("ticker", clean_ticker("ticker"))
        .withColumn("price", F.col("price").cast("string").try_cast("double"))
        .withColumn("ts", stamp.try_cast("timestamp_ntz"))
        .where("ts IS NOT NULL AND price IS NOT NULL AND NOT isnan(price) AND ticker <> ''")
    )


def bucket_start(ts: str, size: str) -> Column:
    """Left-closed bucket start; daily buckets start at local midnight."""
    if size == "1D":
        return F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")
    return F.window(F.col(ts), BUCKETS[size]).getField("start").cast("timestamp_ntz")


def build_intraday_candles(quotes: DataFrame, size: str = "15m", order: str = "seq", source: str = "intraday_quotes") -> DataFrame:
    """OHLC candles per ticker and bucket; equal timestamps are ordered by ``order``.

    First and last prices are min-by / max-by aggregates, so each task combines
    its own rows before the shuffle and a hot ticker spreads over its buckets.
    """
    ticks = prepare_quotes(quotes)
    at = F.struct("ts", order)
    bars = ticks.groupBy("ticker", bucket_start("ts", size).alias("candle_at")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.count("price").alias("samples"),
    )
    return bars.withColumns(
        {
            "volume": F.lit(0.0),
            "source": F.lit(source),
            "timeframe": F.lit(size),
            "window_minutes": F.lit(TIMEFRAME_MINUTES[size]),
            "flags": flag_list([("NO_VOLUME_SOURCE", F.lit(True)), ("SINGLE_QUOTE_BUCKET", F.col("samples") == 1)]),
        }
    )


def rollup_candles(candles: DataFrame, size: str = "1h") -> DataFrame:
    """Coarser candles out of finer ones, flagged ``ROLLED_UP``."""
    return (
        candles.groupBy("ticker", bucket_start("candle_at", size).alias("candle_at"))
        .agg(
            F.min_by("open", "candle_at").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "candle_at").alias("close"),
            F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"),
        )
        .withColumns(
            {
                "timeframe": F.lit(size),
                "window_minutes": F.lit(TIMEFRAME_MINUTES[size]),
                "flags": F.array(F.lit("ROLLED_UP")),
            }
        )
    )


def format_intraday_prices(quotes: DataFrame, order: str = "seq") -> DataFrame:
    """One price per (ticker, timestamp): the last ingested one."""
    ticks = prepare_quotes(quotes)
    return latest_by(ticks, ["ticker", "ts"], [F.col(order).desc()]).select("ticker", "ts", "price")


def validate_candles(candles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (good, rejected); rejected rows carry ``reject_reasons``."""
    o, h, lo, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    missing = o.isNull() | h.isNull() | lo.isNull() | c.isNull()
    missing = missing | F.isnan(o) | F.isnan(h) | F.isnan(lo) | F.isnan(c)
    reasons = flag_list(
        [
            ("BLANK_TICKER", F.coalesce(F.trim("ticker"), F.lit("")) == ""),
            ("MISSING_PRICE", missing),
            ("HIGH_BELOW_BODY", ~missing & (h < F.greatest(o, c, lo))),
            ("LOW_ABOVE_BODY", ~missing & (lo > F.least(o, c, h))),
            ("NEGATIVE_VOLUME", v < 0),
        ]
    )
    checked = candles.withColumn("reject_reasons", reasons)
    good = checked.where(F.size("reject_reasons") == 0).drop("reject_reasons")
    good = good.withColumn("ticker", clean_ticker("ticker"))
    return good, checked.where(F.size("reject_reasons") > 0)


def count_flags(candles: DataFrame, flags: str = "flags") -> DataFrame:
    return (
        candles.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("candles"))
    )


def candle_rows(candles: DataFrame) -> DataFrame:
    """Storage projection: reference date, joined flags; daily columns stay as they are."""
    flags = F.array_join(F.array_sort(F.array_distinct("flags")), ",")
    return candles.withColumns(
        {
            "reference_date": F.to_date("candle_at"),
            "data_quality_flags": F.when(F.size("flags") > 0, flags),
        }
    ).drop("flags")


def daily_candle_rows(candles: DataFrame, source: str, ingested_at: dt.datetime) -> DataFrame:
    """Storage projection of daily candles: the session at midnight, traded quantity, source and local ingest time."""
    stamped = candles.withColumns(
        {
            "candle_at": F.col("session_date").cast("timestamp_ntz"),
            "timeframe": F.lit("1D"),
            "traded_quantity": F.col("volume").cast("long"),
            "source": F.lit(source),
            "ingested_at": F.lit(ingested_at.replace(tzinfo=None)).cast("timestamp_ntz"),
        }
    )
    return candle_rows(stamped).drop("session_date")
