"""Market tables that Spark derives from the generated parquet tables.

Prices are built in whole cents, so every engine reads the same value.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import cut
from .shared import shared

CALENDAR_START = dt.date(2024, 1, 1)
SESSIONS = 250


def session_day(idx):
    """Weekday number ``idx`` counted from the calendar start."""
    return F.date_add(F.lit(CALENDAR_START), (F.floor(idx / 5) * 7 + idx % 5).cast("int"))


class Tables:
    """Lazy access to the source tables and the derived market tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def indexed_bars(self) -> DataFrame:
        """One bar per (ticker, session) with the generator's indexes ``tk`` and ``idx``."""
        tk = F.col("l_suppkey")
        days = F.datediff(F.col("l_shipdate").cast("date"), F.lit(dt.date(1995, 1, 2)))
        src = self.read("lineitem").select(
            tk.alias("tk"),
            F.pmod(days, F.lit(SESSIONS)).cast("long").alias("idx"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_quantity",
        )
        tk, idx = F.col("tk"), F.col("idx")
        cents = (
            F.lit(10000)
            + 5 * idx * (tk % 3 - 1)
            + 80 * F.abs((idx + 7 * tk) % 40 - 20)
            + 8 * (F.col("l_partkey") % 97 - 48)
        )
        src = src.withColumn("cents", cents).withColumn(
            "seq", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("cents")
        )
        return (
            src.groupBy("tk", "idx")
            .agg(
                (F.min_by("cents", "seq") / 100).alias("open"),
                (F.max("cents") / 100).alias("high"),
                (F.min("cents") / 100).alias("low"),
                (F.max_by("cents", "seq") / 100).alias("close"),
                F.sum("l_quantity").alias("volume"),
                (F.sum(F.col("l_quantity") * F.col("cents")) * 10).alias("financial_volume"),
                F.count(F.lit(1)).alias("trades"),
            )
            .select(
                F.concat(F.lit("S"), F.lpad(tk.cast("string"), 5, "0")).alias("ticker"),
                session_day(idx).alias("session_date"),
                "open",
                "high",
                "low",
                "close",
                "volume",
                "financial_volume",
                "trades",
                "tk",
                "idx",
            )
        )

    @cached_property
    def bars(self) -> DataFrame:
        return self.indexed_bars.drop("tk", "idx")

    @cached_property
    def daily(self) -> DataFrame:
        """Raw daily table: bars with late duplicates, zero volumes and broken prices mixed in."""
        return self.indexed_daily.drop("tk", "idx", "copy")

    @cached_property
    def indexed_daily(self) -> DataFrame:
        """The daily table with the indexes of its bars; ``copy`` 0 is there once for every bar."""
        tk, idx = F.col("tk"), F.col("idx")
        repeated = ((tk % 5 == 0) & (idx % 50 == 0)) | ((tk % 5 == 1) & (idx % 125 == 0))
        broken = (tk % 11 == 4) & (idx == 77)
        dead = (tk % 7 == 3) & (idx % 61 == 0)
        rows = self.indexed_bars.withColumn(
            "copy", F.explode(F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        )
        return rows.select(
            "ticker",
            "session_date",
            "open",
            F.when(broken, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
            "low",
            (F.col("close") + F.col("copy") * 0.5).alias("close"),
            F.when(dead, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
            F.when(dead, F.lit(0.0)).otherwise(F.col("financial_volume")).alias("financial_volume"),
            (
                F.col("session_date").cast("timestamp_ntz")
                + F.make_dt_interval(hours=F.lit(21) + F.col("copy"))
            ).alias("updated_at"),
            "tk",
            "idx",
            "copy",
        )

    @cached_property
    def tickers(self) -> DataFrame:
        sk = F.col("s_suppkey")
        return self.read("supplier").select(
            F.concat(F.lit("S"), F.lpad(sk.cast("string"), 5, "0")).alias("ticker"),
            F.col("s_name").alias("company"),
            (sk % 7 != 6).alias("active"),
        )

    @cached_property
    def holidays(self) -> DataFrame:
        """Exchange holidays (calendar config): every 83rd session from the 41st, plus one inactive."""
        idx = F.col("id")
        return (
            self.spark.range(SESSIONS)
            .where("id % 83 = 41 OR id = 60")
            .select(session_day(idx).alias("holiday_date"), (idx != 60).alias("active"))
        )

    @cached_property
    def quotes(self) -> DataFrame:
        """Intraday quotes; every 97th value is missing."""
        ts = F.col("ts").cast("timestamp_ntz")
        return self.read("events").select(
            F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string")).alias("ticker"),
            ts.cast("date").alias("quote_date"),
            F.date_format(ts, "HH:mm:ss").alias("quote_time"),
            F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("price"),
            F.col("event_id").alias("seq"),
            F.date_trunc("second", ts).cast("timestamp_ntz").alias("captured_at"),
        )


@shared
def stored(t: Tables) -> Tables:
    """The same tables with the daily rows stored, for queries that read them several times over: bars are made of the
    line items once."""
    out = Tables(t.spark, t.sf_dir)
    out.indexed_daily = cut(t.indexed_daily, "daily-rows")
    return out
