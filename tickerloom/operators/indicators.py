"""Technical indicators, rule features and point-in-time model features.

Every operator uses windows over ``(ticker, session_date)`` only, so one exchange
on ``ticker`` serves all of them; a ticker has one row per session after dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import clean_ticker, full_window, safe_div, strict_greatest, strict_least
from ..functions.frames import latest_by, require_columns, sequence_in_groups

def by_ticker():
    return W.partitionBy("ticker").orderBy("session_date")


def frame(before: int, to: int = 0):
    return by_ticker().rowsBetween(-before, to)


def dedup_daily(daily: DataFrame) -> DataFrame:
    """Newest row per (ticker, session).

    Rows are sent by ticker, which the windows over a ticker's sessions that follow need anyway: neither they nor this
    step shuffle or sort them again.
    """
    return latest_by(daily.repartition("ticker"), ["ticker", "session_date"], [F.col("updated_at").desc()])


def indicators(daily: DataFrame) -> DataFrame:
    """SMA 20/50, Bollinger bands, RSI 14, true range, ATR 14 and SMA 50 slope."""
    w14, w20, w50 = frame(13), frame(19), frame(49)
    prev, close, high, low = (F.col(c) for c in ("px_prev", "close", "high", "low"))
    delta = close - prev
    base = daily.select(
        "ticker", "session_date", "close", "high", "low", F.lag("close").over(by_ticker()).alias("px_prev")
    )
    ups, downs = strict_greatest(delta, F.lit(0.0)), strict_least(delta, F.lit(0.0))
    first = base.withColumns(
        {
            "sma20": F.avg("close").over(w20),
            "sd20": F.stddev_samp("close").over(w20),
            "sma50": F.avg("close").over(w50),
            "rs_raw": safe_div(F.sum(ups).over(w14), -F.sum(downs).over(w14)),
            "tr": strict_greatest(
                F.coalesce(high - low, F.lit(0.0)),
                F.abs(F.coalesce(high, prev) - prev),
                F.abs(F.coalesce(low, prev) - prev),
            ),
        }
    )
    return first.withColumns(
        {
            "bb_up": F.col("sma20") + 2 * F.col("sd20"),
            "bb_dn": F.col("sma20") - 2 * F.col("sd20"),
            "rsi14": 100 - safe_div(F.lit(100.0), 1 + F.col("rs_raw")),
            "atr14": F.avg("tr").over(w14),
            "slope50_pct": safe_div(F.abs(F.col("sma50") - F.lag("sma50").over(by_ticker())), "sma50"),
        }
    )


def daily_features(daily: DataFrame, universe: DataFrame) -> DataFrame:
    """Rule features of the research universe on de-duplicated bars."""
    bars = dedup_daily(daily.join(universe, "ticker", "left_semi"))
    close = F.col("close")
    lags = bars.select(
        "ticker", "session_date", "open", "high", "low", "close", "financial_volume",
        *[F.lag("close", n).over(by_ticker()).alias(a)
          for n, a in ((1, "prior_close"), (3, "close_3d_ago"), (5, "close_5d_ago"), (20, "close_20d_ago"))],
    )
    delta = close - F.col("prior_close")
    w20 = frame(19)
    base = lags.withColumns(
        {
            "sma_20": F.avg("close").over(w20),
            "sma_50": F.avg("close").over(frame(49)),
            "avg_volume_20d": F.avg("financial_volume").over(w20),
            "prior_high_20d": F.max("high").over(frame(20, -1)),
            "prior_low_20d": F.min("low").over(frame(20, -1)),
            "avg_gain_14": F.avg(strict_greatest(delta, F.lit(0.0))).over(frame(13)),
            "avg_loss_14": F.avg(F.abs(strict_least(delta, F.lit(0.0)))).over(frame(13)),
        }
    )
    return base.withColumns(
        {
            "return_3d": safe_div("close", "close_3d_ago") - 1,
            "return_5d": safe_div("close", "close_5d_ago") - 1,
            "return_20d": safe_div("close", "close_20d_ago") - 1,
            "relative_volume_20d": safe_div("financial_volume", "avg_volume_20d"),
            "rsi_14": 100 - safe_div(F.lit(100.0), 1 + safe_div("avg_gain_14", "avg_loss_14")),
            "gap_pct": safe_div("open", "prior_close") - 1,
        }
    ).withColumnRenamed("session_date", "reference_date")


# fixed values: contract version and order of the model features
FEATURE_VERSION = "feature_eod_tabular_v3"
FEATURES = (
    "log_return_1d log_return_5d log_return_10d log_return_20d return_1d return_5d return_10d return_20d "
    "volatility_5d volatility_10d volatility_20d volatility_60d downside_volatility_20d daily_range_pct "
    "intraday_return_pct gap_open_pct financial_volume_z20 log_financial_volume log_volume volume_ratio_5d "
    "volume_ratio_20d financial_volume_ratio_20d trend_sma_5_20_pct distance_high_20d_pct "
    "distance_low_20d_pct distance_high_60d_pct distance_low_60d_pct distance_sma_20d_pct "
    "distance_sma_50d_pct range_volatility_20d"
).split()


def _log_ratio(num: Column, den: Column) -> Column:
    ratio = safe_div(num, den)
    return F.when(ratio > 0, F.ln(ratio))


def _last_five(means: list[str], spreads: list[str], tops: list[str], bottoms: list[str]) -> dict[str, Column]:
    """Mean, sum of squared deviations, top and bottom of the last five rows; NULL unless all five are known."""

    def full(agg, c: str) -> Column:
        return full_window(agg(F.col(c)), c, frame(4), 5)

    out = {f"_mean5_{c}": full(lambda v: F.avg(v.cast("double")), c) for c in means}
    out |= {f"_spread5_{c}": 5 * full(F.var_pop, c) for c in spreads}
    return out | {f"_top5_{c}": full(F.max, c) for c in tops} | {f"_bottom5_{c}": full(F.min, c) for c in bottoms}


def _longer(size: int, parts: int, means: list[str], spreads: list[str], tops: list[str], bottoms: list[str]) -> dict[str, Column]:
    """The same values over ``size * parts`` rows, from those over ``size`` rows at every ``size``-th row back.

    Deviations are measured from the newest part, so equal values have a spread of exactly zero.
    """
    n = size * parts

    def back(kind: str, c: str) -> list[Column]:
        name = f"_{kind}{size}_{c}"
        return [F.col(name), *[F.lag(name, size * i).over(by_ticker()) for i in range(1, parts)]]

    out = {}
    for c in means:
        held = back("mean", c)
        shifts = [m - held[0] for m in held[1:]]
        drift = sum(shifts[1:], shifts[0]) / parts
        out[f"_mean{n}_{c}"] = held[0] + drift
        if c in spreads:
            apart = sum(((s - drift) * (s - drift) for s in shifts), drift * drift)
            inside = back("spread", c)
            out[f"_spread{n}_{c}"] = sum(inside[1:], inside[0]) + size * apart
    out |= {f"_top{n}_{c}": strict_greatest(*back("top", c)) for c in tops}
    return out | {f"_bottom{n}_{c}": strict_least(*back("bottom", c)) for c in bottoms}


def eod_feature_table(
    candles: DataFrame, min_history: int = 20, keep: list[str] | None = None, clean: bool = False
) -> DataFrame:
    """Versioned model features per (ticker, session).

    Rolling values stay NULL until their window is full of non-NULL inputs.
    ``candles`` needs one row per (ticker, session); see ``dedup_daily``. ``keep`` names
    further input columns to pass through. ``clean`` says that tickers are trimmed and upper-case already: rows that
    ``dedup_daily`` has sent by ticker then stay where they are.

    A frame is added up row by row for each of its rows. Only five rows are; the longer windows are put
    together from the shorter ones at earlier rows, so their work does not grow with their length.
    """
    if min_history < 1:
        raise ValueError("min_history must be positive")
    require_columns(candles, ["ticker", "session_date", "open", "high", "low", "close", "volume"])
    if "financial_volume" not in candles.columns:
        candles = candles.withColumn("financial_volume", F.col("close") * F.col("volume"))
    close, open_, high, low, volume, money = (
        F.col(c) for c in ("close", "open", "high", "low", "volume", "financial_volume")
    )

    ago = {n: F.lag("close", n).over(by_ticker()) for n in (1, 5, 10, 20)}
    named = candles if clean else candles.withColumn("ticker", clean_ticker("ticker"))
    base = named.withColumns(
        {f"return_{n}d": safe_div(close, p) - 1 for n, p in ago.items()}
        | {f"log_return_{n}d": _log_ratio(close, p) for n, p in ago.items()}
        | {
            "_prev": ago[1],
            "_range": safe_div(high - low, close),
            "history_days": F.row_number().over(by_ticker()),
        }
    )
    base = base.withColumn("_down", F.when(F.col("return_1d") < 0, F.col("return_1d")).otherwise(0.0))
    spread = ["return_1d", "_down", "financial_volume", "_range"]
    mean, high_low = [*spread, "volume", "close"], (["high"], ["low"])
    base = base.withColumns(_last_five(mean, spread, *high_low))
    base = base.withColumns(_longer(5, 2, ["return_1d", "close"], ["return_1d"], [], []) | _longer(5, 4, mean, spread, *high_low))
    base = base.withColumns(_longer(20, 3, ["return_1d"], ["return_1d"], *high_low) | _longer(10, 5, ["close"], [], [], []))

    def sd(c: str, n: int) -> Column:
        return F.sqrt(F.col(f"_spread{n}_{c}") / (n - 1))

    sma = {n: F.col(f"_mean{n}_close") for n in (5, 20, 50)}
    money_avg = F.col("_mean20_financial_volume")
    feats = {f"volatility_{n}d": sd("return_1d", n) for n in (5, 10, 20, 60)}
    feats |= {
        "downside_volatility_20d": sd("_down", 20),
        "daily_range_pct": F.col("_range"),
        "intraday_return_pct": safe_div(close - open_, open_),
        "gap_open_pct": safe_div(open_ - F.col("_prev"), F.col("_prev")),
        "financial_volume_z20": safe_div(money - money_avg, sd("financial_volume", 20)),
        "log_financial_volume": F.log1p(F.greatest(money, F.when(money.isNotNull(), F.lit(0.0)))),
        "log_volume": F.log1p(F.greatest(volume, F.when(volume.isNotNull(), F.lit(0.0)))),
        "volume_ratio_5d": safe_div(volume, F.col("_mean5_volume")),
        "volume_ratio_20d": safe_div(volume, F.col("_mean20_volume")),
        "financial_volume_ratio_20d": safe_div(money, money_avg),
        "trend_sma_5_20_pct": safe_div(sma[5] - sma[20], close),
        "distance_sma_20d_pct": safe_div(close - sma[20], close),
        "distance_sma_50d_pct": safe_div(close - sma[50], close),
        "range_volatility_20d": sd("_range", 20),
    }
    for n in (20, 60):
        feats[f"distance_high_{n}d_pct"] = safe_div(close - F.col(f"_top{n}_high"), close)
        feats[f"distance_low_{n}d_pct"] = safe_div(close - F.col(f"_bottom{n}_low"), close)
    any_null = open_.isNull() | high.isNull() | low.isNull() | close.isNull() | volume.isNull()
    flags = {
        "has_missing_ohlcv": any_null,
        "has_zero_volume": F.coalesce(volume, F.lit(0)) <= 0,
        "is_suspicious_candle": F.coalesce(close <= 0, F.lit(False))
        | F.coalesce(open_ <= 0, F.lit(False))
        | F.coalesce(high < F.greatest(open_, close, low), F.lit(False))
        | F.coalesce(low > F.least(open_, close, high), F.lit(False)),
        "feature_version": F.lit(FEATURE_VERSION),
    }
    return (
        base.withColumns(feats | flags)
        .where(F.col("history_days") >= min_history)
        .select(
            "ticker", F.col("session_date").alias("reference_date"), "feature_version",
            "open", "high", "low", "close", "volume", "financial_volume", *FEATURES,
            "has_missing_ohlcv", "has_zero_volume", "is_suspicious_candle", "history_days", *(keep or []),
        )
    )


def return_windows(prices: DataFrame, lookback: int, horizon: int, threshold: float) -> DataFrame:
    """The previous ``lookback`` returns (without today's) and the label of the next ``horizon`` days.

    Labels: 2 up, 0 down, 1 neither, by ``threshold``. The first return of a series counts as 0.
    """
    if lookback < 1 or horizon < 1:
        raise ValueError("lookback and horizon must be positive")
    past = by_ticker().rowsBetween(-lookback, -1)
    base = prices.where("close IS NOT NULL").select(
        "ticker",
        "session_date",
        "close",
        F.coalesce(safe_div("close", F.lag("close").over(by_ticker())) - 1, F.lit(0.0)).alias("_r"),
        (safe_div(F.lead("close", horizon).over(by_ticker()), "close") - 1).alias("future_return"),
    )
    move = F.col("future_return")
    return (
        base.withColumn("window", F.collect_list("_r").over(past))
        .where((F.size("window") == lookback) & move.isNotNull())
        .withColumn("label", F.when(move >= threshold, 2).when(move <= -threshold, 0).otherwise(1))
        .drop("_r")
    )


def sequence_windows(dataset: DataFrame, lookback: int, features: list[str] = FEATURES) -> DataFrame:
    """Trailing arrays of (scaled) feature rows; only full windows, labelled by their last row."""
    if not 20 <= lookback <= 60:
        raise ValueError("lookback must be between 20 and 60 sessions")
    w = W.partitionBy("ticker").orderBy("reference_date").rowsBetween(-(lookback - 1), 0)
    vec = F.array(*[F.col(f).cast("float") for f in features])
    return (
        dataset.where("dataset_split IS NOT NULL")
        .withColumn("sequence", F.collect_list(vec).over(w))
        .where((F.size("sequence") == lookback) & F.col("label_class").isNotNull())
        .select("ticker", "reference_date", "dataset_split", "label_class", "sequence")
    )


def chronological_split(samples: DataFrame, day: str, order: list[str], share: float) -> DataFrame:
    """Mark the oldest ``floor(n * (1 - share))`` rows as training rows.

    Ranks run per day with day offsets, so the whole sample set never meets in one task.
    """
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    ranked = sequence_in_groups(samples.withColumn("_all", F.lit(1)), ["_all"], day, order)
    cut = F.floor(F.col("total") * (1 - share))
    return ranked.withColumn("is_train", F.col("seq") <= cut).drop("_all", "seq", "total")
