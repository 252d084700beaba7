"""Supervised datasets: barrier labels, temporal splits, scaling, manifest, champion trades."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import safe_div
from ..functions.frames import latest_by, with_one_row
from ..sources.io import cut
from .barrier import BAR, EXECUTION_POLICY, resolve
from .indicators import FEATURES, eod_feature_table

LABEL_VERSION = "label_eod_barrier_v2"
OUTCOME = [
    "entry_filled", "entry_date", "entry_price", "exit_date", "exit_price", "exit_reason", "gross_return",
    "net_return", "holding_sessions", "max_adverse_excursion", "max_favorable_excursion",
]


@dataclass(frozen=True)
class LabelConfig:
    entry_pct: float = 0.02
    target_pct: float = 0.07
    stop_pct: float = 0.07
    horizon_days: int = 15
    min_net_return_pct: float = 0.0
    cost_pct: float = 0.0
    spread_pct: float = 0.0
    slippage_pct: float = 0.0
    borrow_cost_pct: float = 0.0
    version: str = LABEL_VERSION

    def __post_init__(self) -> None:
        if not all(0 < v < 1 for v in (self.entry_pct, self.target_pct, self.stop_pct)):
            raise ValueError("entry_pct, target_pct and stop_pct must be between 0 and 1")
        if self.horizon_days < 1:
            raise ValueError("horizon_days must be positive")


def with_next_bars(candles: DataFrame, horizon: int) -> DataFrame:
    """Add ``valid_for`` (the ticker's next session) and ``future`` (its next bars)."""
    w = W.partitionBy("ticker").orderBy("session_date")
    bar = F.struct("session_date", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in BAR[1:]])
    return candles.withColumns(
        {
            "valid_for": F.lead("session_date").over(w),
            "future": F.collect_list(bar).over(w.rowsBetween(1, horizon)),
        }
    )


def barrier_labels(candles: DataFrame, cfg: LabelConfig = LabelConfig()) -> DataFrame:
    """Label every bar (but a ticker's last) by the better side's barrier outcome."""
    rows = with_next_bars(candles.select("ticker", "session_date", "high", "low", "close"), cfg.horizon_days)
    return label_rows(rows.withColumnRenamed("session_date", "reference_date"), cfg, ["ticker", "reference_date"])


def label_rows(df: DataFrame, cfg: LabelConfig, keep: list[str]) -> DataFrame:
    """Label columns beside ``keep`` for rows with close, valid_for and future.

    Both sides are resolved on the same row, without an exchange.
    """
    df = df.where("valid_for IS NOT NULL").withColumn("horizon_days", F.lit(cfg.horizon_days))
    cost = cfg.cost_pct + cfg.spread_pct + cfg.slippage_pct
    for side, sgn in (("BUY", 1.0), ("SELL", -1.0)):
        name = side.lower()
        future = F.col("future")
        ready = df.withColumns({"side": F.lit(side), "entry": F.col("close") * (1 - sgn * cfg.entry_pct), "_keep": future})
        ready = ready.withColumns(
            {"target": F.col("entry") * (1 + sgn * cfg.target_pct), "stop": F.col("entry") * (1 - sgn * cfg.stop_pct)}
        )
        done = resolve(ready, cfg.horizon_days, cost, cfg.borrow_cost_pct)
        df = done.withColumn(name, F.struct(*OUTCOME)).drop(
            "side", "entry", "target", "stop", "execution_policy_version", *OUTCOME
        ).withColumnRenamed("_keep", "future")
    buy, sell = F.col("buy.net_return"), F.col("sell.net_return")
    label = (
        F.when((buy > sell) & (buy > cfg.min_net_return_pct), "up")
        .when((sell > buy) & (sell > cfg.min_net_return_pct), "down")
        .otherwise("neutral")
    )
    df = df.withColumn("label_class", label)
    up, down = F.col("label_class") == "up", F.col("label_class") == "down"

    def chosen(c: str) -> Column:
        return F.when(up, F.col(f"buy.{c}")).when(down, F.col(f"sell.{c}"))

    defaults = {"entry_filled": F.lit(False), "gross_return": F.lit(0.0), "net_return": F.lit(0.0)}
    picked = [F.coalesce(chosen(c), defaults[c]).alias(c) if c in defaults else chosen(c).alias(c) for c in OUTCOME]
    return df.select(
        *keep, "valid_for",
        F.lit(cfg.version).alias("label_version"),
        "label_class",
        F.greatest(buy, sell).alias("future_return"),
        buy.alias("buy_net_return"),
        sell.alias("sell_net_return"),
        F.col("buy.entry_filled").alias("entry_filled_buy"),
        F.col("sell.entry_filled").alias("entry_filled_sell"),
        F.col("buy.holding_sessions").alias("days_to_event_buy"),
        F.col("sell.holding_sessions").alias("days_to_event_sell"),
        F.when(up, "BUY").when(down, "SELL").alias("trade_side"),
        *picked,
        F.lit(EXECUTION_POLICY).alias("execution_policy_version"),
    )


def session_index(df: DataFrame, day: str = "reference_date") -> DataFrame:
    """Distinct dates with 0-based position and total; one row per session, so always small."""
    dates = df.select(day).distinct()
    return dates.withColumns(
        {
            "session_no": F.row_number().over(W.orderBy(day)) - 1,
            "sessions": F.count(F.lit(1)).over(W.orderBy(day).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        }
    )


def temporal_splits(
    df: DataFrame, train: float = 0.65, validation: float = 0.175, embargo: int = 15, day: str = "reference_date"
) -> DataFrame:
    """Mark rows train / validation / test by date; embargoed dates stay NULL."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1) or embargo < 0:
        raise ValueError("shares must leave room for a test split and the embargo must not be negative")
    n, no = F.col("sessions"), F.col("session_no")
    train_end, valid_end = F.floor(n * train), F.floor(n * (train + validation))

    def gap(capacity: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(embargo), F.floor(capacity / 2)))

    split = (
        F.when(no < train_end, "train")
        .when((no >= train_end + gap(valid_end - train_end)) & (no < valid_end), "validation")
        .when(no >= valid_end + gap(n - valid_end), "test")
    )
    by_day = session_index(df, day).select(day, split.alias("dataset_split"))
    return df.join(F.broadcast(by_day), day, "left")


@dataclass(frozen=True)
class WalkForwardConfig:
    min_train_sessions: int = 504
    outer_folds: int = 5
    outer_test_sessions: int = 63
    calibration_sessions: int = 42
    embargo_sessions: int = 15
    locked_holdout_sessions: int = 126

    @property
    def required(self) -> int:
        return (
            self.min_train_sessions
            + 2 * self.embargo_sessions
            + self.calibration_sessions
            + self.outer_folds * self.outer_test_sessions
            + self.locked_holdout_sessions
        )


def _enough(total: Column, cfg: WalkForwardConfig) -> Column:
    """The number of sessions; the plan fails when it runs on too short a history."""
    have = F.coalesce(total, F.lit(0))
    message = F.concat(F.lit("not enough sessions for walk-forward: got "), have.cast("string"), F.lit(f", require at least {cfg.required}"))
    return F.when(have >= cfg.required, have).otherwise(F.raise_error(message).cast("long"))


def walk_forward_plan(df: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig(), day: str = "reference_date") -> DataFrame:
    """Expanding train, calibration and outer test windows; the newest sessions stay locked.

    Fails when it runs on too short a history; an empty table gives no folds. Windows are index arithmetic on the session list; building the plan starts
    no job.
    """
    index = session_index(df, day)
    total = F.col("sessions")
    start = (
        total - cfg.locked_holdout_sessions - (cfg.outer_folds - F.col("fold_no")) * cfg.outer_test_sessions
    )
    cal_end = F.col("_test_start") - cfg.embargo_sessions
    folds = (
        index.agg(_enough(F.max("sessions"), cfg).alias("sessions"))
        .withColumn("fold_no", F.explode(F.sequence(F.lit(0), F.lit(cfg.outer_folds - 1))))
        .withColumn("_test_start", start)
        .withColumns({"_cal_end": cal_end, "_cal_start": cal_end - cfg.calibration_sessions})
        .withColumn("_train_end", F.col("_cal_start") - cfg.embargo_sessions)
    )
    no = F.col("session_no")
    windows = {
        "train": (F.lit(0), F.col("_train_end")),
        "calibration": (F.col("_cal_start"), F.col("_cal_end")),
        "outer_test": (F.col("_test_start"), F.col("_test_start") + cfg.outer_test_sessions),
    }
    aggs = []
    for name, (lo, hi) in windows.items():
        inside = (no >= lo) & (no < hi)
        aggs += [
            F.min(F.when(inside, F.col(day))).alias(f"{name}_start"),
            F.max(F.when(inside, F.col(day))).alias(f"{name}_end"),
            F.count_if(inside).alias(f"{name}_sessions"),
        ]
    locked = no >= total - cfg.locked_holdout_sessions
    aggs += [
        F.min(F.when(locked, F.col(day))).alias("locked_holdout_start"),
        F.max(F.when(locked, F.col(day))).alias("locked_holdout_end"),
    ]
    # folds x sessions: both are configuration- and calendar-sized
    return (
        with_one_row(index, folds.drop("sessions"))
        .groupBy(F.concat(F.lit("fold_"), (F.col("fold_no") + 1).cast("string")).alias("fold_id"))
        .agg(*aggs)
    )


def holdout_split(df: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig(), day: str = "reference_date") -> DataFrame:
    """Mark rows ``research`` or ``locked_holdout`` (the newest sessions). Too short a history fails as above; no rows
    stay no rows."""
    index = session_index(df, day)
    locked = F.col("session_no") >= _enough(F.col("sessions"), cfg) - cfg.locked_holdout_sessions
    by_day = index.select(day, F.when(locked, "locked_holdout").otherwise("research").alias("dataset_split"))
    return df.join(F.broadcast(by_day), day)


def training_dataset(
    candles: DataFrame, holidays: DataFrame | None = None, cfg: LabelConfig = LabelConfig(),
    min_history: int = 20, train: float = 0.65, validation: float = 0.175, embargo: int | None = None,
    keep: list[str] | None = None, clean: bool = False, store: list[str] | None = None,
) -> DataFrame:
    """Features and labels, without holiday dates, split in time. ``keep`` and ``clean`` as in ``eod_feature_table``.

    Both come from windows over a clean ticker, so there is one exchange and no join. The arrays of next bars are made
    after the features, so neither the exchange nor the windows of the features carry them. Outcomes are resolved last, row by
    row: a filter on split or date reaches the rows before the array scans.

    Splits need all dates before the first row gets one, so ``candles`` is read twice. With ``store``, these columns and
    the date are stored with outcomes, if asked for, resolved; dates come from there, and ``candles`` is read once.
    """
    rows = eod_feature_table(candles, min_history, keep, clean).withColumnRenamed("reference_date", "session_date")
    rows = with_next_bars(rows, cfg.horizon_days).withColumnRenamed("session_date", "reference_date").where("valid_for IS NOT NULL")
    if holidays is not None:
        closed = F.broadcast(holidays.where("active").select("holiday_date"))
        for day in ("reference_date", "valid_for"):
            rows = rows.join(closed.withColumnRenamed("holiday_date", day), day, "left_anti")
    gap = cfg.horizon_days if embargo is None else embargo
    if store is None:
        rows = temporal_splits(rows, train, validation, gap)
    rows = label_rows(rows, cfg, [c for c in rows.columns if c not in ("valid_for", "future")])
    if store is None:
        return rows
    return temporal_splits(cut(rows.select(*dict.fromkeys(["reference_date", *store])), "dataset-rows"), train, validation, gap)


def fit_scaler(train: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row: mean and sample deviation per feature; a zero or missing deviation becomes 1."""
    stats = []
    for f in features:
        v = F.col(f).cast("double")
        stats += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"mean_{f}"), F.stddev_samp(v).alias(f"std_{f}")]
    fitted = train.agg(*stats)
    return fitted.select(
        *[F.col(f"mean_{f}") for f in features],
        *[F.coalesce(F.nullif(F.col(f"std_{f}"), F.lit(0.0)), F.lit(1.0)).alias(f"std_{f}") for f in features],
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Standardised features; a missing value takes the mean, so it scales to 0."""
    scaled = {
        f: (F.coalesce(F.col(f).cast("double"), F.col(f"mean_{f}")) - F.col(f"mean_{f}")) / F.col(f"std_{f}")
        for f in features
    }
    extra = [f"{p}_{f}" for p in ("mean", "std") for f in features]
    return with_one_row(df, scaler).withColumns(scaled).drop(*extra)


def scaler_rows(scaler: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    rows = [
        F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean"), F.col(f"std_{f}").alias("std"))
        for f in features
    ]
    return scaler.select(F.inline(F.array(*rows)))


def training_dataset_quality(dataset: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    buy, sell = F.col("buy_net_return"), F.col("sell_net_return")
    counts = {f"{c}_count": F.count_if(F.col("label_class") == c) for c in ("up", "down", "neutral")}
    return dataset.groupBy("feature_version", "label_version", "dataset_split").agg(
        n.alias("rows_count"),
        F.count_distinct("ticker").alias("tickers_count"),
        F.min("reference_date").alias("min_reference_date"),
        F.max("reference_date").alias("max_reference_date"),
        *[v.alias(k) for k, v in counts.items()],
        *[safe_div(v, n).alias(k.replace("count", "ratio")) for k, v in counts.items()],
        F.count_if("has_missing_ohlcv").alias("missing_ohlcv_count"),
        F.count_if("has_zero_volume").alias("zero_volume_count"),
        F.count_if("is_suspicious_candle").alias("suspicious_candle_count"),
        F.count_if((buy >= 0.07) | (sell >= 0.07)).alias("target_hit_count"),
        F.count_if((buy <= -0.07) | (sell <= -0.07)).alias("stop_hit_count"),
    )


def dataset_manifest(dataset: DataFrame, snapshot: str, query_text: str = "", code_text: str = "", cfg: LabelConfig = LabelConfig()) -> DataFrame:
    """One row describing a snapshot: counts by split and label, date range, hashes, costs.

    Counts are first taken per (ticker, split, label) with map-side combine.
    """
    split = F.coalesce("dataset_split", F.lit("embargo"))
    parts = dataset.groupBy("ticker", split.alias("_split"), "label_class").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("reference_date").alias("_d0"),
        F.max("reference_date").alias("_d1"),
        F.count_if("has_missing_ohlcv").alias("_missing"),
        F.count_if("has_zero_volume").alias("_zero"),
        F.count_if("is_suspicious_candle").alias("_odd"),
    )
    splits, labels = ("train", "validation", "test", "embargo"), ("up", "down", "neutral")

    def counts(c: str, values: tuple[str, ...]) -> Column:
        return F.to_json(F.struct(*[F.sum(F.when(F.col(c) == v, F.col("_n")).otherwise(0)).alias(v) for v in values]))

    return parts.agg(
        F.lit(snapshot).alias("dataset_snapshot"),
        F.lit(cfg.version).alias("label_version"),
        F.sha2(F.lit(query_text), 256).alias("query_hash"),
        F.sha2(F.lit(code_text), 256).alias("code_hash"),
        F.min("_d0").alias("start_date"),
        F.max("_d1").alias("end_date"),
        F.count_distinct("ticker").alias("tickers"),
        F.sum("_n").alias("rows"),
        counts("_split", splits).alias("split_counts"),
        counts("label_class", labels).alias("label_distribution"),
        F.sum("_missing").alias("missing_ohlcv_rows"),
        F.sum("_zero").alias("zero_volume_rows"),
        F.sum("_odd").alias("suspicious_candle_rows"),
        F.sum(F.when(F.col("_split") == "embargo", F.col("_n")).otherwise(0)).alias("embargo_rows"),
        F.lit(cfg.cost_pct).alias("cost_pct"),
        F.lit(cfg.spread_pct).alias("spread_pct"),
        F.lit(cfg.slippage_pct).alias("slippage_pct"),
        F.lit(cfg.borrow_cost_pct).alias("borrow_cost_pct"),
    )


def attach_champion(dataset: DataFrame, trades: DataFrame, strategy_id: str | None = None) -> DataFrame:
    """Champion side and return of the same (ticker, date); 0 and inactive where it did not trade."""
    last = latest_by(
        trades.withColumn("ticker", F.upper("ticker")), ["ticker", "reference_date"], [F.desc("trade_id")]
    ).select(
        "ticker",
        "reference_date",
        F.col("strategy_id").alias("champion_strategy_id"),
        F.col("side").alias("champion_signal_side"),
        F.col("net_pnl_pct").alias("champion_net_return"),
    )
    return (
        dataset.withColumn("ticker", F.upper("ticker"))
        .join(last, ["ticker", "reference_date"], "left")
        .withColumns(
            {
                "champion_strategy_id": F.coalesce("champion_strategy_id", F.lit(strategy_id)),
                "champion_net_return": F.coalesce("champion_net_return", F.lit(0.0)),
                "champion_trade_active": F.col("champion_signal_side").isNotNull(),
            }
        )
    )
