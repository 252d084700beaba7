"""DataFrame-level building blocks: latest row, slices, ranks and medians of large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .expr import col


def latest_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row per key under ``order``.

    ``row_number() == 1`` lets Spark keep one row per key before the shuffle
    (window group limit), so a hot key never travels whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key (None: all) with their position in ``out``."""
    w = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col(out) <= n)


def first_rows(df: DataFrame, order: Sequence[Column | str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows (None: all) in ``order``."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


#: A configuration that is attached to every row has at most so many rows; more is an error.
MOST_CONFIG_ROWS = 10_000


def with_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row (or config-sized) frame to every row. Fails when it has more than ``MOST_CONFIG_ROWS`` rows."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    small = row.limit(MOST_CONFIG_ROWS + 1).withColumn("_n", n)
    message = F.lit(f"more than {MOST_CONFIG_ROWS} rows to attach to every row")
    checked = small.where(F.when(F.col("_n") <= MOST_CONFIG_ROWS, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return df.crossJoin(F.broadcast(checked.drop("_n")))


def sequence_in_groups(
    df: DataFrame,
    keys: Sequence[str],
    coarse: str,
    order: Sequence[str],
    seq: str = "seq",
    total: str = "total",
) -> DataFrame:
    """1-based position and group size for groups that may be very large.

    The leading sort key ``coarse`` cuts every group into slices. Slice sizes are
    counted with map-side combine and turned into offsets; only a slice is ever
    sorted in one task. Equal to ``row_number`` over ``(coarse, *order)``.
    """
    slices = df.groupBy(*keys, coarse).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(coarse).rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(
        *keys,
        coarse,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*keys)).alias(total),
    )
    inner = W.partitionBy(*keys, coarse).orderBy(*order)
    return (
        df.withColumn("_pos", F.row_number().over(inner))
        .join(slices, [*keys, coarse])
        .withColumn(seq, F.col("_offset") + F.col("_pos"))
        .drop("_offset", "_pos")
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str, accuracy: int = 2048) -> DataFrame:
    """Exact median per key without bringing a group into one task.

    Two splitters around the middle come from the data (``percentile_approx``, whose ranks are off by at most
    1/accuracy), so no spread of the values makes the slice between them large. The slices below, between and above
    are counted exactly, and only the one or two with the middle ranks are sorted, one row per distinct value.
    """
    margin = 2 / accuracy
    known = df.where(F.col(value).isNotNull())
    ends = F.percentile_approx(value, [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)], accuracy)
    span = known.groupBy(*keys).agg(ends.alias("_ends"), F.count(F.lit(1)).alias("_total"))
    freq = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    slice_no = F.when(F.col(value) < F.col("_ends")[0], 0).when(F.col(value) <= F.col("_ends")[1], 1).otherwise(2)
    placed = freq.join(span, list(keys)).withColumn("_b", slice_no).drop("_ends")
    lower, upper = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    running = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    middle = (
        placed.groupBy(*keys, "_b", "_total")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.sum("_bn").over(running))
        .where((F.col("_end") >= lower) & (F.col("_end") - F.col("_bn") < upper))
        .select(*keys, "_b", (F.col("_end") - F.col("_bn")).alias("_before"))
    )
    inner = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        placed.join(middle, [*keys, "_b"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inner))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") < rank) & (F.col("_end") >= rank), F.col(value)))

    return ranked.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(out))


def equity_path(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], ret: str) -> DataFrame:
    """Compounded equity and its running peak along ``(day, *order)`` within each key.

    Adds ``equity`` and ``peak``. A key may hold any number of rows: each day is
    compounded on its own, then one row per (key, day) carries the level forward.
    """
    w = W.partitionBy(*keys, day).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = df.withColumn("_p", F.product(1 + F.col(ret)).over(w)).withColumn("_m", F.max("_p").over(w))
    before = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    levels = (
        inside.groupBy(*keys, day)
        .agg(F.product(1 + F.col(ret)).alias("_growth"), F.max("_m").alias("_top"))
        .withColumn("_start", F.coalesce(F.product("_growth").over(before), F.lit(1.0)))
        .withColumn("_peak_before", F.max(F.col("_start") * F.col("_top")).over(before))
        .select(*keys, day, "_start", "_peak_before")
    )
    return (
        inside.join(levels, [*keys, day])
        .withColumn("equity", F.col("_start") * F.col("_p"))
        .withColumn("peak", F.greatest("_peak_before", F.col("_start") * F.col("_m")))
        .drop("_p", "_m", "_start", "_peak_before")
    )


def daily_growth(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], ret: str) -> DataFrame:
    """One row per (key, day) with ``max_drawdown`` of the day's part of the equity path, see ``equity_path``.

    A row's drawdown is measured from the peak within its day or from the peak before it, whichever is deeper, so
    the day's lowest level and its deepest fall within are all that later days need: no row is joined back.
    """
    w = W.partitionBy(*keys, day).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = df.withColumn("_p", F.product(1 + F.col(ret)).over(w)).withColumn("_m", F.max("_p").over(w))
    fall = F.when(F.col("_m") != 0, (F.col("_m") - F.col("_p")) / F.col("_m"))
    days = inside.groupBy(*keys, day).agg(
        F.product(1 + F.col(ret)).alias("_growth"), F.max("_m").alias("_top"), F.min("_p").alias("_low"), F.max(fall).alias("_inner")
    )
    before = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("_start", F.coalesce(F.product("_growth").over(before), F.lit(1.0)))
    days = days.withColumn("_peak", F.max(F.col("_start") * F.col("_top")).over(before))
    outer = F.when(F.col("_peak") != 0, (F.col("_peak") - F.col("_start") * F.col("_low")) / F.col("_peak"))
    return days.select(*keys, day, F.greatest("_inner", outer).alias("max_drawdown"))


def add_missing_columns(df: DataFrame, schema) -> DataFrame:
    """Additive schema evolution: append absent columns of ``schema`` as typed NULLs."""
    present = set(df.columns)
    return df.select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in present]
    )


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


__all__ = [
    "add_missing_columns",
    "col",
    "equity_path",
    "exact_median",
    "latest_by",
    "require_columns",
    "sequence_in_groups",
    "top_n_by",
    "with_one_row",
]
