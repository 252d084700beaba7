"""Column-level building blocks shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL for a zero or NULL denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def _any_null(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in cols])


def strict_greatest(*cols: str | Column) -> Column:
    """``greatest`` that is NULL as soon as one argument is NULL."""
    cs = [col(c) for c in cols]
    return F.when(~_any_null(cs), F.greatest(*cs))


def strict_least(*cols: str | Column) -> Column:
    cs = [col(c) for c in cols]
    return F.when(~_any_null(cs), F.least(*cs))


def avg_if(pred: Column, value: str | Column) -> Column:
    return F.avg(F.when(pred, col(value)))


def sum_if(pred: Column, value: str | Column) -> Column:
    """Conditional sum; rows failing the predicate count as 0, so it is 0 when none pass."""
    return F.sum(F.when(pred, col(value)).otherwise(F.lit(0.0)))


def share_of(pred: Column) -> Column:
    """Share of rows where the predicate is true; NULL counts as false."""
    return F.avg(F.when(pred, 1.0).otherwise(0.0))


def profit_factor(value: str | Column) -> Column:
    """Sum of gains over absolute sum of losses; NULL when there is no loss."""
    v = col(value)
    return safe_div(sum_if(v > 0, v), F.abs(sum_if(v < 0, v)))


def full_window(agg: Column, counted: str | Column, w: WindowSpec, n: int) -> Column:
    """Window aggregate that stays NULL until ``n`` non-NULL values are in the frame."""
    return F.when(F.count(col(counted)).over(w) == n, agg.over(w))


def failed_criteria(criteria: Iterable[tuple[str, Column]]) -> Column:
    """Names of the criteria whose failure predicate is true, in the given order."""
    return F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in criteria]))


def status_chain(branches: Iterable[tuple[Column, str | Column]], default: str | Column | None) -> Column:
    """First matching branch wins; a NULL predicate falls through."""

    def value(v: str | Column | None) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    out: Column | None = None
    for pred, label in branches:
        out = F.when(pred, value(label)) if out is None else out.when(pred, value(label))
    return out.otherwise(value(default))


def flag_list(flags: Iterable[tuple[str, Column]]) -> Column:
    """Sorted, distinct quality flags whose predicate is true."""
    return F.array_sort(F.array_distinct(failed_criteria(flags)))


def normalise_flags(flags: str | Column) -> Column:
    """Trim, drop NULL and blank, de-duplicate and sort a flag array."""
    trimmed = F.transform(F.array_compact(col(flags)), lambda f: F.trim(f))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda f: f != "")))


def merge_flags(*arrays: str | Column) -> Column:
    """Union of flag arrays without NULL or blank entries, first occurrence order."""
    joined = F.concat(*[F.coalesce(col(a), F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(joined, lambda f: f.isNotNull() & (f != "")))


def clean_ticker(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    v = col(c)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def invalid_ohlc(o="open", h="high", lo="low", c="close") -> Column:
    """True for a bar with a missing, non-positive or inconsistent price."""
    o, h, lo, c = col(o), col(h), col(lo), col(c)
    return (
        _any_null([o, h, lo, c])
        | (F.least(o, h, lo, c) <= 0)
        | (h < F.greatest(lo, o, c))
        | (lo > F.least(o, c))
    )


def bad_volume(v: str | Column) -> Column:
    return col(v).isNull() | (col(v) <= 0)


def ntile_from_rank(rank: Column, total: Column, n: int) -> Column:
    """Bucket number that ``ntile(n)`` gives to the row at ``rank`` of ``total`` rows."""
    small = F.floor(total / n)
    wide = total % n
    edge = wide * (small + 1)
    return F.when(rank <= edge, F.ceil(rank / (small + 1))).otherwise(
        wide + F.ceil(F.try_divide((rank - edge).cast("double"), small))
    )
