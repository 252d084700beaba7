"""Query registry: one column spec drives both the Spark result and its DuckDB check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[list[str], str]] = {}

# column spec kinds (a tiny shift keeps exact halves from rounding differently): d double (7 places), n long, t text, b boolean, a array joined by comma
_SQL = {
    "d": "round(CAST({c} AS DOUBLE) + 3.3e-10, 7) + 0.0 AS {c}",
    "n": "CAST({c} AS BIGINT) AS {c}",
    "t": "CAST({c} AS VARCHAR) AS {c}",
    "b": "CAST({c} AS BOOLEAN) AS {c}",
    "a": "array_to_string({c}, ',') AS {c}",
}


def _seven_places(c: str):
    """Rounded to 7 places. ``round`` of a double goes through a decimal number; up to a million, where every step is
    exact to far below the shift, whole numbers give the same double in a fraction of the time."""
    x = F.col(c).cast("double") + 3.3e-10
    return F.when(F.abs(x) < 1e6, F.rint(x * 1e7) / 1e7).otherwise(F.round(x, 7)) + F.lit(0.0)


_SPARK = {
    "d": _seven_places,
    "n": lambda c: F.col(c).cast("long"),
    "t": lambda c: F.col(c).cast("string"),
    "b": lambda c: F.col(c).cast("boolean"),
    "a": lambda c: F.array_join(F.col(c), ","),
}


def _spec(cols: str) -> list[tuple[str, str]]:
    out = []
    for item in cols.split():
        name, _, kind = item.partition(":")
        out.append((name, kind or "t"))
    return out


def cte(name: str, sql: str, uses: str = "") -> None:
    CTES[name] = (uses.split(), sql.strip())


def _chain(uses: list[str], seen: dict[str, None]) -> None:
    for name in uses:
        if name not in seen:
            _chain(CTES[name][0], seen)
            seen[name] = None


def with_ctes(uses: str, sql: str) -> str:
    seen: dict[str, None] = {}
    _chain(uses.split(), seen)
    head = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in seen)
    return (f"WITH {head}\n" if head else "") + sql.strip()


def query(name: str, cols: str, sql: str | None = None, uses: str = ""):
    """Register a query; ``sql`` is its DuckDB equivalent over the CTEs in ``uses``."""
    spec = _spec(cols)

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.select(*[_SPARK[k](c).alias(c) for c, k in spec])

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            shown = ", ".join(_SQL[k].format(c=c) for c, k in spec)
            ORACLES[name] = with_ctes(uses, f"SELECT {shown} FROM (\n{sql.strip()}\n) AS result")
        return fn

    return wrap


def sdiv(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


def pf(v: str) -> str:
    """Profit factor in SQL."""
    return (
        f"(coalesce(sum({v}) FILTER (WHERE {v} > 0), 0) / "
        f"nullif(abs(coalesce(sum({v}) FILTER (WHERE {v} < 0), 0)), 0))"
    )


def r4(x: str) -> str:
    """Round half up on the shortest decimal text of a double, as Spark does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE)"
