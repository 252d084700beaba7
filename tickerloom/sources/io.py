"""Scans, sinks and slice maintenance on partitioned parquet tables."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clean_ticker, finite
from ..functions.frames import latest_by


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken in local mode only, as one machine is all there is; on a cluster
    executors would not see it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored intermediate that is not needed any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where several branches need one expensive input: it is computed once, its
    lineage ends there, and lost executors cost nothing but a re-read.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a table at ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def partition_scan(table: DataFrame, partition: str, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of one partition; a NULL value finds the rows without one. Only that folder is listed and read."""
    found = table.where(F.col(partition).isNull() if value is None else F.col(partition) == F.lit(value))
    return found.select(*columns) if columns else found


def range_scan(table: DataFrame, partition: str, first=None, last=None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of the partitions from ``first`` to ``last``, both included; an end that is None is open."""
    if first is not None:
        table = table.where(F.col(partition) >= F.lit(first))
    if last is not None:
        table = table.where(F.col(partition) <= F.lit(last))
    return table.select(*columns) if columns else table


def key_scan(table: DataFrame, keys: DataFrame | Sequence, on: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose ``on`` is among the keys; NULL keys find nothing.

    A sequence becomes a literal list, which reaches the scan. A frame is semi-joined; where ``on`` is a partition
    column and the keys come out of a filter, Spark prunes the partitions at run time by the keys it has found.
    """
    if isinstance(keys, DataFrame):
        found = table.join(keys.select(on), on, "left_semi")
    else:
        found = table.where(F.col(on).isin([k for k in keys if k is not None]))
    return found.select(*columns) if columns else found


#: Partitions of a batch that are named in the plan; if it touches more, they are found by a join.
MOST_NAMED_PARTITIONS = 5_000


def touched(table: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """Rows of the partitions that ``batch`` has rows of; their names, if not too many, prune the scan beforehand."""
    days = batch.select(partition).where(F.col(partition).isNotNull()).distinct()
    names = [r[0] for r in days.limit(MOST_NAMED_PARTITIONS + 1).collect()]
    return key_scan(table, names if len(names) <= MOST_NAMED_PARTITIONS else days, partition)


def append(df: DataFrame, path: str, partition_by: Sequence[str], cluster_by: Sequence[str] = ()) -> None:
    """Append; rows are sorted inside files so that parquet statistics prune ``cluster_by``."""
    if cluster_by:
        df = df.sortWithinPartitions(*partition_by, *cluster_by)
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Idempotent rebuild: only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def replace_slice(target: DataFrame, new: DataFrame, in_slice: Column) -> DataFrame:
    """Target with the rows of a slice exchanged for ``new``."""
    kept = target.where(~F.coalesce(in_slice, F.lit(False)))
    return kept.unionByName(new, allowMissingColumns=True)


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None,
    keep_from_target: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``source`` replace those of ``target`` with equal keys; others are kept.

    ``order`` picks one source row per key. ``keep_from_target`` names columns that keep
    the target's value on update, e.g. a creation time.
    """
    keys = list(keys)
    if order is not None:
        source = latest_by(source, keys, list(order))
    if keep_from_target:
        old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep_from_target])
        source = source.join(old, keys, "left")
        source = source.withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep_from_target})
        source = source.drop(*[f"_old_{c}" for c in keep_from_target])
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def upsert_partitions(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], partition: str, order: Sequence[Column] | None = None,
    keep_from_target: Sequence[str] = (), first=None,
) -> None:
    """Upsert into a partitioned table, rewriting only the partitions that ``source`` touches.

    With ``first``, older partitions are not even listed. The merged rows go to the shared folder first, since a table
    cannot be overwritten while it is read.
    """
    target = range_scan(spark.read.parquet(path), partition, first)
    current = touched(target, source, partition)
    merged = upsert(current, source, keys, order, keep_from_target)
    held = f"{checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}"
    merged.write.parquet(held)
    replace_partitions(spark.read.schema(merged.schema).parquet(held), path, [partition])
    discard(spark, held)


def merge_recent(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], partition: str, as_of: dt.date, days: int | None = 365,
    order: Sequence[Column] | None = None, keep_from_target: Sequence[str] = (),
) -> None:
    """Merge the rows of ``source`` from the last ``days`` days before ``as_of`` into a table by date (None: all rows).

    Rows with the keys and date of a stored row replace it (but for ``keep_from_target``), others are added; later
    rows than ``as_of`` are merged too. Partitions older than the window are neither read nor written, nor are
    those that no source row falls into. The keys have to determine the date, as ids made of it do.
    """
    first = None if days is None else as_of - dt.timedelta(days=days)
    recent = range_scan(source, partition, first)
    upsert_partitions(spark, path, recent, [*keys, partition], partition, order, keep_from_target, first)


def json_safe(df: DataFrame, integers: Sequence[str] = ()) -> DataFrame:
    """NaN and infinities become NULL, the named columns become whole numbers."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            c = finite(c)
        cols.append((c.cast("long") if f.name in integers else c).alias(f.name))
    return df.select(*cols)


def latest_snapshot(df: DataFrame, snapshot: str | None = None) -> DataFrame:
    """Rows of the given snapshot, or of the newest one that has split rows."""
    if snapshot is not None:
        return df.where(F.col("dataset_snapshot") == snapshot)
    ready = df.where("dataset_split IS NOT NULL")
    newest = ready.agg(F.max_by("dataset_snapshot", F.struct("created_at", "dataset_snapshot")).alias("dataset_snapshot"))
    return ready.join(F.broadcast(newest), "dataset_snapshot", "left_semi")


def latest_complete_snapshot(df: DataFrame) -> DataFrame:
    """Newest snapshot with train, validation and test rows; more rows win on equal dates."""
    split = F.col("dataset_split")
    full = df.groupBy("dataset_snapshot").agg(
        F.count(F.lit(1)).alias("rows_count"),
        F.max("reference_date").alias("max_reference_date"),
        *[F.count_if(split == s).alias(f"_{s}") for s in ("train", "validation", "test")],
    )
    ready = full.where("_train > 0 AND _validation > 0 AND _test > 0").drop("_train", "_validation", "_test")
    return ready.orderBy(F.desc("max_reference_date"), F.desc("rows_count"), "dataset_snapshot").limit(1)


def active_universe(tickers: DataFrame, benchmarks: Sequence[str], cap: int | None = None) -> DataFrame:
    """Active tickers plus the benchmarks; with ``cap`` at most so many in all, the first in order."""
    names = list(dict.fromkeys(b.strip().upper() for b in benchmarks if b.strip()))[:cap]
    listed = (
        tickers.where("active")
        .select(clean_ticker("ticker").alias("ticker"))
        .where((F.col("ticker") != "") & ~F.col("ticker").isin(names))
        .distinct()
    )
    if cap is not None:
        listed = listed.orderBy("ticker").limit(max(0, cap - len(names)))
    listed = listed.withColumn("is_benchmark", F.lit(False))
    extra = tickers.sparkSession.createDataFrame([(n, True) for n in names], "ticker string, is_benchmark boolean")
    return listed.unionByName(extra)


def has_rows(df: DataFrame, pred: Column) -> bool:
    return not df.where(pred).limit(1).isEmpty()
