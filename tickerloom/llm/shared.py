"""Helpers that several operators need: stored intermediates, components, Arrow columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import checkpoint_dir as shared_folder

#: Fixed value: what separates words, as a Java regular expression. ``bytes.split()`` splits at the same characters.
GAP = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, options: dict | None = None, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here, and a lost executor costs a re-read.

    Rows lie apart ``by`` a column, if one is named.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(options or {})).partitionBy(*[by] if by else []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage: only then does Spark delete the shuffle files and broadcasts of finished stages."""
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(column: str):
    """A-Z become a-z, all else stays."""
    return F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a text column; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``limit`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node that has an edge.

    Root is the smallest node reachable. Each round takes the smallest label among the neighbours,
    with map-side combining, and then follows the label's own label, so the number of rounds grows
    with the logarithm of the diameter. Labels are stored between rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("next")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = step.join(jump, F.col("next") == F.col("via"), "left").select(
            "node", "was", F.least("next", F.coalesce("far", "next")).alias("root")
        )
        step = stored(step, "labels")
        labels = step.select("node", "root")
        if step.where("root <> was").limit(1).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
