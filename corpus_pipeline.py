"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's documents. All but the last return the columns of the documents they got. A null id is neither compared
nor mixed, so such a row ends at the mixing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import mixing, packing, quality, queries, simhash, suffix_sort
from tickerloom.llm.shared import documents, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs).where("_kept").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates; rows without an id stay."""
    kept = simhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stood earlier in the corpus; ``n_chars`` follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = suffix_sort.drop_repeated_bytes(docs, keep=others)
    out = left.select("doc_id", "text", *[F.col("row")[c].alias(c) for c in others])
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights, once per epoch that takes them; one in which a budget ends is taken whole."""
    leaves = mixing.plan(docs, queries.mix_levels(), queries.MIX_WEIGHTS, None, queries.MIX_EPOCHS, queries.MIX_SEED)
    return mixing.select(docs, leaves, queries.mix_levels(), queries.MIX_SEED).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of one document each, see ``packing``."""
    return queries.packed_rows(packing.pack(docs, queries.vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: Hashes of the near-duplicate stage and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
