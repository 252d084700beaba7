"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree (domain, language, source). At each node the children get their weights'
shares; a child that cannot use its share (its texts, repeated for at most ``max_epochs`` epochs, are too few)
leaves the rest to its siblings, and only what no sibling can use goes back to the ancestors. A leaf then
reads whole epochs and, of the last one, the token prefix of a seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import GAP, stored

#: Rows of a leaf are ordered in this many slices (first hex digits of the order key), so that no window holds a whole leaf.
SLICE_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, GAP), lambda x: x != "")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Seeded order of an epoch, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")))


def named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("(none)"))


def weight(column: str, weights: Mapping[str, int]) -> Column:
    """Whole-number weight of a node by its name; names that are not listed weigh ``weights['*']``, by default 1."""
    out = F.lit(int(weights.get("*", 1)))
    for name, w in weights.items():
        if name != "*":
            out = F.when(F.col(column) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def shares(nodes: DataFrame, parent: Sequence[str], budget: str) -> DataFrame:
    """Adds ``share`` to rows with weight, cap and the parent's ``budget`` (at most the sum of the caps).

    Children in order of cap / weight: those at the front, whose share would exceed their cap, get the cap, and the
    others split what is left by weight. Whole numbers throughout, rounded down.
    """
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "name")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    out = nodes.withColumns({"_before": before, "_rest": rest})
    left = F.col(budget) - F.col("_before")
    out = out.withColumn("_fits", F.col("cap") * F.col("_rest") >= left * F.col("weight"))
    first = F.min(F.when(F.col("_fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "name", left.alias("left"), F.col("_rest").alias("rest")))).over(W.partitionBy(*parent))
    out = out.withColumn("_cut", first)
    part = F.expr("(_cut.left * weight) div _cut.rest")
    behind = F.struct((F.col("cap") / F.col("weight")).alias("at"), "name") < F.struct("_cut.at", "_cut.name")
    return out.withColumn("share", F.when(F.col("_cut").isNull() | behind, F.col("cap")).otherwise(F.least("cap", part))).drop("_before", "_rest", "_fits", "_cut")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], total: int | None, max_epochs: int) -> DataFrame:
    """(levels..., tokens, budget) from (levels..., tokens): one row per leaf."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for level, w in zip(levels, weights):
        nodes = nodes.withColumn(f"w_{level}", weight(level, w))
    nodes = nodes.withColumn("cap", F.when(F.least(*[F.col(f"w_{c}") for c in levels], F.lit(1)) > 0, F.col("cap")).otherwise(0))
    sums = nodes.agg(F.sum("tokens").alias("_tokens"), F.sum("cap").alias("_cap"))
    wanted = F.col("_tokens") if total is None else F.lit(int(total)).cast("long")
    nodes = nodes.crossJoin(F.broadcast(sums)).withColumn("budget", F.least(wanted, "_cap")).drop("_tokens", "_cap")
    for depth, level in enumerate(levels):
        parent, own = list(levels[:depth]), list(levels[: depth + 1])
        here = nodes.where("cap > 0").groupBy(*own).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("weight"), F.max("budget").alias("budget"))
        here = shares(here.withColumn("name", F.col(level)), parent or [F.lit(0)], "budget").select(*own, "share")
        nodes = nodes.drop("budget").join(here, own, "left").withColumn("budget", F.coalesce("share", F.lit(0))).drop("share")
    return nodes.select(*levels, "tokens", "budget")


def plan(docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]], total: int | None = None, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per leaf: levels, tokens, budget, epochs (whole ones), rest, and where the last epoch ends.

    Rows are summed per leaf and slice with map-side combining; only the one slice per leaf in which the prefix
    ends is ordered row by row. ``tokens`` counts a row's tokens (default: words); rows without tokens or with a
    null id are never selected.
    """
    names = list(levels)
    count = n_words(F.col(text_col)) if tokens is None else tokens
    slim = docs.select(F.col(id_col).alias("_id"), *[c.alias(n) for n, c in levels.items()], count.alias("_n"))
    slim = stored(slim.where("_n > 0 AND _id IS NOT NULL"), "mixing")
    leaves = leaf_budgets(slim.groupBy(*names).agg(F.sum("_n").alias("tokens")), names, weights, total, max_epochs)
    leaves = stored(leaves.withColumns({"epochs": F.expr("budget div tokens"), "rest": F.expr("budget % tokens")}), "leaves")
    keyed = slim.join(leaves.where("rest > 0").select(*names, "epochs", "rest"), names).withColumn("_key", order_key(seed, F.col("epochs"), F.col("_id")))
    keyed = keyed.withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    slices = keyed.groupBy(*names, "_slice").agg(F.sum("_n").alias("_sum"), F.max("rest").alias("rest"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*names).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = slices.withColumn("_before", before).where("_before < rest AND _before + _sum >= rest").select(*names, "_slice", "_before")
    run = W.partitionBy(*names).orderBy("_key", "_id").rowsBetween(W.unboundedPreceding, -1)
    inner = keyed.join(ends, [*names, "_slice"]).withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(run), F.lit(0)))
    last = inner.where("_start < rest").groupBy(*names).agg(F.max(F.struct("_key", "_id", (F.col("rest") - F.col("_start")).alias("part"))).alias("end"))
    return stored(leaves.join(last, names, "left"), "plan")


def select(docs: DataFrame, leaves: DataFrame, levels: Mapping[str, Column], seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Rows of ``docs``, once per epoch that takes them, with _epoch, _tokens and _taken besides their own columns.

    ``_taken`` is below ``_tokens`` only for the document in which a leaf's budget ends. The small table of leaves
    decides row by row; documents are not shuffled for it unless that table is too large to send.
    """
    names = list(levels)
    count = n_words(F.col(text_col)) if tokens is None else tokens
    small = leaves.select(*[F.col(n).alias(f"_at_{n}") for n in names], F.col("epochs").alias("_whole"), F.col("end").alias("_end"))
    out = docs.withColumns({f"_lv_{n}": c for n, c in levels.items()} | {"_tokens": count}).where((F.col("_tokens") > 0) & F.col(id_col).isNotNull())
    out = out.join(small, [F.col(f"_lv_{n}") == F.col(f"_at_{n}") for n in names])
    own = F.struct(order_key(seed, F.col("_whole"), F.col(id_col)).alias("_key"), F.col(id_col).alias("_id"))
    end = F.struct(F.col("_end._key").alias("_key"), F.col("_end._id").alias("_id"))
    partial = F.col("_end").isNotNull() & (own <= end)
    out = out.withColumn("_partial", partial).withColumn("_last", partial & (own == end))
    times = F.col("_whole") + F.col("_partial").cast("long")
    out = out.where(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    taken = F.when(F.col("_last") & (F.col("_epoch") == F.col("_whole")), F.col("_end.part")).otherwise(F.col("_tokens"))
    return out.withColumn("_taken", taken)


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]], total: int | None = None, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(id, levels..., epoch, n_tokens, taken): one row per document and epoch that takes it.

    ``levels`` names the tree's levels from the top with the column of each (null should be given a name, see
    ``named``); ``weights`` has one mapping of whole numbers per level, see ``weight``. ``total`` is the token
    budget (default: all tokens once). An empty table gives no rows. Rows that repeat a doc_id share its place in
    the order; where a budget ends at such a place, each of them is taken alike.
    """
    leaves = plan(docs, levels, weights, total, max_epochs, seed, id_col, text_col, tokens)
    rows = select(docs.select(id_col, text_col, *[c for c in _used(docs, levels, tokens) if c not in (id_col, text_col)]), leaves, levels, seed, id_col, text_col, tokens)
    return rows.select(F.col(id_col).alias("doc_id"), *[F.col(f"_lv_{n}").alias(n) for n in levels], F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_taken").alias("taken"))


def _used(docs: DataFrame, levels: Mapping[str, Column], tokens: Column | None) -> list[str]:
    """Columns of ``docs`` that the expressions may read; the optimiser prunes the others."""
    return [c for c in docs.columns]
