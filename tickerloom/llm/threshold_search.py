"""Hard negatives by the threshold algorithm over sorted lists, one list for each dimension.

Vectors are whole numbers, and a score is an inner product. Candidates are dealt into blocks by a hash of their id,
so that no label or group of copies can fill one; each block keeps, for every dimension, its members in the order of
that component. These lists are made once, written to the shared folder, and read by both searches:

1. the best rows of the anchor's own label (its positives);
2. for every positive, the best rows of other labels whose score lies in that positive's window.

A search walks all lists of a block at once, from the top where the anchor's component is positive and from the
bottom where it is negative (sorted access). A row met for the first time gets its full score (random access). No row
that is still unseen can score above the threshold, the sum of anchor x last value over the lists; a block is
left once the threshold is strictly below the k-th score found of every window, or below the window itself.
The best of all blocks are then the best of all rows: nothing is approximate.

A pair of one block of candidates and one slice of anchors is one group of a cogroup, so memory is bounded by the two
sizes, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Candidates of a block and anchors of a slice.
BLOCK_ROWS, SLICE_ROWS = 8192, 2048
#: Entries of each list that are read before the threshold is first looked at; then always as many again.
FIRST_DEPTH = 16

LISTS = "block long, dim int, ids binary, labels binary, matrix binary, orders binary"
ANCHORS = "block long, slice long, dim int, anchor_id long, label long, vector array<long>, positives array<struct<id: long, score: long>>"


def whole_vectors(rows: DataFrame, vector_col: str, scale: int) -> Column:
    """floor(scale x component) of rows that have only finite components; null for all others."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(v.isNotNull() & ~odd, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _exact(a: int, b: int, dims: int) -> type:
    """Number type in which inner products of components up to a and b are exact."""
    if a * b * max(dims, 1) < 2**53:
        return np.float64
    if a * b * max(dims, 1) < 2**63:
        return np.int64
    raise ValueError("components are too large: their inner products do not fit 64 bits")


def sorted_lists(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For each dimension the rows in ascending order of that component (shape: dims, rows)."""
    return np.argsort(matrix, axis=0, kind="stable").T.astype("<i4")


def threshold_search(
    matrix: np.ndarray, orders: np.ndarray, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int, first: int = FIRST_DEPTH
) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows met, their scores, depth reached), among them the k best allowed rows of each window and all ties.

    A window is (lowest, highest) score, both included. Rows that are not ``allowed`` are met, but never counted.
    """
    n = len(matrix)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen = np.zeros(n, bool)
    met, scores = np.empty(0, np.int64), np.empty(0, matrix.dtype)
    lo, hi = 0, min(first, n)
    if not len(up) and not len(down):  # every score is zero
        return np.flatnonzero(allowed), np.zeros(int(allowed.sum()), matrix.dtype), 0
    while lo < n:
        now = seen.copy()
        now[orders[up, n - hi : n - lo].ravel()] = True
        now[orders[down, lo:hi].ravel()] = True
        fresh = np.flatnonzero(now & ~seen)
        seen = now
        fresh = fresh[allowed[fresh]]
        met, scores = np.concatenate([met, fresh]), np.concatenate([scores, matrix[fresh] @ anchor])
        if seen.all():
            return met, scores, hi
        last = matrix[orders[up, n - hi], up] @ anchor[up] + matrix[orders[down, hi - 1], down] @ anchor[down]
        if all(last < max(low, _kth(scores, low, high, k)) for low, high in windows):
            return met, scores, hi
        lo, hi = hi, min(2 * hi, n)
    return met, scores, n


def _kth(scores: np.ndarray, low, high, k: int):
    """The k-th best score of a window so far; minus infinity if it has fewer."""
    inside = scores[(scores >= low) & (scores <= high)]
    return np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else -np.inf


def _best(met: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places in ``met`` of the k best scores, ties by smaller id."""
    return np.lexsort((ids[met], -scores))[:k]


def _build(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        matrix = group.column("vector").combine_chunks().flatten().to_numpy().reshape(len(group), dim)
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        row = (group.column("block")[0].as_py(), dim, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), matrix.astype("<i8").tobytes(), sorted_lists(ids, labels, matrix).tobytes())
        return pa.table([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

    return build


def _searcher(visit: Callable, schema: pa.Schema) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Cogroup function: the lists of one block against the anchors of one slice; ``visit`` gives rows of an anchor."""

    def search(lists: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(lists) and len(anchors):
            dim = lists.column("dim")[0].as_py()
            ids, labels, whole = (np.frombuffer(lists.column(c)[0].as_py(), "<i8") for c in ("ids", "labels", "matrix"))
            whole = whole.reshape(len(ids), dim)
            orders = np.frombuffer(lists.column("orders")[0].as_py(), "<i4").reshape(dim, len(ids))
            vectors = anchors.column("vector").combine_chunks().flatten().to_numpy().reshape(len(anchors), dim)
            kind = _exact(*(max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (whole, vectors)), dim)
            matrix = whole.astype(kind)
            for a, label, vector, found in zip(anchors.column("anchor_id").to_pylist(), anchors.column("label").to_pylist(), vectors.astype(kind), anchors.column("positives").to_pylist()):
                out += visit(a, label, vector, found, ids, labels, matrix, orders)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else schema.empty_table()

    return search


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id long, label long, vector array<long>): rows (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score).

    Positives of an anchor are its best ``positives`` other rows of equal label, ties by smaller id. Of every positive
    the best ``negatives`` rows of other labels with ``low`` x positive score <= 100 x score <= ``high`` x positive
    score are returned, ranked from 1. Only rows with as many components as the anchor are compared. Rows with a null
    id, label or vector take no part; of rows with the same id the one with the smallest label, then vector, stands
    for all. An anchor without positives, or a positive without negatives, has no row. Inner products that do not fit
    64 bits are an error.
    """
    whole = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select("id", "label", "vector", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    one = whole.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"), F.max("is_anchor").alias("is_anchor"))
    taking = stored(one.select("id", "r.label", "r.vector", F.size("r.vector").alias("dim"), "is_anchor"), "vectors")
    total = taking.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    blocks, slices = -(-total["n"] // block_rows) or 1, -(-total["a"] // slice_rows) or 1
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    lists_schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary()), ("orders", pa.binary())])
    dealt = taking.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "dim", "id", "label", "vector")
    lists = stored(dealt.groupBy("block", "dim").applyInArrow(_build(lists_schema), LISTS), "lists")
    lists = lists.withColumn("slice", F.explode(spread(slices))).groupBy("block", "slice", "dim")

    def against(anchors: DataFrame) -> DataFrame:
        cut = anchors.withColumns({"slice": F.pmod(F.xxhash64("anchor_id", F.lit(7)), F.lit(slices)), "block": F.explode(spread(blocks))})
        return cut.select("block", "slice", "dim", "anchor_id", "label", "vector", "positives").to(_struct(ANCHORS)).groupBy("block", "slice", "dim")

    anchors = taking.where("is_anchor").select("dim", F.col("id").alias("anchor_id"), "label", "vector")

    def of_own_label(a, label, vector, _, ids, labels, matrix, orders):
        allowed = (labels == label) & (ids != a)
        met, scores, _ = threshold_search(matrix, orders, vector, allowed, [(-np.inf, np.inf)], positives)
        return [(a, int(ids[met[i]]), int(scores[i])) for i in _best(met, ids, scores, positives)]

    found_schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    none = F.lit(None).cast("array<struct<id: long, score: long>>")
    found = lists.cogroup(against(anchors.withColumn("positives", none))).applyInArrow(_searcher(of_own_label, found_schema), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    found = found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))

    def in_windows(a, label, vector, found, ids, labels, matrix, orders):
        windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in found]
        open_ = [w for w in windows if w[0] <= w[1]]
        if not open_:
            return []
        met, scores, _ = threshold_search(matrix, orders, vector, labels != label, open_, negatives)
        out = []
        for p, (least, most) in zip(found, windows):
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for i in inside[_best(met[inside], ids, scores[inside], negatives)]:
                out.append((a, p["id"], int(ids[met[i]]), p["score"], int(scores[i])))
        return out

    pair_schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])
    pairs = lists.cogroup(against(anchors.join(found, "anchor_id"))).applyInArrow(
        _searcher(in_windows, pair_schema), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
