"""Near duplicates among embeddings by NN-descent.

Random hyperplanes give every vector first neighbours; rounds of a neighbours-of-neighbours join refine the lists;
edges above the threshold connect components. Links and nearer neighbours of other groups have lists of their own, so a
list that is full of links does not end the search; the links of a vector are then counted over all of its component,
in pairs of blocks that return counts, not pairs. A bounded sample of vectors is held against all rows to audit the
recall; too low a recall adds hyperplanes and repeats, and at last compares all blocks of a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import components, stored

CODE_BITS = 30
EDGE = "a long, b long, sim double"


def unit(rows: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of length 1, in double precision."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """(id, label, dim, embedding, copies): the distinct comparable vectors, named by their smallest vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding"))


def blocked(rows: DataFrame, keys: list[str], block: int, *salt) -> DataFrame:
    """``rows`` with the number ``nb`` of blocks of their group, and their block ``x`` (by hash of id and ``salt``)."""
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("nb", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    return rows.join(size, keys).withColumn("x", F.pmod(F.xxhash64("id", F.lit(5), *salt), F.col("nb")).cast("int"))


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, roots): a spanning forest of a symmetric link matrix, and the place each of its trees grew from."""
    unseen, a, b, roots = np.ones(len(link), bool), [], [], []
    for start in range(len(link)):
        if not unseen[start]:
            continue
        unseen[start], stack = False, [start]
        roots.append(start)
        while stack:
            x = stack.pop()
            new = np.flatnonzero(link[x] & unseen)
            unseen[new] = False
            stack.extend(new)
            a.append(np.full(len(new), x))
            b.append(new)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), np.array(roots, np.int64)


def first_neighbours(vectors: DataFrame, tables: range, k: int, least: float, threshold: float, seed: int, bucket: int = 128, block: int = 512) -> DataFrame:
    """Edges of at least ``least`` among vectors on the same side of all hyperplanes of a table.

    The number of hyperplanes follows the label's size, so buckets keep their size; a larger bucket is split into
    blocks, other ones in each table. Each vector reports its ``k`` nearest of a block, and each block a spanning
    forest of its links, so that no link between groups is lost to nearer vectors. One vector of every tree stands for
    it among the trees of the bucket's other blocks, level by level for as long as their number falls.
    """

    def codes(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for batch in batch_iter:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                v = unit(part.column("embedding"))
                for t in tables:
                    if (dim, t) not in planes:
                        planes[dim, t] = np.random.default_rng([seed, t, int(dim)]).standard_normal((dim, CODE_BITS))
                    code = (v @ planes[dim, t] > 0) @ (1 << np.arange(CODE_BITS, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(np.full(len(v), t, np.int32)), pa.array(code), part.column("id"), part.column("embedding")], names=["label", "dim", "t", "code", "id", "embedding"])

    shape = dict(vectors.dtypes)
    coded = vectors.select("label", "dim", "id", "embedding").mapInArrow(codes, f"label {shape['label']}, dim int, t int, code long, id long, embedding {shape['embedding']}")
    size = vectors.groupBy("label", "dim").agg(F.greatest(F.lit(0), F.least(F.lit(CODE_BITS), F.ceil(F.log2(F.count(F.lit(1)) / bucket)))).cast("int").alias("bits"))
    keyed = coded.join(size, ["label", "dim"]).withColumn("code", F.expr("code & (shiftleft(1L, bits) - 1)")).drop("bits")
    keyed = stored(keyed, "codes")

    def nearest(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            a, b, s, t = [], [], [], []
            for table, nb, ids, vs in zip(batch.column("t").to_pylist(), batch.column("nb").to_pylist(), batch.column("ids"), batch.column("vs")):
                ids, v = ids.values.to_numpy(), unit(vs.values)
                sims = v @ v.T
                np.fill_diagonal(sims, -2)
                row, col, trees = forest(sims >= threshold)
                a.append(ids[row])
                b.append(ids[col])
                s.append(sims[row, col])
                if len(ids) > 1:
                    top = np.argpartition(-sims, min(k, len(ids) - 1) - 1, axis=1)[:, : min(k, len(ids) - 1)]
                    near = np.take_along_axis(sims, top, 1)
                    row, col = np.nonzero(near >= least)
                    a.append(ids[row])
                    b.append(ids[top[row, col]])
                    s.append(near[row, col])
                t.append(np.full(sum(map(len, a)) - sum(map(len, t)), -1, np.int32))
                if nb > 1:  # what stands for the trees of this block
                    a.append(ids[trees])
                    b.append(ids[trees])
                    s.append(np.full(len(trees), 1.0))
                    t.append(np.full(len(trees), table, np.int32))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s, t)], names=["a", "b", "sim", "t"])

    found, rows, before = None, keyed, None
    for level in range(CODE_BITS):
        groups = blocked(rows, ["label", "dim", "t", "code"], block, F.col("t"), F.lit(level)).groupBy("label", "dim", "t", "code", "x").agg(F.max("nb").alias("nb"), F.collect_list("id").alias("ids"), F.collect_list("embedding").alias("vs"))
        out = stored(groups.select("t", "nb", "ids", "vs").mapInArrow(nearest, f"{EDGE}, t int"), "nearest")
        edges, trees = out.where("t < 0").drop("t"), out.where("t >= 0").select("t", F.col("a").alias("id"))
        found = edges if found is None else found.unionByName(edges)
        left = trees.count()
        if left == 0 or (before is not None and left > 0.75 * before):
            break
        rows, before = keyed.join(trees, ["t", "id"], "left_semi"), left
    return found


def lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The ``k`` best links of each vector and its ``k`` best neighbours below ``threshold``, of edges read in both
    directions: links do not push out the neighbours that lead to other groups."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return both.withColumn("_r", F.row_number().over(W.partitionBy("a", F.col("sim") >= threshold).orderBy(F.desc("sim"), "b"))).where(F.col("_r") <= k).drop("_r")


def similarity(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) with their cosine, where it is at least ``least``."""
    va = vectors.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    vb = vectors.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batch_iter:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                sims = np.array([], float)
                if batch.num_rows:
                    sims = np.concatenate([(unit(batch.column("va").slice(i, 1)) * unit(batch.column("vb").slice(i, 1))).sum(1) for i in range(batch.num_rows)]) if len(set(map(len, batch.column("va")))) > 1 else (unit(batch.column("va")) * unit(batch.column("vb"))).sum(1)
                good = pa.array(sims >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], names=["a", "b", "sim"]).filter(good)

    return pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(run, EDGE)


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of the components after ``edges`` (a, b) join those of ``roots``."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = edges.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    ends = stored(ends, "ends")
    joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    fresh = ends.select(F.col("a").alias("node"), F.col("ra").alias("root")).unionByName(ends.select(F.col("b").alias("node"), F.col("rb").alias("root")))
    every = roots.unionByName(fresh).distinct()
    return stored(every.join(joined.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")


def refine(edges: DataFrame, vectors: DataFrame, k: int, least: float, threshold: float, rounds: int | None) -> tuple[DataFrame, DataFrame]:
    """(edges, roots) after neighbours of neighbours, ``rounds`` times or (None) until nothing new is near enough.

    Vectors of one component are not proposed to each other: all their links are counted later.
    """
    known = stored(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim")), "edges")
    roots = components(known.where(F.col("sim") >= threshold))
    done = 0
    while rounds is None or done < rounds:
        near = stored(lists(known, k, threshold), "lists")
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        via = near.select(F.col("a").alias("m"), F.col("b").alias("c")).join(root("c"), "c", "left").select("m", "c", F.coalesce("rc", "c").alias("rc"))
        start = near.select("a", F.col("b").alias("m")).join(root("a"), "a", "left").select("a", "m", F.coalesce("ra", "a").alias("ra"))
        pairs = start.join(via, "m").where("ra <> rc").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
        new = stored(similarity(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), vectors, least), "near")
        if new.limit(1).isEmpty():
            break
        known, done = known.unionByName(new), done + 1
        links = new.where(F.col("sim") >= threshold)
        if not links.limit(1).isEmpty():
            roots = merged(roots, links.select("a", "b"))
    return known, roots


def links_between(vectors: DataFrame, roots: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(a, b): a link for every two components that have one, found by comparing all blocks of each label."""
    members = vectors.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("label", "dim", "id", F.coalesce("root", "id").alias("root"), "embedding")
    members = blocked(members, ["label", "dim"], block)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda y: F.struct(F.least("x", y).alias("x"), F.greatest("x", y).alias("y"))))
    units = members.withColumn("p", pair).groupBy("label", "dim", "p").agg(*[F.collect_list(c).alias(c) for c in ("id", "root", "embedding")])

    def between(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for ids, own, vs in zip(*[batch.column(c) for c in ("id", "root", "embedding")]):
                ids, own, v = ids.values.to_numpy(), own.values.to_numpy(), unit(vs.values)
                row, col = np.nonzero((v @ v.T >= threshold) & (own[:, None] < own[None, :]))
                one = np.unique(np.stack([own[row], own[col]]), axis=1, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[one]]), pa.array(ids[col[one]])], names=["a", "b"])

    return units.select("id", "root", "embedding").mapInArrow(between, "a long, b long")


def count_links(vectors: DataFrame, roots: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, links): for every vector of a component, how many vectors of it (copies counted) are links."""
    members = vectors.join(roots.select(F.col("node").alias("id"), "root"), "id").select("root", "id", "copies", "embedding")
    members = blocked(members, ["root"], block)
    lone = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda y: F.struct(F.least("x", y).alias("x"), F.greatest("x", y).alias("y"))))
    spread = members.select("root", "id", "copies", "embedding", F.col("x").alias("own"), lone.alias("p")).select("root", "p.x", "p.y", "own", "id", "copies", "embedding")
    units = spread.groupBy("root", "x", "y").agg(*[F.collect_list(c).alias(c) for c in ("own", "id", "copies", "embedding")])

    def count(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            ids, totals = [], []
            for x, y, own, members, copies, vs in zip(*[batch.column(c) for c in ("x", "y", "own", "id", "copies", "embedding")]):
                own, members, copies, v = own.values.to_numpy(), members.values.to_numpy(), copies.values.to_numpy(), unit(vs.values)
                link = v @ v.T >= threshold
                if x.as_py() != y.as_py():
                    link &= own[:, None] != own[None, :]
                else:
                    np.fill_diagonal(link, False)
                ids.append(members)
                totals.append(link @ copies)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(totals).astype(np.int64))], names=["id", "links"])

    return units.select("x", "y", "own", "id", "copies", "embedding").mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(vectors: DataFrame, roots: DataFrame, threshold: float, sample: int, step: int = 0, least_of_class: int = 32) -> float:
    """Share of a vector's true links that lie inside its component, the mean over those of at most ``sample`` vectors
    that have links. Vectors of like many links (powers of two) also count by themselves where they are at least
    ``least_of_class``, and the lowest mean is returned, so large groups do not hide small ones. Reads all rows once."""
    asked = vectors.orderBy(F.xxhash64("id", F.lit(3 + step)), "id").select("id", "label", "embedding").limit(sample).collect()
    by_key: dict = {}
    for row in asked:
        by_key.setdefault((row["label"], len(row["embedding"])), []).append((row["id"], row["embedding"]))
    queries = {key: (np.array([i for i, _ in rows]), unit(pa.array([v for _, v in rows], pa.list_(pa.float64())))) for key, rows in by_key.items()}

    def true_links(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            labels, dims = batch.column("label").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
            for (label, dim), (ids, q) in queries.items():
                part = batch.filter(pa.array((labels == label) & (dims == dim)))
                if part.num_rows:
                    others = part.column("id").to_numpy()
                    row, col = np.nonzero((q @ unit(part.column("embedding")).T >= threshold) & (ids[:, None] != others[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(others[col])], names=["a", "b"])

    pairs = vectors.select("id", "label", "dim", "embedding").mapInArrow(true_links, "a long, b long")
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    each = pairs.join(ra, "a", "left").join(rb, "b", "left").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ra") == F.col("rb")).alias("hit")).collect()
    if not each:
        return 1.0
    share, size = np.array([r["hit"] / r["n"] for r in each]), np.array([r["n"].bit_length() for r in each])
    return min(share.mean(), *(share[size == x].mean() for x in np.unique(size) if (size == x).sum() >= least_of_class), 1.0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, k: int = 16, tables: int = 8, rounds: int | None = None, promising: float = 0.8, target: float = 0.97, sample: int = 1024, repeats: int = 3, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Vectors are compared when their labels and dimensions are equal; equal vectors are one class and never paired. Null,
    zero or non-finite vectors, and rows with a null label or id, have no link and are their own component (a null id: a
    null component, not kept). ``promising`` is the least cosine that the refinement follows. ``sample`` bounds the
    audit; below ``target``, as many tables again are added and ``k`` is doubled, up to ``repeats`` times, and if that is
    not enough, all components of a label are compared. ``rounds`` None refines until nothing new is found. Repeated rows
    count as vectors.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    distinct = stored(classes(source), "vectors")
    edges = None
    for step in range(repeats + 1):
        more = first_neighbours(distinct, range(step * tables, (step + 1) * tables), k << step, promising, threshold, seed)
        edges, roots = refine(more if edges is None else edges.unionByName(more), distinct, k << step, promising, threshold, rounds)
        if audit(distinct, roots, threshold, sample, step) >= target:
            break
    else:
        missed = stored(links_between(distinct, roots, threshold), "missed")
        roots = merged(roots, missed)
    links = stored(count_links(distinct, roots, threshold), "links")
    known = distinct.join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    out = source.join(known, ["label", "embedding"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"))
