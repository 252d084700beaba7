import math
import random

import brute

from tickerloom.llm import embedding, queries

SCHEMA = "vec_id long, embedding array<float>, label int, root long, id int, x string"


def corpus():
    rng = random.Random(6)
    vector = lambda: [rng.gauss(0, 1) for _ in range(16)]
    near = lambda v, s: [x + rng.gauss(0, s) for x in v]
    rows, i = [], 0
    for label in (0, 1):
        centre = vector()
        for v in [*[near(centre, 0.1) for _ in range(40)], *[vector() for _ in range(60)]]:
            rows.append((i, v, label))
            i += 1
            if rng.random() < 0.2:
                rows.append((i, near(v, 0.05), label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 1), (i + 2, rows[0][1], None), (i + 3, None, 0), (i + 4, [0.0] * 16, 0), (i + 5, [None] + rows[0][1][1:], 0)]
    rows += [(i + 6, [math.inf] + rows[0][1][1:], 0), (i + 7, [math.nan] * 16, 0), (i + 8, [], 0), (i + 9, [1.0, 2.0], 0), (i + 10, [2.0, 4.0], 0)]
    import numpy as np

    return [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for a, v, c in rows]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def test_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.QUERIES["op7_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    by_id = {i: (v, label) for i, v, label in rows}
    usable = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        (v, m), (w, n) = by_id[a], by_id[b]
        return m is not None and m == n and usable(v) and usable(w) and len(v) == len(w) and cosine(v, w) >= 0.93

    roots = brute.components(sorted(by_id), linked)
    assert len(got) == len(rows)
    for i in by_id:
        assert got[i].n_links == sum(linked(i, j) for j in by_id if j != i), i
        assert got[i].component_id == roots[i] and got[i].kept == (i == roots[i])


def test_large_components_are_counted_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [1 + rng.random() * 0.01, rng.random() * 0.3, rng.random() * 0.3], 0) for i in range(50)]
    vectors = embedding.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    roots = spark.createDataFrame([(i, 0) for i in range(50)], "node long, root long")
    got = {r.id: r.links for r in embedding.count_links(vectors, roots, 0.97, block=7).collect()}
    assert got == {i: sum(cosine(v, w) >= 0.97 for j, w, _ in rows if j != i) for i, v, _ in rows}


def test_null_id_and_empty_table(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (4, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding.near_duplicates(frame).collect()))
    # a row without an id is not a vector that others link to; the repeated rows link each other
    assert [g[:1] + g[2:] for g in got] == [(0, 4, False), (4, 4, True), (4, 4, True)] and got[1][1] == got[2][1] == 1
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def groups_of(rows, spark):
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    return {r.component_id for r in got}, {r.n_links for r in got}, sum(r.kept for r in got)


def test_a_tight_group_larger_than_two_blocks_is_one_component(spark):
    rng = random.Random(7)
    centre = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 1e-4) for x in centre], 0) for i in range(1300)]
    assert groups_of(rows, spark) == ({0}, {1299}, 1)


def test_groups_that_fill_their_own_lists_are_linked(spark):
    rng = random.Random(4)
    rows = [(i, [1.0, 0.3 * (i % 2), *[rng.gauss(0, 1e-3) for _ in range(6)]], 0) for i in range(60)]
    assert 0.93 < cosine(rows[0][1], rows[1][1]) < 0.97
    assert groups_of(rows, spark) == ({0}, {59}, 1)


def test_links_between_components_and_audit_of_small_groups(spark):
    rng = random.Random(5)
    # a hot group that is whole, and 40 pairs that are apart
    rows = [(i, [1.0, *[rng.gauss(0, 1e-3) for _ in range(47)]], 0) for i in range(100)]
    rows += [(100 + i, [0.0] * (2 + i // 2) + [1.0] + [0.001 * (i % 2)] + [0.0] * (44 - i // 2), 0) for i in range(80)]
    vectors = embedding.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    roots = spark.createDataFrame([(i, 0) for i in range(100)], "node long, root long")
    assert embedding.audit(vectors, roots, 0.93, 1024) == 0
    missed = embedding.links_between(vectors, roots, 0.93, block=31)
    assert sorted({(min(r), max(r)) for r in missed.collect()}) == [(i, i + 1) for i in range(100, 180, 2)]
    whole = embedding.merged(roots, missed)
    assert embedding.audit(vectors, whole, 0.93, 1024) == 1
