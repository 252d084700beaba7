import math

import numpy as np
import pytest

from tickerloom.llm import queries, threshold_search

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector int, dim int, slice int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, b, "x", 1, 2, 3) for i, v, b in rows], SCHEMA).repartition(3)


def vectors(seed=5, n=420, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[i % 12] + rng.normal(size=dims) * (0.02 if i % 3 else 0.6)
        rows.append((i, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], i % 5))
    for i in range(n, n + 60):  # copies: ties
        rows.append((i, rows[i % 7][1], i % 4))
    nan = float("nan")
    odd = [(500, None, 1), (550, [nan] * dims, 1), (600, [1.0] * dims, None), (650, [None] + [0.5] * (dims - 1), 2), (700, [0.0] * dims, 2), (750, [float("inf")] + [0.1] * (dims - 1), 2)]
    return rows + odd + [(None, [0.5] * dims, 2), (800, [1.0, 2.0], 1), (801, [1.0, 1.0], 1), (802, [0.7, 1.1], 3), (850, [], 1), (851, [], 2), (900, rows[9][1], 9)]


def plain(rows):
    taking = {}
    for i, v, b in rows:
        if i is None or v is None or b is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taking[i] = ([math.floor(256 * float(x)) for x in v], (b + 1) % 10 if i % 7 == 0 else b)
    out = set()
    for a, (va, label) in taking.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, b) for i, (v, b) in taking.items() if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            ranked = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out |= {(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 60, "slice_rows": 3}])
def test_query(spark, tmp_path, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(threshold_search.mine, "__defaults__", (5, 3, 50, 95, 60, 3))
    rows = vectors()
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    matrix = rng.integers(-40, 40, size=(5000, 4)).astype(float)
    matrix[17] = matrix[18] = [200, -200, 200, 0]
    anchor = np.array([3.0, -2.0, 1.0, 0.0])
    orders = threshold_search.sorted_lists(None, None, matrix)
    allowed = np.ones(5000, bool)
    met, scores, depth = threshold_search.threshold_search(matrix, orders, anchor, allowed, [(-np.inf, np.inf)], 2)
    assert depth < 5000 and {17, 18} <= set(met) and (scores == matrix[met] @ anchor).all()
    low, high = 100, 150
    met, scores, depth = threshold_search.threshold_search(matrix, orders, anchor, allowed, [(low, high)], 3)
    every = matrix @ anchor
    best = np.sort(every[(every >= low) & (every <= high)])[-3:]
    assert depth < 5000 and set(np.flatnonzero((every >= best[0]) & (every <= high))) <= set(met)
    met, *_ = threshold_search.threshold_search(matrix, orders, np.zeros(4), allowed, [(0, 0)], 3)
    assert len(met) == 5000


def test_awkward_tables(spark):
    shape = "id long, label long, vector array<long>"
    none = threshold_search.mine(spark.createDataFrame([], shape), threshold_search.F.col("id") == 0)
    assert none.count() == 0
    rows = spark.createDataFrame([(0, 1, [2, 0]), (0, 1, [2, 0]), (1, 1, [10, 0]), (2, 2, [8, 0]), (3, 2, [9, 5]), (4, 2, None), (5, None, [1, 1])], shape)
    got = threshold_search.mine(rows, threshold_search.F.col("id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 3, 20, 18), (0, 1, 2, 2, 20, 16)]
    big = spark.createDataFrame([(0, 1, [2**40]), (1, 1, [2**40])], shape)
    with pytest.raises(Exception, match="too large"):
        threshold_search.mine(big, threshold_search.F.col("id") == 0).collect()
    large = spark.createDataFrame([(0, 1, [2**30, 1]), (1, 1, [2**30, 3]), (2, 2, [2**29, 2])], shape)
    assert [r.negative_score for r in threshold_search.mine(large, threshold_search.F.col("id") == 0).collect()] == [2**59 + 2]
