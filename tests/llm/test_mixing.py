from collections import Counter, defaultdict

import cases
import duckdb
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import mixing, queries


def rows(df):
    return sorted(tuple(r[c] for c in ("doc_id", "domain", "language", "origin", "epoch", "n_tokens", "taken")) for r in df.collect())


def test_query_equals_sql(spark, tmp_path):
    folder = cases.table(spark, tmp_path, "documents", cases.documents(spark, cases.texts(9)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op9_mixing"]).fetchall()
    assert rows(queries.QUERIES["op9_mixing"](spark, folder)) == sorted(want)


def shares(budget, nodes):
    """Water filling, one unit of shortage after the other: {name: share} for {name: (weight, cap)}."""
    out, open_, left = {}, dict(nodes), budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c * total < left * w}
        if not full:
            return out | {n: min(c, left * w // total) for n, (w, c) in open_.items()}
        n = min(full, key=lambda n: (open_[n][1] / open_[n][0], n))
        out[n] = full[n]
        left -= full[n]
        del open_[n]
    return out


@pytest.mark.parametrize("budget", [0, 1, 17, 60, 119, 120])
def test_shortages_go_to_siblings(spark, budget):
    nodes = {"a": (5, 10), "b": (3, 50), "c": (1, 40), "d": (1, 20)}
    frame = spark.createDataFrame([(n, n, w, c, budget) for n, (w, c) in nodes.items()], "leaf string, name string, weight long, cap long, budget long")
    got = {r.name: r.share for r in mixing.shares(frame, [F.lit(0)], "budget").collect()}
    assert got == shares(budget, nodes)


def test_leaf_prefix_and_epochs(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "x" if i % 4 else "y") for i in range(200)], "doc_id long, text string, s string")
    levels = {"s": F.col("s")}
    got = mixing.mix(docs, levels, [{"x": 1, "y": 3}], total=700, max_epochs=4).collect()
    taken = Counter()
    per_epoch = defaultdict(set)
    for r in got:
        taken[r.s] += r.taken
        assert 0 < r.taken <= r.n_tokens and r.doc_id not in per_epoch[r.s, r.epoch]
        per_epoch[r.s, r.epoch].add(r.doc_id)
    assert taken == {"x": 175, "y": 525}
    assert sum(r.taken < r.n_tokens for r in got) <= 2
    assert all(len(per_epoch["y", e]) == 50 for e in range(525 // sum(i % 7 + 1 for i in range(0, 200, 4))))


def test_awkward_tables(spark):
    levels = {"s": mixing.named("source")}
    assert mixing.mix(cases.documents(spark, []), levels, [{}]).count() == 0
    got = mixing.mix(cases.documents(spark, [(None, "a b"), (1, None), (2, " "), (3, "a b c"), (3, "a b c")]), levels, [{}]).collect()
    assert [(r.doc_id, r.taken) for r in got] == [(3, 3), (3, 3)]


def test_totals_need_no_window_over_all_leaves(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 60)], "domain string, origin string, tokens long")
    got = mixing.leaf_budgets(leaves, ["domain", "origin"], [{"*": 1}, {"*": 1}], None, 4)
    assert "windowspecdefinition(specifiedwindowframe" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, got.collect())) == [("a", "x", 10, 25), ("a", "y", 30, 25), ("b", "x", 60, 50)]
