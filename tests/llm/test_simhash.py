import brute
import cases
import pytest

from tickerloom.llm import queries, simhash


@pytest.mark.parametrize(("large", "block", "segments"), [(256, 512, 3), (1, 2, 3), (1, 2, 2)])
def test_links(spark, large, block, segments):
    import random

    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(6)} | {0, 3, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = {(r.a, r.b) for r in simhash.links(frame, 4, segments, large, block).collect()}
    ids = sorted(signed(x) for x in fps)
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    assert all(near(a, b) for a, b in edges)
    assert brute.components(ids, lambda a, b: (a, b) in edges) == brute.components(ids, near)


def test_query(spark, tmp_path):
    rows = cases.texts()
    folder = cases.table(spark, tmp_path, "documents", cases.documents(spark, rows))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op2_simhash_near_dedup"](spark, folder).collect()}
    assert got == brute.simhash(rows)


def test_awkward_rows(spark):
    docs = cases.documents(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "only here"), (9, None)])
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(0, 7, False), (7, 7, True), (7, 7, True), (0, None, False), (9, 9, True)], key=str)
    assert simhash.near_duplicates(cases.documents(spark, [])).count() == 0


def test_every_near_value_is_asked_for():
    for segments in (2, 3, 4):
        plan = simhash.plan_segments(4, segments)
        assert sum(w for _, w, _ in plan) <= 64 and (segments != 4 or [r for *_, r in plan] == [1, 0, 0, 0])
