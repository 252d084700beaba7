import random

import brute
import cases

from tickerloom.llm import quality, queries


def corpus():
    rng = random.Random(8)
    rows = cases.texts(2) + [(1000 + i, cases.prose(rng, rng.randint(40, 150))) for i in range(60)]
    rows += [(2000 + i, " ".join(w + "###" for w in cases.prose(rng, 70).split())) for i in range(9)]
    return rows


def test_base_counts_and_verdict(spark, tmp_path):
    rows = corpus()
    folder = cases.table(spark, tmp_path, "documents", cases.documents(spark, rows))
    got = {r.doc_id: r for r in queries.QUERIES["op6_quality_rules"](spark, folder).collect()}
    keep = dict(zip([d for d, _ in rows], brute.good([t for _, t in rows])))
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(t), d
        assert r.base_failed == brute.base_failed(t)
        assert r.kept == keep[d], d
    assert not any(got[2000 + i].kept for i in range(9)) and all(got[1000 + i].kept for i in range(60))


def test_no_python_on_the_main_path(spark, tmp_path):
    folder = cases.table(spark, tmp_path, "documents", cases.documents(spark))
    plan = quality.features(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))


def test_empty_and_repeated(spark):
    assert quality.score(cases.documents(spark, [])).count() == 0
    rows = quality.score(cases.documents(spark, [(None, "a"), (1, None), (1, None)])).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in sorted(rows, key=lambda r: str(r.doc_id))] == [(0, True, False), (0, True, False), (1, True, False)]
