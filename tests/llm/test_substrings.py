"""Substring operators against brute force, by words and by bytes."""

import brute
import cases
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import queries, repeats, suffix_automaton, suffix_sort


def digest(left):
    return {r.doc_id: (r.n_units, r.n_removed, len(r.spans), r.kept) for r in left.withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])).collect()}


@pytest.mark.parametrize("most_classes", [20_000, 1])
def test_words(spark, most_classes):
    got = digest(suffix_automaton.drop_repeated_words(cases.documents(spark), portion=2000, most_classes=most_classes))
    assert {k: (a, b, c, bytes(d)) for k, (a, b, c, d) in got.items()} == brute.without_repeats(cases.texts(), 20, True)


@pytest.mark.parametrize("most_classes", [20_000, 1])
def test_bytes(spark, most_classes):
    got = digest(suffix_sort.drop_repeated_bytes(cases.documents(spark), portion=2000, most_classes=most_classes))
    assert {k: (a, b, c, bytes(d)) for k, (a, b, c, d) in got.items()} == brute.without_repeats(cases.texts(), 100, False)


def test_queries(spark, tmp_path):
    folder = cases.table(spark, tmp_path, "documents", cases.documents(spark))
    want = brute.without_repeats(cases.texts(), 20, True)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op1_substring_dedup"](spark, folder).collect()}
    assert got == {d: (n, gone, brute.sha(kept)) for d, (n, gone, _, kept) in want.items()}
    want = brute.without_repeats(cases.texts(), 100, False)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op4_suffix_array_dedup"](spark, folder).collect()}
    assert got == {d: (n, gone, spans, brute.sha(kept)) for d, (n, gone, spans, kept) in want.items()}


def test_null_ids_and_repeated_rows(spark):
    text = cases.texts()[0][1]
    docs = cases.documents(spark, [(None, text), (5, text), (5, text), (9, text)])
    got = suffix_sort.drop_repeated_bytes(docs, keep=["lang", "row", "h"]).select("doc_id", F.length("kept").alias("n"), "text", "row.lang", "row.row").collect()
    assert sorted((r.doc_id or 0, r.n) for r in got) == [(0, len(text)), (5, len(text)), (5, len(text)), (9, 0)]
    assert {r.text for r in got} == {text, ""} and {r.row for r in got} == {2}


def test_empty_table(spark):
    assert suffix_automaton.drop_repeated_words(cases.documents(spark, [])).count() == 0


def test_automaton_statistics():
    shard = suffix_automaton.SuffixAutomaton()
    shard.add("abcabx", 100)
    shard.add("zabc", 210)
    shard.settle()
    assert [m for m, _ in shard.statistics("qabcz")] == [0, 1, 2, 3, 1]
    assert list(shard.origins("qabcz", 2)) == [None, None, 101, 102, None]
    assert list(shard.origins("zabcabx", 4)) == [None, None, None, 213, 103, 104, 105]


def test_long_runs_are_cut():
    import numpy as np

    first, count = repeats.runs(np.full(2500, 7, np.uint64), np.array([7], np.uint64))
    assert list(zip(first, count)) == [(0, 1024), (1024, 1024), (2048, 452)]
