"""The whole pipeline against brute force, stage after stage."""

import brute
import cases
import corpus_pipeline
import duckdb
import pandas as pd
from tokenizers import Tokenizer

from tickerloom.llm import queries


def by_hand(docs):
    docs = docs[[*brute.good(list(docs.text))]]
    rows = list(zip(docs.doc_id, docs.text))
    first = {d for d, (_, root) in brute.simhash(rows).items() if d == root}
    docs = docs[docs.doc_id.isin(first)]
    left = brute.without_repeats(list(zip(docs.doc_id, docs.text)), 100, False)
    docs = docs.assign(text=[left[d][3].decode("utf-8", "ignore") for d in docs.doc_id])
    con = duckdb.connect()
    con.register("documents", docs)
    order = con.sql(queries.mix_sql()).fetchall()
    model = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    texts = dict(zip(docs.doc_id, docs.text))
    out = []
    for row in order:
        ids = [*model.encode(texts[row[0]], add_special_tokens=False).ids, 1]
        out += [(row[0], *p, len(ids)) for p in brute.pieces(ids)]
    return sorted(out)


def test_run(spark, tmp_path):
    rows = cases.texts(3) + [(d + 500, t) for d, t in cases.texts(4) if t]
    frame = cases.documents(spark, rows)
    folder = cases.table(spark, tmp_path, "documents", frame)
    got = corpus_pipeline.run(spark, folder).collect()
    docs = pd.DataFrame([r.asDict() for r in frame.collect()])[["doc_id", "text", "lang", "source"]].astype(object)
    docs = docs.where(docs.notna(), None)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == by_hand(docs)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    empty = cases.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0, name
    docs = cases.documents(spark, [(1, "x y z " * 30), (None, "p q r " * 40), (1, "x y z " * 30)])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == ["1", "None"]
    left = corpus_pipeline.without_repeats(spark, cases.documents(spark, [(1, "é" * 60), (2, "a" + "é" * 60), (3, None)]), "").collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in left} == {(1, "é", 1), (2, "a", 1), (3, None, None)}
