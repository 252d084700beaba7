import math
import random
import zlib

import cases
from pyspark.sql import functions as F

from tickerloom.llm import language_id, queries

SYLLABLES = {"en": ["the", "ing", "an", "wh", "st", "ou"], "de": ["sch", "en", "ü", "er", "keit", "ei"], "fr": ["é", "que", "ou", "eau", "ai", "re"]}


def corpus(n=120):
    rng = random.Random(3)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rng.randint(8, 40))), lang) for i in range(n) for lang in [list(SYLLABLES)[i % 3]]]


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    odd = [(500, None, "en"), (501, "1234 ### 5", "en"), (502, "", None), (503, rows[0][1] * 400, None), (504, rows[1][1], None), (504, rows[1][1], None)]
    spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "doc_id long, text string, lang string, score int, held_out int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op5_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd)
    pred = {r.doc_id: r for r in got}
    for d, _, lang in rows:
        assert pred[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert pred[d].lang_pred == lang
        assert 0 <= pred[d].score <= 1
    assert [pred[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert pred[503].lang_pred == rows[0][2]


def code_length(train, order, text):
    """Bits of ``text`` by walking the contexts byte by byte."""
    counts = {}
    for t in train:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                c = counts.setdefault((k, t[i - k : i]), {})
                c[t[i]] = c.get(t[i], 0) + 1
    bits = 0.0
    for i, b in enumerate(text):
        for k in range(min(order, i), -1, -1):
            c = counts.get((k, text[i - k : i]))
            if c is None:
                continue
            total, kinds = sum(c.values()), len(c)
            if b in c:
                bits -= math.log2(c[b] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    rows = corpus(30)
    frame = spark.createDataFrame([(d, t, lang) for d, t, lang in rows], "key long, text string, lang string")
    model = language_id.fit(frame, per_language=100, order=3, least=1)
    texts = [b"", b"x", "thing sch é que".encode(), "zz \x00 ÿ the".encode(), rows[4][1].encode()]
    got = language_id.code_lengths(model, texts)
    for j, lang in enumerate(model.languages):
        train = [t.encode() for _, t, x in rows if x == lang]
        for i, t in enumerate(texts):
            assert math.isclose(got[i, j], code_length(train, 3, t), rel_tol=1e-4, abs_tol=1e-3)


def test_nothing_to_learn_from(spark):
    held = F.lit(False)
    docs = cases.documents(spark, [(11, "some text"), (22, None)])
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs, held).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(cases.documents(spark, []), held).count() == 0
