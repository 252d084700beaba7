from collections import defaultdict

import brute
import cases
import pytest

from tickerloom.llm import packing, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.vocabulary("word_bpe_49k.json")
ODD = ["It's I'd we'll <|endoftext|>x a<|startoftext|>", "İstanbul É é é 12ab34 ---", "　a ##ab## ½ ªº µm ß ẞ ﬁ", "x" * 5000, "日本語 한국 🙂🙂 a'b'c 's 'S", "a\x00b \x1f \x85"]


def test_round_trip(spark, tmp_path):
    rows = cases.texts() + [(900 + i, t) for i, t in enumerate(ODD)]
    folder = cases.table(spark, tmp_path, "documents", cases.documents(spark, rows))
    model = tokenizers.Tokenizer.from_file(PATH)
    got = defaultdict(list)
    sequences = set()
    for r in queries.QUERIES["op10_packing"](spark, folder).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        assert r.offset == 0 and r.sequence_id not in sequences and r.bucket == r.length <= 2048
        sequences.add(r.sequence_id)
    for d, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        assert sorted(got[d]) == [(*p, len(ids)) for p in brute.pieces(ids)], d


def test_binary_pieces():
    assert packing.pieces_of(13, 8) == [(0, 8), (8, 4), (12, 1)]
    assert packing.pieces_of(17, 8) == [(0, 8), (8, 8), (16, 1)]
    assert packing.pieces_of(0, 8) == []


def test_memory_may_be_emptied(monkeypatch):
    texts = [t.encode() for _, t in cases.texts() if t]
    want = list(packing.token_bytes(PATH, texts))
    monkeypatch.setattr(packing, "WORDS_KEPT", 5)
    assert [x for t in texts for x in packing.token_bytes(PATH, [t])] == want


def test_awkward_tables(spark, tmp_path):
    got = packing.pack(cases.documents(spark, [(None, "a"), (1, None), (1, None)]), PATH)
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in got.collect()) == [(0, 2, 2), (1, 1, 1), (1, 1, 1)]
    assert packing.pack(cases.documents(spark, []), PATH).count() == 0
    packing.write_buckets(got, f"{tmp_path}/buckets")
    assert spark.read.parquet(f"{tmp_path}/buckets").where("bucket = 1").count() == 2
    with pytest.raises(ValueError):
        packing.pack(got, PATH, longest=100)
