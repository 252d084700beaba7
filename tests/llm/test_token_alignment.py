import base64
import hashlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import queries, shared, token_alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
ODD = [
    "It's  two   blanks \n\n\n lines\r\n\ttabs ", "a▁b c", "<|endoftext|> <s> </s> <unk>", "x\0y \0 z", "日本語 한국 🙂🙂🙂 ﬁ é é", " lead", "\nlead\n", " ", "\n", " x　y z \x1f w\x85v",
    "ab" * 3000, "é" * 900, "🙂" * 400, "the the the", "a\r\nb\r c", "x" * 4000 + " " + "0123456789" * 50, "﻿bom ​ zero", "  \t x", "{\r\n}", "don't  'S 12ab34 ---",
]


@pytest.fixture(scope="module")
def voc():
    return token_alignment.Vocabularies(A, B)


def token_tables():
    """Bytes of each id, read another way: ranks of the first, pieces of the second."""
    ranks = {int(n): base64.b64decode(t) for t, n in map(bytes.split, open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return ranks, [bytes.fromhex(p[3:5]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def plain(rows):
    """{doc_id: columns} by encoding whole texts and linking all occurrences."""
    a_bytes, b_bytes = token_tables()
    tok = tokenizers.Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    groups, counts = {}, Counter()
    for d, t in rows:
        groups[d] = []
        if not t:
            continue
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        raw = (" " + t).encode()
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            continue
        i = j = x = y = 0
        now = ([], [])
        while i < len(a) or j < len(b):
            if x <= y:
                now[0].append(a[i])
                x, i = x + len(a_bytes[a[i]]), i + 1
            else:
                now[1].append(b[j])
                y, j = y + len(b_bytes[b[j]]), j + 1
            if x == y:
                groups[d].append(now)
                now = ([], [])
        counts.update({(p, q) for g in groups[d] for p in set(g[0]) for q in set(g[1])})
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = {}
    for d, gs in groups.items():
        own = Counter()
        for g in gs:
            left, right = Counter(g[0]), Counter(g[1])
            own.update({(p, q): m * k for p, m in left.items() for q, k in right.items()})
        spelled = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in gs)
        out[d] = (
            sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(own.values()), sum(n for (p, q), n in own.items() if counts[p, q] == best[p]),
            sum(n * counts[p] for p, n in own.items()), hashlib.sha256(spelled.encode()).hexdigest() if gs else "",
        )
    return out, counts


@pytest.mark.parametrize("sizes", [(8 << 20, 4096), (2000, 3)])
def test_query(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(token_alignment.align_documents, "__defaults__", ("doc_id", "text", *sizes))
    rows = cases.texts() + [(900 + i, t) for i, t in enumerate(ODD)]
    folder = cases.table(spark, tmp_path, "documents", cases.documents(spark, rows))
    want, counts = plain(rows)
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_cross_tokenizer_alignment"](spark, folder).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == want
    assert want[901] == (0, 0, 0, 0, 0, 0, "") and want[904][0] and want[910][2]
    pairs = token_alignment.align_documents(spark.read.parquet(f"{folder}/documents.parquet"), A, B)[1]
    assert {(r.a_id, r.b_id): r.n_docs for r in pairs.collect()} == counts


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r ab.'  \x1fé"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
def test_units_give_the_ids_of_the_whole(voc, text):
    units = voc.units_of(" " + text)
    assert "".join(units) == " " + text
    assert [i for u in units for i in voc.a.encode(u, add_special_tokens=False).ids] == voc.a.encode(" " + text, add_special_tokens=False).ids
    split = [voc.b.encode(u[1:]) if u[0] == " " else voc.b.encode(u)[1:] for u in units]
    assert [i for ids in split for i in ids] == voc.b.encode(text)


def test_identity_map(voc):
    assert all(voc.b_bytes[b] == voc.a_bytes[a] for a, b in enumerate(voc.same) if b >= 0) and (voc.same >= 0).sum() > 10_000


def test_awkward_tables(spark, tmp_path):
    rows = [(None, "one two"), (1, None), (2, "one two"), (2, "one two"), (3, "")]
    got, pairs = token_alignment.align_documents(cases.documents(spark, rows), A, B)
    got = got.collect()
    assert len(got) == 5 and sum(r.n_groups == 0 for r in got) == 2 and {r.count_sum for r in got} == {0, 6}
    assert {r.n_docs for r in pairs.collect()} == {3}
    assert token_alignment.align_documents(cases.documents(spark, []), A, B)[0].count() == 0


def test_memory_may_start_anew(voc, monkeypatch):
    monkeypatch.setattr(token_alignment, "UNITS_KEPT", 3)
    memory = token_alignment.Memory(voc)
    counted = [voc.same * 0, voc.same * 0]
    for t in ("one two three four five", "six seven", "one two"):
        docs = [(1, t.encode()), (2, b"two")]
        assert token_alignment.block_row(memory, docs, counted[0])[1:] == token_alignment.block_row(token_alignment.Memory(voc), docs, counted[1])[1:] or len(memory.groups) > 3
    assert (counted[0] == counted[1]).all()


def test_each_block_is_a_row_group(spark, monkeypatch):
    folders = {}

    def stored(df, name, *options):
        folders[name] = shared.stored(df, name, *options)
        return folders[name]

    monkeypatch.setattr(token_alignment, "stored", stored)
    texts = [(i, f"{i} and some words " * 20) for i in range(40)]
    got, _ = token_alignment.align_documents(cases.documents(spark, texts).coalesce(1), A, B, block_docs=4)
    assert {r.doc_id: r.n_groups > 0 for r in got.collect()} == dict.fromkeys(range(40), True)
    metadata = [pq.read_metadata(f.removeprefix("file://")) for f in folders["aligned"].inputFiles()]
    assert [m.row_group(i).num_rows for m in metadata for i in range(m.num_row_groups)] == [1] * 11  # ten blocks and the vector


@pytest.mark.parametrize("top", [0, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**62])
def test_packed_numbers(top):
    numbers = np.array([0, 1, top, 7], np.int64)
    raw = token_alignment.packed(numbers)
    assert (token_alignment.unpacked(raw) == numbers).all() and len(raw) == 1 + 4 * raw[0]
    assert raw[0] == next(n for n in (1, 2, 4, 8) if max(top, 7) < 256**n)
    assert not len(token_alignment.unpacked(token_alignment.packed(numbers[:0])))


def test_stored_block_is_small(voc):
    """Per occurrence of a unit 4 bytes and a fraction, per pair of a unit some 3 bytes."""
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(2000)).encode()) for i in range(20)]
    row = token_alignment.block_row(token_alignment.Memory(voc), docs, voc.same * 0)
    parts = dict(zip(token_alignment.BLOCKS.names, row))
    units, pairs = (len(token_alignment.unpacked(parts[c])) for c in ("units", "places"))
    assert sum(len(parts[c]) for c in ("units", "times", "unit_sizes", "places", "weights")) < 6.5 * units + 3.5 * pairs
