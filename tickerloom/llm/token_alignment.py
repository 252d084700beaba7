"""Alignment of two tokenizers: which ids of A and B stand for the same bytes, and how often.

Byte offsets at which a token of A and a token of B both end cut a text into groups. A group of one token on either
side holds the same bytes twice, so it is known beforehand: an array gives for each id of A the id of B with its
bytes. Such pairs are counted in one vector as long as A's vocabulary per task. Only the pairs of the other, irregular
groups are shuffled, added up before by block.

Texts are read in blocks of bounded size. Both tokenizers are independent on either side of a single blank or line
feed between other characters (checked against B's vocabulary), so each distinct unit between such places is encoded
and aligned once, and a text is a sequence of units. A block stores its documents' digests, how often each document
holds each unit, and the pairs of each unit. Once corpus-wide counts are known, sums of a unit are computed once
and weighed by its occurrences. Within a group ids are made distinct, with multiplicities, before pairs are formed.

A stored block is a row of some MB. Spark reads and writes Parquet a row group at a time, so each block is a row group
of its own: a task then holds one block, however many blocks its file has.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Text bytes and documents of a block; units and their characters that a worker remembers before it starts anew.
BLOCK_BYTES, BLOCK_DOCS, UNITS_KEPT, CHARS_KEPT = 4 << 20, 4096, 200_000, 16 << 20
#: Documents of a block that are looked at together.
STEP_DOCS = 256
#: Parquet looks at sizes after 100 rows only, unless told the number of rows of a row group.
ROW_GROUPS = {"parquet.block.row.count.limit": 1, "parquet.enable.dictionary": "false"}
#: White space beside white space or at the end: there the places of the units are looked at one by one.
ODD = re.compile(r"\s\s|\s$")
_open: dict = {}

DOC = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
PAIR = pa.struct([("at", pa.int32()), ("code", pa.int64()), ("docs", pa.int64())])
BLOCKS = pa.schema(
    [("block", pa.string()), ("docs", pa.list_(DOC)), *[(c, pa.binary()) for c in ("doc_sizes", "units", "times", "unit_sizes", "places", "weights", "codes")], ("pairs", pa.list_(PAIR)), ("same", pa.binary())]
)
BLOCKS_DDL = (
    "block string, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, doc_sizes binary, units binary, times binary, "
    "unit_sizes binary, places binary, weights binary, codes binary, pairs array<struct<at: int, code: long, docs: long>>, same binary"
)
RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers of a worker, the bytes of their ids, and the identity map."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        ids: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            if x not in ids or self.b.is_byte(ids[x]):
                ids[x] = i
        self.same = np.array([ids.get(x, -1) for x in self.a_bytes], np.int64)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.lone = self.b.piece_to_id("▁")
        if self.b_bytes[self.b.encode("a")[0]][:1] != b" ":
            raise ValueError("the second tokenizer has to put a space before its text")
        text = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.at_blank = not any("▁" in p.lstrip("▁") for p in text)
        self.at_line = self.at_blank and not any("\n" in p for p in text)

    def units_of(self, full: str) -> list[str]:
        """Parts of a text that starts with a blank; encoded one by one they give the ids of the whole."""
        if not self.at_blank:
            return [full]
        mark = "\0" if "\0" not in full else "\ud800"
        marked = full.replace(" ", mark + " ")
        if self.at_line:
            marked = marked.replace("\n", mark + "\n")
        parts = marked.split(mark)[1:]
        if not ODD.search(full):
            return parts
        out, held = [], [parts[0]]
        for before, part in zip(parts, parts[1:]):
            if len(part) == 1 or part[1].isspace() or before[-1].isspace():
                held.append(part)
            else:
                out.append("".join(held))
                held = [part]
        return [*out, "".join(held)]


class Memory:
    """Aligned units of a worker: number of each unit, its sizes, groups as text, pairs with multiplicities."""

    def __init__(self, voc: Vocabularies) -> None:
        self.voc = voc
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.chars = 0
        self._sizes, self._off, self._codes, self._weights = [np.empty((0, 4), np.int64)], [np.zeros(1, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links) of each unit (n_a = -1: its bytes differ), offsets, pair codes, multiplicities."""
        for held in (self._sizes, self._off, self._codes, self._weights):
            if len(held) > 1:
                held[:] = [np.concatenate(held)]
        return self._sizes[0], self._off[0], self._codes[0], self._weights[0]

    def learn(self, units: list[str]) -> None:
        """Encode and align units that are not known yet, some at a time."""
        plain = [u for u in units if len(u) > 1 and not u[1].isspace() and not u[-1].isspace() and self.voc.at_line]
        odd = set(units).difference(plain)
        for at in range(0, len(plain), 2048):
            part = plain[at : at + 2048]
            ids = self._together(part)
            if ids is None:
                odd.update(part)
            else:
                self._keep(part, np.ones(len(part), bool), ids)
        odd = list(odd)
        for at in range(0, len(odd), 512):
            self._one_by_one(odd[at : at + 512])

    def _together(self, units: list[str]):
        """Ids of both sides of units that are independent of each other, encoded as one text and dealt out by bytes;
        None if some unit's bytes differ."""
        voc = self.voc
        units = units if units[0][0] == " " else [" .", *units]
        text = "".join(units)
        raw, ends = text.encode(), np.cumsum([len(u.encode()) for u in units])
        sides = []
        for ids, names, size in (
            (voc.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, voc.a_bytes, voc.a_size),
            (voc.b.encode(text[1:]), voc.b_bytes, voc.b_size),
        ):
            if b"".join([names[i] for i in ids]) != raw:
                return None
            ids = np.array(ids, np.int64)
            until = np.searchsorted(np.cumsum(size[ids]), ends) + 1
            if (np.cumsum(size[ids])[until - 1] != ends).any():
                return None
            each = np.diff(until, prepend=0)
            sides.append((ids, each) if units[0] != " ." else (ids[each[0] :], each[1:]))
        return sides

    def _one_by_one(self, units: list[str]) -> None:
        voc = self.voc
        a_ids = [e.ids for e in voc.a.encode_batch_fast(units, add_special_tokens=False)]
        b_ids = voc.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        good = np.zeros(len(units), bool)
        for i, (u, a) in enumerate(zip(units, a_ids)):
            b = b_ids[i]
            if u[0] != " ":
                b = b_ids[i] = b[1:] if b[:1] == [voc.lone] else []
            raw = u.encode()
            good[i] = b"".join([voc.a_bytes[x] for x in a]) == raw == b"".join([voc.b_bytes[x] for x in b])
        flat = lambda ids: (np.array([x for i in np.flatnonzero(good) for x in ids[i]], np.int64), np.array([len(ids[i]) for i in np.flatnonzero(good)], np.int64))
        self._keep(units, good, [flat(a_ids), flat(b_ids)])

    def _keep(self, units: list[str], good: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        which = np.flatnonzero(good)
        sizes, (owner, codes, weights), texts = align(self.voc, *sides)
        every = np.full((len(units), 4), -1, np.int64)
        every[which] = sizes
        counts = np.zeros(len(units), np.int64)
        counts[which] = np.bincount(owner, minlength=len(which))
        self._sizes.append(every)
        self._off.append(self._off[-1][-1] + np.cumsum(counts))
        self._codes.append(codes)
        self._weights.append(weights)
        text = iter(texts)
        for u, ok in zip(units, good.tolist()):
            self.number[u] = len(self.groups)
            self.groups.append(next(text) if ok else b"")
            self.chars += len(u)


def _spans(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def align(voc: Vocabularies, side_a: tuple[np.ndarray, np.ndarray], side_b: tuple[np.ndarray, np.ndarray]):
    """Groups of units, given on each side as all ids and the number of ids of each unit: sizes per unit, (unit, pair
    code, multiplicity) sorted, texts per unit.

    A pair's code is A's id in the upper 32 bits and B's in the lower.
    """
    (a, a_each), (b, b_each) = side_a, side_b
    n = len(a_each)
    a_end, b_end = np.cumsum(voc.a_size[a]), np.cumsum(voc.b_size[b])
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    n_a, n_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
    unit_end = a_end[np.cumsum(a_each) - 1] if n else np.empty(0, np.int64)
    unit = np.searchsorted(unit_end, cuts)
    links = np.zeros(n, np.int64)
    np.add.at(links, unit, n_a * n_b)
    sizes = np.stack([a_each, b_each, np.bincount(unit, minlength=n), links], axis=1) if n else np.empty((0, 4), np.int64)

    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    lone = np.flatnonzero((n_a == 1) & (n_b == 1))
    known = lone[voc.same[a[a_first[lone]]] == b[b_first[lone]]]
    code, of, weight = [(a[a_first[known]] << 32) | b[b_first[known]]], [unit[known]], [np.ones(len(known), np.int64)]
    rest = np.ones(len(cuts), bool)
    rest[known] = False
    # the other groups: distinct ids of either side with multiplicities, then their products
    (g1, x1), m1 = _distinct(a_group[rest[a_group]], a[rest[a_group]])
    (g2, x2), m2 = _distinct(b_group[rest[b_group]], b[rest[b_group]])
    d2 = np.bincount(g2, minlength=len(cuts))
    start = np.cumsum(d2) - d2
    left = np.repeat(np.arange(len(g1)), d2[g1])
    right = np.repeat(start[g1], d2[g1]) + _spans(d2[g1])
    code.append((x1[left] << 32) | x2[right])
    of.append(unit[g1[left]])
    weight.append(m1[left] * m2[right])
    (owner, codes), weights = _distinct(np.concatenate(of), np.concatenate(code), np.concatenate(weight))

    names_a, names_b = [voc.names[i] for i in a.tolist()], [voc.names[i] for i in b.tolist()]
    spelled = [
        names_a[i] + "|" + names_b[j] if k == l == 1 else ",".join(names_a[i : i + k]) + "|" + ",".join(names_b[j : j + l])
        for i, k, j, l in zip(a_first.tolist(), n_a.tolist(), b_first.tolist(), n_b.tolist())
    ]
    until = np.cumsum(sizes[:, 2]).tolist()
    texts = [";".join(spelled[i:j]).encode() for i, j in zip([0, *until], until)]
    return sizes, (owner, codes, weights), texts


def _distinct(first: np.ndarray, second: np.ndarray, weight: np.ndarray | None = None):
    """Distinct (first, second) in order, with the sum of their weights (how often they occur if none are given)."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    if weight is None:
        total = np.diff(np.append(at, len(first)))
    else:
        total = np.add.reduceat(weight[order], at) if len(at) else np.empty(0, np.int64)
    return (first[at], second[at]), total


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs; the first byte says how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def block_row(memory: Memory, docs: list[tuple], counted: np.ndarray) -> tuple:
    """The stored row of a block of (doc_id, text bytes); adds its documents with identical pairs to ``counted``."""
    voc = memory.voc
    if len(memory.groups) > UNITS_KEPT or memory.chars > CHARS_KEPT:
        memory.clear()
    rows, held, times = [], [], []
    for at in range(0, len(docs), STEP_DOCS):
        part = []
        for doc, raw in docs[at : at + STEP_DOCS]:
            try:
                text = (raw or b"").decode()
            except UnicodeDecodeError:
                text = ""
            part.append((doc, text, voc.units_of(" " + text) if text else []))
        missing = {u for _, _, units in part for u in units}.difference(memory.number)
        if missing:
            memory.learn(list(missing))
        for doc, text, units in part:
            numbers = np.fromiter(map(memory.number.__getitem__, units), np.int64, len(units))
            if len(units) > 1 and (memory.tables()[0][numbers, 0] < 0).any():
                if " " + text not in memory.number:  # the whole by itself decides
                    memory.learn([" " + text])
                numbers = np.array([memory.number[" " + text]])
            sizes = memory.tables()[0][numbers]
            if not len(numbers) or (sizes[:, 0] < 0).any():
                rows.append((doc, 0, 0, 0, 0, ""))
                numbers = numbers[:0]
            else:
                digest = hashlib.sha256(b";".join([memory.groups[i] for i in numbers.tolist()])).hexdigest()
                rows.append((doc, *sizes.sum(axis=0).tolist(), digest))
            own, often = np.unique(numbers, return_counts=True)
            held.append(own)
            times.append(often)
    _, off, codes, weights = memory.tables()
    doc_sizes = np.array([len(x) for x in held], np.int64)
    used, local = np.unique(np.concatenate(held), return_inverse=True)
    per_unit = off[used + 1] - off[used]
    take = np.repeat(off[used], per_unit) + _spans(per_unit)
    distinct, places = np.unique(codes[take], return_inverse=True)
    # documents that hold each pair: their units' pairs, each once, some documents at a time
    first, n_docs = np.cumsum(per_unit) - per_unit, np.zeros(len(distinct), np.int64)
    ends = np.cumsum(doc_sizes)
    for at in range(0, len(docs), STEP_DOCS):
        own = local[ends[at] - doc_sizes[at] : ends[min(at + STEP_DOCS, len(docs)) - 1]]
        spread = per_unit[own]
        owner = np.repeat(np.repeat(np.arange(len(doc_sizes[at : at + STEP_DOCS])), doc_sizes[at : at + STEP_DOCS]), spread)
        once = np.unique(owner * len(distinct) + places[np.repeat(first[own], spread) + _spans(spread)])
        if len(once):
            n_docs += np.bincount(once % len(distinct), minlength=len(distinct))
    a, b = distinct >> 32, distinct & 0xFFFFFFFF
    identical = voc.same[a] == b
    counted[a[identical]] += n_docs[identical]
    odd = np.flatnonzero(~identical)
    pairs = [{"at": i, "code": c, "docs": n} for i, c, n in zip(odd.tolist(), distinct[odd].tolist(), n_docs[odd].tolist())]
    docs_out = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), r)) for r in rows]
    numbers = (doc_sizes, local, np.concatenate(times), per_unit, places, weights[take], distinct)
    return (uuid.uuid4().hex, docs_out, *map(packed, numbers), pairs, None)


def _blocks(path_a: str, path_b: str, block_bytes: int, block_docs: int):
    def cut(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _open:
            _open[path_a, path_b] = Memory(Vocabularies(path_a, path_b))
        memory = _open[path_a, path_b]
        counted = np.zeros(len(memory.voc.same), np.int64)
        row = lambda values: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, BLOCKS.types)], schema=BLOCKS)
        held, size = [], 0
        for batch in batch_iter:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                held.append((ids[i].as_py(), text))
                size += len(text or b"")
                if size >= block_bytes or len(held) >= block_docs:
                    yield row(block_row(memory, held, counted))
                    held, size = [], 0
        if held:
            yield row(block_row(memory, held, counted))
        if counted.any():
            yield row((None,) * 10 + (counted.astype("<i8").tobytes(),))

    return cut


def _vector_sums(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the vectors of a task's rows."""
    total = None
    for batch in batch_iter:
        for x in batch.column("same"):
            v = np.frombuffer(x.as_py(), "<i8")
            total = v.copy() if total is None else total + v
    if total is not None:
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["a", "n"])


def _results(same: np.ndarray, best: np.ndarray, partner: np.ndarray):
    """Function of a block and the counts of its irregular pairs, giving its documents' rows."""

    def results(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        if not len(blocks):
            return RESULT.empty_table()
        get = lambda c: unpacked(blocks.column(c)[0].as_py())
        codes = get("codes")
        a = codes >> 32
        n = np.where(partner[a] == (codes & 0xFFFFFFFF), same[a], 0)
        n[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
        places, weights, per_unit = get("places"), get("weights"), get("unit_sizes")
        units, times, doc_sizes = get("units"), get("times"), get("doc_sizes")
        unit_of, doc_of = np.repeat(np.arange(len(per_unit)), per_unit), np.repeat(np.arange(len(doc_sizes)), doc_sizes)

        def per_doc(value: np.ndarray) -> np.ndarray:
            by_unit, by_doc = np.zeros(len(per_unit), np.int64), np.zeros(len(doc_sizes), np.int64)
            np.add.at(by_unit, unit_of, weights * value)
            np.add.at(by_doc, doc_of, times * by_unit[units])
            return by_doc

        docs = blocks.column("docs").combine_chunks().flatten()
        columns = {c: docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array(per_doc((n == best[a])[places].astype(np.int64))), "count_sum": pa.array(per_doc(n[places]))}
        return pa.table([columns[c] for c in RESULT.names], schema=RESULT)

    return results


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS
) -> tuple[DataFrame, DataFrame]:
    """(documents, pair counts): one row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row
    of ``docs``; rows (a_id, b_id, n_docs) of all pairs linked somewhere.

    A encodes a blank and the text (byte-level vocabulary, tokenizers JSON), B the text (sentencepiece, which adds the
    blank). A text that is null, empty, no UTF-8, or not spelled by the bytes of both sides has zeros and an empty
    ``groups_sha256``. Null and repeated ids are kept row by row; a repeated row counts as a document of its own.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = stored(source.mapInArrow(_blocks(path_a, path_b, block_bytes, block_docs), BLOCKS_DDL), "aligned", ROW_GROUPS)
    blocks = kept.where("block IS NOT NULL")
    odd = blocks.select("block", F.explode("pairs").alias("p")).select("block", "p.at", "p.code", "p.docs")
    counts = stored(odd.groupBy("code").agg(F.sum("docs").alias("n")), "pairs")
    same = kept.where("block IS NULL").select("same").mapInArrow(_vector_sums, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    voc = Vocabularies(path_a, path_b)
    # as many rows as A has ids, whatever the corpus
    n_same, best = np.zeros(len(voc.same), np.int64), np.zeros(len(voc.same), np.int64)
    vectors = same.toArrow()
    n_same[vectors.column("a").to_numpy()] = vectors.column("n").to_numpy()
    highest = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("n").alias("n")).toArrow()
    best[highest.column("a").to_numpy()] = highest.column("n").to_numpy()
    best = np.maximum(best, n_same)

    found = odd.select("block", "at", "code").join(counts, "code").select(F.col("block").alias("of_block"), "at", "n")
    body = blocks.drop("pairs", "same")
    rows = body.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_results(n_same, best, voc.same), RESULT_DDL)
    spark = docs.sparkSession
    ids = np.flatnonzero(n_same)
    identical = spark.createDataFrame(pa.table({"a_id": ids, "b_id": voc.same[ids], "n_docs": n_same[ids]}))
    pairs = counts.select(F.shiftright("code", 32).alias("a_id"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), F.col("n").alias("n_docs"))
    return rows, pairs.unionByName(identical)
