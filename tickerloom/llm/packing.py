"""Packing by power-of-two decomposition: no sequence crosses documents, and nothing is padded.

A document of n tokens is cut at the binary digits of n: as many pieces of the longest length as fit,
then one piece for each remaining digit, longest first. Each piece is a sequence of its own; sequences
of one length form a bucket, from which a trainer draws batches of equal shape.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import raw_texts

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Words whose ids a worker keeps; beyond, the memory is emptied and filled anew. Does not change results.
WORDS_KEPT = 1_000_000
#: Words of these characters, without an apostrophe, consist of the runs below, whatever stands beside them.
SIMPLE = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
_open: dict = {}


def tokenizer(path: str):
    """(Tokenizer, whether an id ends a run of characters, ids by word) of this worker."""
    if path not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        ends = np.zeros(model.get_vocab_size() + 1, bool)
        ends[[i for token, i in model.get_vocab().items() if token.endswith("</w>")]] = True
        _open[path] = (model, ends, {})
    return _open[path]


def learn(path: str, words: list[bytes]) -> None:
    """Put the ids of these words into the worker's memory.

    Simple words are encoded many at a time, and the ids are dealt out by the marks at the ends of runs; where
    that does not come out even, and for all other words, each is encoded by itself.
    """
    model, ends, known = tokenizer(path)
    alone = []
    simple = []
    for word in words:
        text = word.decode("utf-8", "replace")
        (simple if SIMPLE.fullmatch(text) and "<|" not in text else alone).append((word, text))
    for at in range(0, len(simple), 1000):
        part = simple[at : at + 1000]
        ids = np.array(model.encode_batch_fast([" ".join([t for _, t in part])], add_special_tokens=False)[0].ids, np.uint32)
        over = np.flatnonzero(ends[ids]) + 1
        runs = np.cumsum([len(RUNS.findall(t)) for _, t in part])
        if len(over) != runs[-1] or over[-1] != len(ids):
            alone += part
            continue
        code, cuts = ids.astype("<u4").tobytes(), (4 * over[runs - 1]).tolist()
        for (word, _), a, b in zip(part, [0, *cuts], cuts):
            known[word] = code[a:b]
    for at in range(0, len(alone), 1000):
        part = alone[at : at + 1000]
        for (word, _), code in zip(part, model.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
            known[word] = np.array(code.ids, "<u4").tobytes()


def pieces_of(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the binary pieces of n tokens; ``longest`` is a power of two."""
    out = [(i * longest, longest) for i in range(n // longest)]
    at, rest = n - n % longest, n % longest
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def token_bytes(path: str, texts: list[bytes]) -> Iterator[bytes]:
    """Ids of each text as little-endian 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    white-space separated parts in order, and each distinct part is encoded once per worker.
    """
    known = tokenizer(path)[2]
    split = [t.split() for t in texts]
    missing = {w for words in split for w in words}.difference(known)
    if len(known) + len(missing) > WORDS_KEPT:
        known.clear()
        missing = {w for words in split for w in words}
    learn(path, list(missing))
    for words in split:
        yield b"".join([known[w] for w in words])


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, bucket.

    Null or empty text is the end id alone; a null id stays null; repeated rows are packed each.
    There is no shuffle: each task cuts its own documents, and ``sequence_id`` is Spark's increasing id
    (distinct; partition number in the upper bits). ``bucket`` is the sequence length, a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def cut(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batch_iter:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), token_bytes(tokenizer_path, raw_texts(batch, "text"))):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, s, k, ids[4 * s : 4 * (s + k)], n) for s, k in pieces_of(n, longest)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, PIECES).select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket")
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, for loaders that draw batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)
