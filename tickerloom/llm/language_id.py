"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes. A byte that was seen in a context costs its
share there; otherwise an escape is paid and the next shorter context asked, down to the uniform distribution over
bytes (escape method C: as many escapes as distinct bytes). Statistics are frozen after training, so the code length
of a byte depends only on the bytes before it, and all lengths are laid out in one table by context and byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import raw_texts

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass
class Model:
    """``symbol``: byte to its number (0: never seen, the last: before the text). ``state``: last ``order`` symbols to
    the longest context of the trees. ``bits``: code length by state * symbols + symbol and language."""

    languages: list[str]
    order: int
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 2


def count_contexts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, k, key, n): how often each byte follows each k bytes; key holds the context and then the byte."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for lang, text in zip(batch.column("lang").to_pylist(), raw_texts(batch, "text")):
                data = np.frombuffer(text, np.uint8).astype(np.int64)
                key = data
                for k in range(order + 1):
                    if k:
                        key = (key[:-1] << 8) | data[k:]
                    if not len(key):
                        break
                    keys, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(n)], names=["lang", "k", "key", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, k int, key long, n long").groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))


def build(rows: list[tuple[str, int, int, int]], order: int, least: int, most_states: int) -> Model:
    """Model from context counts. Contexts longer than one byte need ``least`` occurrences over all languages; beyond
    ``most_states`` the most frequent stay."""
    languages = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    seen = sorted({r[2] for r in rows if r[1] == 0})
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 2
    contexts: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
    weight: dict[tuple[int, int], int] = {}
    for lang, k, key, n in rows:
        c = (k, key >> 8)
        contexts.setdefault(c, {}).setdefault(place[lang], []).append((int(symbol[key & 255]), n))
        weight[c] = weight.get(c, 0) + n
    kept = sorted((c for c in contexts if c[0] <= 1 or weight[c] >= least), key=lambda c: (c[0] > 1, -weight[c], c))[:most_states]
    kept = sorted(set(kept) | {(0, 0)})
    number = {c: i for i, c in enumerate(kept)}
    bits = np.full((len(kept), size, max(1, len(languages))), 8.0, np.float32)
    state = np.zeros((size,) * order, np.int32)
    for (k, key), i in number.items():
        back = [int(symbol[(key >> (8 * j)) & 255]) for j in range(k)]  # nearest byte first
        if k:
            shorter = next(number[(j, key & ((1 << (8 * j)) - 1))] for j in range(k - 1, -1, -1) if (j, key & ((1 << (8 * j)) - 1)) in number)
            bits[i] = bits[shorter]
            state[(..., *reversed(back))] = i
        for lang, followers in contexts.get((k, key), {}).items():
            total, kinds = sum(n for _, n in followers), len(followers)
            bits[i, :, lang] += np.float32(-np.log2(kinds / (total + kinds)))
            for s, n in followers:
                bits[i, s, lang] = -np.log2(n / (total + kinds))
    return Model(languages, order, symbol, state.reshape(-1), bits.reshape(-1, max(1, len(languages))))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language."""
    size, order = model.symbols, model.order
    pad = np.full(order, size - 1, np.int64)
    parts = [x for t in texts for x in (pad, model.symbol[np.frombuffer(t, np.uint8)])]
    s = np.concatenate(parts)
    back = np.zeros(len(s), np.int64)
    for j in range(order, 0, -1):  # farthest byte first
        back[order:] = back[order:] * size + s[order - j : len(s) - j]
    cell = model.state[back] * np.int64(size) + s
    lengths = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), model.bits.shape[1]))
    ends = np.cumsum(lengths + order)
    for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist())):
        for at in range(end - n, end, 65536):
            out[i] += model.bits[cell[at : min(end, at + 65536)]].sum(0, dtype=np.float64)
    return out


def fit(docs: DataFrame, per_language: int = 300, order: int = 3, least: int = 8, most_states: int = 40_000) -> Model:
    """Model from (key, lang, text): the ``per_language`` documents of each language with the smallest hash of key, whole texts.

    What the driver gets is bounded by the sample.
    """
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = usable.select("key", "lang").withColumn("_r", rank).where(F.col("_r") <= per_language).select("key").distinct()
    sample = usable.join(chosen, "key", "left_semi")
    counts = count_contexts(sample, order).toArrow()
    return build(list(zip(*[counts.column(c).to_pylist() for c in ("lang", "k", "key", "n")])), order, least, most_states)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score (posterior of the language, all equally likely before).

    ``und`` with score 0 for null text, text without a letter, and where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    out = source.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batch_iter:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = raw_texts(batch, "_text")
                bits = code_lengths(known, texts)
                best = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
                lettered = [bool(known.languages) and LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
                names = [known.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, out)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; learns from the rows that are not held out and have a language.

    Repeated rows get the same answer; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(source.where(~F.col("held_out")).select(F.col("doc_id").alias("key"), "lang", "text"), **settings)
    return predict(source, model, ["doc_id", "held_out"])
