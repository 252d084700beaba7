"""Substring dedup by suffix sorting with bucket-pointer refinement.

Suffixes start in buckets by their first q bytes. A bucket is refined by sorting its suffixes on the bucket
identifiers at a later offset: a suffix's bucket at offset q tells its next q bytes, so each pass doubles the depth,
and the identifiers that a pass has refined serve the next. At the depth of a whole window, a bucket holds exactly
the equal windows, and all but its earliest are repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Units, drop_repeats


def refine(bucket: np.ndarray, offset: int) -> np.ndarray:
    """Buckets of twice the detail: sorted by own identifier, then by that ``offset`` later. Suffixes alone in their bucket stay out of the sort."""
    later = np.zeros_like(bucket)
    later[: len(bucket) - offset] = bucket[offset:]
    size = np.bincount(bucket)
    open_ = np.flatnonzero(size[bucket] > 1)
    key = bucket[open_].astype(np.uint64) << np.uint64(32) | later[open_].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
    out = np.empty_like(bucket)
    alone = size[bucket] == 1
    out[alone] = np.arange(alone.sum()) + (new[-1] + 1 if len(new) and len(open_) else 0)
    out[open_[order]] = new[: len(open_)]
    return out


def buckets(data: np.ndarray, depth: int, q: int = 8) -> np.ndarray:
    """Identifier of the ``depth`` bytes from each place (places too near the end have no meaning)."""
    value, span = data.astype(np.uint64), 1
    while span < q:  # initial buckets: the number that q bytes spell
        value = value.copy()
        value[:-span] = value[:-span] << np.uint64(8 * span) | value[span:]
        span *= 2
    bucket = np.unique(value, return_inverse=True)[1].astype(np.int64)
    reach = q
    while reach < depth:
        step = min(reach, depth - reach)
        bucket = refine(bucket, step)
        reach += step
    return bucket


def first_of_kind(length: int):
    """Kernel: per context the mask of windows of ``length`` bytes that are the earliest of their bucket."""

    def kernel(contexts: list[bytes], counts: list[int], docs: list[int], starts: list[int]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(contexts), np.uint8)
        begin = np.cumsum([0, *map(len, contexts)])[:-1]
        n = np.array(counts)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(begin, n) + inner
        kind = buckets(data, length)[place]
        order = np.lexsort((np.repeat(np.array(starts), n) + inner, np.repeat(np.array(docs), n), kind))
        first = np.concatenate(([True], kind[order][1:] != kind[order][:-1]))
        mask = np.zeros(len(place), bool)
        mask[order[first]] = True
        return np.split(mask, np.cumsum(n)[:-1])

    return kernel


def drop_repeated_bytes(docs: DataFrame, length: int = 100, gram: int = 24, portion: int = 150_000, most_classes: int = 20_000, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_units, spans, kept, text, row): texts as bytes without what a repeated string of ``length`` bytes covers.

    See ``repeats.drop_repeats`` for the order, null and repeated rows. ``kept`` may end inside a character.
    """
    return drop_repeats(docs, Units(False, length, gram), first_of_kind(length), portion, most_classes, id_col, text_col, keep)
