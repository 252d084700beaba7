"""Passages that repeat across documents: which windows of a fixed number of units can have an equal elsewhere.

A unit is a word or a byte. Every window of ``length`` units has an anchor: the smallest hash among its k-grams.
Equal windows have equal anchors, so only windows whose anchor occurs twice or more can repeat. Windows in a row
with one anchor form a run; equal runs form a class, of which only the first occurrence is looked at further. A
kernel (suffix automaton or suffix sorting) gets all classes of an anchor and says which of their windows are the
first of their kind; every other window of a repeated anchor is a repeat. The steps, each by Spark:

1. anchors of each document, counted with map-side combining; those seen twice go back to their documents;
2. runs of repeated anchors, reduced to classes by hash, with the earliest occurrence, map-side first;
3. classes dealt by anchor, in bounded portions, to the kernel; an anchor with very many classes is first taken
   apart into single windows, which are dealt by their own hash, so no anchor fills a task;
4. first windows go back to their documents, which drop what the others cover.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import raw_texts, stored

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Windows of a run are at most so many; a longer run is several.
RUN = 1024


@dataclass(frozen=True)
class Units:
    """How a text is cut: ``words`` or bytes, window ``length`` and anchor size ``gram`` in units."""

    words: bool
    length: int
    gram: int

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


class Cut:
    """A text as units: buffer, starts and ends of the units in it, and a hash per unit."""

    def __init__(self, text: bytes, units: Units):
        if units.words:
            parts = text.split()
            self.buffer = b" ".join(parts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            self.ends = np.cumsum(sizes + 1) - 1
            self.starts = self.ends - sizes
            self.n = len(parts)
            self.parts = parts
        else:
            self.buffer, self.n = text, len(text)

    def hashes(self) -> np.ndarray:
        if hasattr(self, "parts"):
            return np.array(list(map(xxhash.xxh3_64_intdigest, self.parts)), np.uint64)
        return np.frombuffer(self.buffer, np.uint8).astype(np.uint64)

    def piece(self, at: int, n: int) -> bytes:
        """Bytes of the n units from ``at``."""
        return self.buffer[self.starts[at] : self.ends[at + n - 1]] if hasattr(self, "parts") else self.buffer[at : at + n]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each k-gram, by doubling."""
    out, span, power, done, total = h, 1, MULTIPLIER, 0, None
    while True:
        if k & span:
            size = len(h) - done - span + 1
            total = out[:size] if total is None else total[:size] * power + out[done : done + size]
            done += span
        if done == k:
            break
        out = out[: len(out) - span] * power + out[span:]
        power, span = power * power, span * 2
    total = total * MIX
    total ^= total >> np.uint64(31)
    total *= MULTIPLIER
    return total ^ (total >> np.uint64(29))


def sliding(x: np.ndarray, w: int, pick: Callable) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each w values in a row."""
    n, span = len(x) - w + 1, 1
    while span * 2 <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:n], x[w - span : w - span + n]) if span < w else x[:n]


def anchors(cut: Cut, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of each window, and the k-gram hashes they come from."""
    g = grams(cut.hashes(), units.gram)
    return sliding(g, units.window, np.minimum), g


def anchor_counts(cut: Cut, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a text, and at how many places each is the smallest."""
    low, g = anchors(cut, units)
    edge = np.zeros(units.window - 1, np.uint64)
    chosen = sliding(np.concatenate((edge, low, edge)), units.window, np.maximum) == g
    return np.unique(g[chosen], return_counts=True)


def runs(low: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the runs whose anchor is in the sorted ``repeated``."""
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate(([0], change))
    count = np.diff(np.concatenate((first, [len(low)])))
    at = np.searchsorted(repeated, low[first])
    hit = repeated[np.minimum(at, len(repeated) - 1)] == low[first]
    first, count = first[hit], count[hit]
    if len(count) and count.max() > RUN:
        cuts = -(-count // RUN)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        left = np.repeat(count, cuts) - nth * RUN
        first, count = np.repeat(first, cuts) + nth * RUN, np.minimum(left, RUN)
    return first, count


#: kernel(contexts, windows per context, doc ids, first windows) -> for each context a mask of the windows that are first of their kind
Kernel = Callable[[list[bytes], list[int], list[int], list[int]], list[np.ndarray]]


def first_windows(classes: DataFrame, units: Units, kernel: Kernel, portion: int) -> DataFrame:
    """(doc_id, start, n): stretches of windows that are the first of their kind. ``portion``: bytes per kernel call, up to whole anchors."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def judge(held: list[tuple]) -> pa.RecordBatch | None:
        docs, starts, counts, contexts = zip(*held)
        rows = []
        for doc, start, mask in zip(docs, starts, kernel(list(contexts), list(counts), list(docs), list(starts))):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
            rows += [(doc, start + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else None

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batch_iter:
            for h, *row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if h != last and size >= portion:
                    if (out := judge(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = h
        if held and (out := judge(held)) is not None:
            yield out

    dealt = classes.select("h", "doc_id", "start", "n", "context").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "doc_id long, start int, n int")


def classes_of(rows: DataFrame) -> DataFrame:
    """Earliest occurrence of each class (h, c)."""
    first = F.min(F.struct("doc_id", "start", "n", "context")).alias("f")
    return rows.groupBy("h", "c").agg(first).select("h", "c", "f.*")


def drop_repeats(docs: DataFrame, units: Units, kernel: Kernel, portion: int, most_classes: int = 20_000, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), keep_anchors: bool = False) -> DataFrame:
    """(doc_id, n_units, spans, kept, text, row) per row of ``docs``: what is left of each text.

    A unit goes if a window covers it whose units also occur in a row earlier: at a smaller doc_id, or in the same
    document at an earlier place. Windows are judged on the input. ``spans`` are the removed stretches (start,
    length) in units; ``kept`` is the rest (words joined by a space, or bytes), and ``text`` the same as characters,
    without the parts of any that a cut went through (null where the text was null, or ``keep`` is empty). Null text
    has no units; a null id is neither compared nor cut. Rows that repeat a doc_id count as that document: none of them
    is earlier than the other. An empty table gives no rows. Of other columns, ``keep`` are returned in ``row``.
    ``keep_anchors`` stores the anchors instead of finding them twice: less time, more disk.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("row"))
    whole = source.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")

    def find(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            values, ids, counts = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text")):
                cut = Cut(text, units)
                if cut.n >= units.length:
                    v, n = anchor_counts(cut, units)
                    values.append(v)
                    counts.append(n)
                    ids.append(np.full(len(v), doc, np.int64))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts).astype(np.int32))], names=["h", "doc_id", "n"])

    found = whole.mapInArrow(find, "h long, doc_id long, n int")
    found = stored(found, "anchors") if keep_anchors else found
    repeated = found.groupBy("h").agg(F.sum("n").alias("places")).where("places > 1").select("h")
    own = found.select("h", "doc_id").join(repeated, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    own = stored(own, "repeated")

    def cut_out(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "doc_id", "start", "n", "context"]
        for whole_batch in batch_iter:
            for at in range(0, whole_batch.num_rows, 200):
                batch = whole_batch.slice(at, 200)
                rows = []
                for doc, text, hs in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text"), batch.column("hs")):
                    cut = Cut(text, units)
                    if cut.n < units.length:
                        continue
                    low, _ = anchors(cut, units)
                    first, count = runs(low, np.sort(hs.values.to_numpy().view(np.uint64)))
                    for h, a, n in zip(low[first].view(np.int64).tolist(), first.tolist(), count.tolist()):
                        context = cut.piece(a, n + units.length - 1)
                        rows.append((h, xxhash.xxh3_64_intdigest(context) - (1 << 63), doc, a, n, context))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    fields = "h long, c long, doc_id long, start int, n int, context binary"
    classes = stored(classes_of(whole.join(own, "doc_id").mapInArrow(cut_out, fields)), "classes")

    def take_apart(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "doc_id", "start", "n", "context"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batch_iter:
            rows = []
            for doc, start, n, context in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "n", "context")]):
                cut = Cut(context, units)
                for i in range(n):
                    piece = cut.piece(i, units.length)
                    rows.append((xxhash.xxh3_64_intdigest(piece) - (1 << 63), xxhash.xxh64_intdigest(piece) - (1 << 63), doc, start + i, 1, piece))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    hot = stored(classes.groupBy("h").agg(F.count(F.lit(1)).alias("n_classes")).where(F.col("n_classes") > most_classes).select("h"), "hot")
    apart = classes_of(classes.join(hot, "h").select("h", "c", "doc_id", "start", "n", "context").mapInArrow(take_apart, fields))
    judged = first_windows(classes.join(hot, "h", "left_anti").unionByName(apart), units, kernel, portion)
    firsts = judged.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("firsts"))
    notes = stored(own.join(firsts, "doc_id", "left"), "firsts")
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def clear(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_units", "spans", "kept", "text", "row"]
        for whole_batch in batch_iter:
            for at in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(at, 1000)
                sizes, spans, kept = [], [], []
                for text, hs, firsts in zip(raw_texts(batch, "text"), batch.column("hs"), batch.column("firsts")):
                    cut = Cut(text, units)
                    gone = covered(cut, units, hs.values.to_numpy().view(np.uint64), firsts) if hs.is_valid and cut.n >= units.length else None
                    sizes.append(cut.n)
                    if gone is None or not gone.any():
                        spans.append([])
                        kept.append(cut.buffer)
                        continue
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
                    spans.append([{"start": a, "length": b - a} for a, b in zip(edges[::2], edges[1::2])])
                    left = list(zip([0, *edges[1::2]], [*edges[::2], cut.n]))
                    kept.append((b" " if units.words else b"").join([cut.piece(a, b - a) for a, b in left if b > a]))
                texts = [k.decode("utf-8", "ignore") if keep and known else None for k, known in zip(kept, batch.column("text").is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), batch.column("row")], names=names)

    out = source.join(notes, "doc_id", "left").select("doc_id", "text", "hs", "firsts", "row")
    fields = f"doc_id long, n_units long, spans array<struct<start:bigint,length:bigint>>, kept binary, text string, row {dict(source.dtypes)['row']}"
    return out.mapInArrow(clear, fields)


def covered(cut: Cut, units: Units, repeated: np.ndarray, firsts: pa.Scalar) -> np.ndarray:
    """Mask of the units that a repeat covers."""
    low, _ = anchors(cut, units)
    mask = np.zeros(len(low) + 1, np.int32)
    first, count = runs(low, np.sort(repeated))
    np.add.at(mask, first, 1)
    np.add.at(mask, first + count, -1)
    repeat = np.cumsum(mask)[:-1] > 0
    if firsts.is_valid:
        for a, n in zip(firsts.values.field("start").to_numpy().tolist(), firsts.values.field("n").to_numpy().tolist()):
            repeat[a : a + n] = False
    at = np.flatnonzero(repeat)
    gone = np.zeros(cut.n + 1, np.int32)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + units.length, -1)
    return np.cumsum(gone)[:-1] > 0
