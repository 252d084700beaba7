"""Near duplicates by SimHash with multi-index hashing.

The fingerprint is cut into segments. Two fingerprints that differ in at most r bits must be close in
at least one segment, so every fingerprint asks, in each segment's table, for all values in a small
Hamming ball, and each match is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, raw_texts, stored

BITS = 64


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; A-Z are lower-cased. No word: 0."""
    words = text.lower().split()  # on bytes: ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(line[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null text has no word, so fp 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            fps = np.array([fingerprint(t, shingle, seed) for t in raw_texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def plan_segments(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) per segment.

    With radius = segments * q + a, the first a + 1 segments are searched to q and the others to q - 1:
    a pair outside all these balls would differ in more than ``radius`` bits.
    """
    q, a = divmod(radius, segments)
    out, at = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        if (ball := q if i <= a else q - 1) >= 0:
            out.append((at, width, ball))
        at += width
    return out


def ball(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` set bits."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def links(fps: DataFrame, radius: int = 4, segments: int = 3, large: int = 256, block: int = 512) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints, that connect what lies within ``radius`` bits.

    Every fingerprint asks for all values of its segments' balls. In a bucket (a segment value) with at most ``large``
    that ask, they meet the owners in a join that verifies the whole distance. The members of a larger bucket are
    split into blocks of about ``block`` rows, and each pair of blocks is one small unit of work that compares all
    its pairs but returns a spanning forest of the links found. So a large bucket makes many equal units, no list of
    all pairs is ever made, and no connection is lost. ``fps`` has one column fp without repeats. ``segments`` sets the
    cost only: 3 is right up to some ten million fingerprints, 2 (longer keys, more probes) beyond.
    """
    plan = plan_segments(radius, segments)

    def probes(i: int, shift: int, width: int, radius: int):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("seg"), value.bitwiseXOR(m).alias("key"), (m == 0).alias("owner")))

    asked = fps.select("fp", F.inline(F.concat(*[probes(i, *p) for i, p in enumerate(plan)])))
    owned = asked.where("owner").groupBy("seg", "key").agg(F.count(F.lit(1)).alias("owners"))
    # Spark takes the probes for as small as the fingerprints they come from and might send them to every task
    asks = stored(asked.hint("merge").join(owned, ["seg", "key"]), "probes")
    hot = asks.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("askers")).where(F.col("askers") > large)
    hot = stored(hot, "buckets")
    found = asks.join(hot, ["seg", "key"], "left_anti").select("seg", "key", F.col("fp").alias("a"))
    table = asks.where("owner").select("seg", "key", F.col("fp").alias("b"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    direct = found.join(table, (found["seg"] == table["seg"]) & (found["key"] == table["key"]) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # block x of the owners meets block y of all that ask, owners among them
    members = asks.join(hot, ["seg", "key"]).select(
        "seg", "key", "fp", "owner", F.ceil(F.col("owners") / block).cast("int").alias("no"), F.ceil(F.col("askers") / block).cast("int").alias("na")
    )
    to_x = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("no")).cast("int")
    to_y = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("na")).cast("int")
    as_y = members.select("seg", "key", "fp", F.lit(False).alias("left"), F.explode(F.expr("sequence(0, no - 1)")).alias("x"), to_y.alias("y"))
    as_x = members.where("owner").select("seg", "key", "fp", F.lit(True).alias("left"), to_x.alias("x"), F.explode(F.expr("sequence(0, na - 1)")).alias("y"))
    units = as_x.unionByName(as_y).groupBy("seg", "key", "x", "y").agg(
        F.collect_list(F.when(F.col("left"), F.col("fp"))).alias("owners"), F.collect_list(F.when(~F.col("left"), F.col("fp"))).alias("others")
    )
    units = units.where("size(owners) > 0 AND size(others) > 0")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def forest(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            found: set[tuple[int, int]] = set()
            for left, right in zip(batch.column("owners").to_pylist(), batch.column("others").to_pylist()):
                found.update(spanning(np.array(left, np.int64), np.array(right, np.int64), radius))
            if found:
                a, b = zip(*sorted(found))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return direct.unionByName(units.select("owners", "others").mapInArrow(forest, "a long, b long")).distinct()


def spanning(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two blocks, smaller end first."""
    nodes, where = np.unique(np.concatenate((left, right)), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, other = [], where[len(left) :]
    for x, i in zip(left, where[: len(left)].tolist()):
        near = np.bitwise_count((right ^ x).view(np.uint64)) <= radius
        for j in other[near].tolist():
            if (p := root(i)) != (q := root(j)):
                parent[max(p, q)] = min(p, q)
                out.append((int(nodes[min(i, j)]), int(nodes[max(i, j)])))
    return out


def near_duplicates(docs: DataFrame, radius: int = 4, segments: int = 3, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) per row.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits; ``kept`` marks that
    document. Equal fingerprints are one class, so copies are never paired. Texts without words share
    fingerprint zero and link like others. A null id is never a representative; where all ids of a
    component are null its ``component_id`` is null and nothing is kept. Repeated rows get the same answer.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(stored(links(classes.select("fp"), radius, segments), "links"))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
