"""Language-model scoring with a hierarchical Pitman-Yor model.

Every context word has a restaurant whose customers are the words that follow it and whose tables are customers of the
parent restaurant, which all contexts share and whose own parent is uniform over the vocabulary. Seating is sampled by
Gibbs: in each sweep the tables of every restaurant are seated anew given its parent, and the parent's given all
tables; predictive probabilities are averaged over the sweeps after the first ones.

Every word of the training texts is a context and a dish, and every pair of words is counted, in Spark tables that
grow with the corpus. A pair that occurs once has one table whatever is drawn, so a sweep reads the others only and
returns tables beyond the first. Draws are functions of words and sweep: a lost task draws the same again, and tables
need not be kept.

Sent to tasks, each with a bound: the ``sent`` most frequent words with their restaurants' sums, at most ``sent_pairs``
of the most frequent pairs, and a Bloom filter of ``bits`` bits of the remaining pairs and words that occur twice or
more. In a training text a pair or word that is neither sent nor in the filter occurs once. All else is joined, with
the pairs that a second such filter finds among those asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import raw_texts, stored, swept

START, END = 11, 13  # what stands for a text's start among contexts, and for its end among dishes
FAR = 1 << 40  # set in every word's hash, so that a hash is never a rank
MOST_TOKENS = 200_000  # texts are scored together up to so many tokens; a longer one by itself


@dataclass
class Settings:
    sent: int = 1_000_000
    sent_pairs: int = 2_000_000
    bits: int = 1 << 28
    sweeps: int = 4
    burn_in: int = 2
    discount: float = 0.75
    strength: float = 1.0
    seed: int = 23


def hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    return hashed(text.lower().split())


def hashed(words: Iterable[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64).view(np.int64) | FAR


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash for the hashes of a context and a dish."""
    return mixed(mixed(u.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + w.view(np.uint64))


def seat(customers: np.ndarray, base: np.ndarray, tables: np.ndarray | float, keys: np.ndarray, sweep: int, s: Settings) -> np.ndarray:
    """Number of tables per dish: its customers enter in turn, and each opens a table with the restaurant's odds.

    ``base`` is the parent's probability of the dish and ``tables`` the restaurant's number of tables before. The first
    customer always opens one. Later ones enter in blocks of a sixteenth of those seated, within which the odds hardly
    change; a block opens its expected number of tables, rounded at random.
    """
    t = np.minimum(customers, 1).astype(np.float64)
    active, k = np.flatnonzero(customers > 1), 1
    weight = (s.strength + s.discount * tables) * base
    salt = np.uint64((s.seed * 1_000_003 + sweep) << 20)
    while len(active):
        block = np.minimum(max(1, k // 16), customers[active] - k)
        new = weight[active] / (weight[active] + np.maximum(k - s.discount * t[active], 1e-9))
        draw = (mixed(keys[active] ^ mixed(np.array([salt + np.uint64(k)]))) >> np.uint64(11)) / float(1 << 53)
        t[active] += np.floor(block * new + draw)
        k += max(1, k // 16)
        active = active[customers[active] > k]
    return t


def root_keys(h: np.ndarray) -> np.ndarray:
    return mixed(h.view(np.uint64) ^ np.uint64(0xA5A5A5A5))


@dataclass
class Root:
    """The parent restaurant in one sweep: its customers, its tables and how many kinds of words there are."""

    customers: float
    tables: float
    kinds: int
    sweep: int

    def seated(self, c: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
        return seat(c, np.full(len(c), 1 / (self.kinds + 1)), self.tables, root_keys(h), self.sweep, s)

    def probability(self, c: np.ndarray, own: np.ndarray, own_sum: float, s: Settings) -> np.ndarray:
        return (np.maximum(c - s.discount * own, 0) + (s.strength + s.discount * own_sum) / (self.kinds + 1)) / (s.strength + self.customers)


@dataclass
class Places:
    """Where numbers stand in a sorted list of hashes: their first bits name a place from which it is a few steps."""

    hashes: np.ndarray

    @cached_property
    def bits(self) -> int:
        return min(max(len(self.hashes).bit_length(), 1), 21)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.searchsorted(self._first_bits(self.hashes), np.arange(1 << self.bits)).astype(np.int32)

    def _first_bits(self, x: np.ndarray) -> np.ndarray:
        sign = np.uint64(1 << 63 if x.dtype == np.int64 else 0)
        return ((x.view(np.uint64) ^ sign) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it holds the number) of each number; the list is not empty."""
        last = len(self.hashes) - 1
        at = np.minimum(self.starts[self._first_bits(x)], last)
        here = self.hashes[at]
        behind = np.flatnonzero((here < x) & (at < last))
        while len(behind):
            at[behind] += 1
            here[behind] = self.hashes[at[behind]]
            behind = behind[(here[behind] < x[behind]) & (at[behind] < last)]
        return at, here == x


@dataclass
class Near:
    """The most frequent words by rank, and after them the start (as a context) or the end (as a dish)."""

    sorted_hashes: np.ndarray
    rank: np.ndarray

    @cached_property
    def places(self) -> Places:
        return Places(self.sorted_hashes)

    @cached_property
    def by_rank(self) -> np.ndarray:
        out = np.empty_like(self.sorted_hashes)
        out[self.rank] = self.sorted_hashes
        return out

    @cached_property
    def with_start(self) -> np.ndarray:
        return np.append(self.by_rank, START)

    @cached_property
    def with_end(self) -> np.ndarray:
        return np.append(self.by_rank, END)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word, or its hash."""
        if not len(self.rank):
            return h
        at, found = self.places.find(h)
        return np.where(found, self.rank[at], h)

    def keys(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        k = len(self.rank)
        return pair_keys(filled(u, k, self.with_start, u), filled(w, k, self.with_end, w))


def steps(near: Near, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(context, dish) of each token of a text, its end included."""
    ids, k = near.ids(hashes(text)), len(near.rank)
    return np.concatenate(([k], ids)), np.append(ids, k)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, n) of all training words."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            found = Counter()
            for text in raw_texts(batch, "text"):
                found.update(text.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(hashed(found)), pa.array(found.values(), pa.int64())], names=["h", "n"])

    return train.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def pair_counts(train: DataFrame, near) -> DataFrame:
    """(u, w, n): how often dish w follows context u in training texts, for all pairs."""

    def counted(us: list, ws: list) -> pa.RecordBatch:
        u, w, k = np.concatenate(us), np.concatenate(ws), len(near.value.rank)
        inside = both_near(u, w, k)
        # two ranks make one number, which is sorted sooner
        code, n = np.unique(u[inside] * (k + 1) + w[inside], return_counts=True)
        far_u, far_w = u[~inside], w[~inside]
        order = np.lexsort((far_w, far_u))
        far_u, far_w = far_u[order], far_w[order]
        first = np.flatnonzero(np.append(True, (far_u[1:] != far_u[:-1]) | (far_w[1:] != far_w[:-1]))[:len(far_u)])
        columns = np.append(code // (k + 1), far_u[first]), np.append(code % (k + 1), far_w[first]), np.append(n, np.diff(np.append(first, len(far_u))))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["u", "w", "n"])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, ws, held = [], [], 0
        for batch in batch_iter:
            for text in raw_texts(batch, "text"):
                u, w = steps(near.value, text)
                us.append(u)
                ws.append(w)
                held += len(u)
                if held > 1_000_000:
                    yield counted(us, ws)
                    us, ws, held = [], [], 0
        if us:
            yield counted(us, ws)

    return train.select("text").mapInArrow(run, "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n"))


class Tally:
    """Sums by word, as the context and as the dish of pairs: frequent words are added up here, others are given on."""

    def __init__(self, k: int):
        self.near = np.zeros((2, k + 1), np.int64)

    def add(self, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for side, ids in enumerate((u, w)):
            inside = (ids >= 0) & (ids < self.near.shape[1])
            np.add.at(self.near[side], ids[inside], n[inside])
            if not inside.all():
                far, zero = ids[~inside], np.zeros(len(ids) - inside.sum(), np.int64)
                yield self._rows(far, zero if side else n[~inside], n[~inside] if side else zero)

    def rest(self) -> pa.RecordBatch:
        found = np.flatnonzero(self.near.any(0))
        return self._rows(found, *self.near[:, found])

    def _rows(self, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id", "contexts", "dishes"])


def by_word(rows: DataFrame, run: Callable) -> DataFrame:
    """(id, contexts, dishes) of what a function gives of rows by a tally."""
    return rows.mapInArrow(run, "id long, contexts long, dishes long").groupBy("id").agg(F.sum("contexts").alias("contexts"), F.sum("dishes").alias("dishes"))


def repeats_by_word(again: DataFrame, k: int) -> DataFrame:
    """(id, contexts, dishes): over the pairs in which a word is the context, and in which it is the dish, how often
    they occur beyond once. A word's own count less this is its number of pairs."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(k)
        for batch in batch_iter:
            u, w, n = (batch.column(c).to_numpy() for c in ("u", "w", "n"))
            yield from tally.add(u, w, n - 1)
        yield tally.rest()

    return by_word(again.select("u", "w", "n"), run)


@dataclass
class Base:
    """Of the most frequent words: in how many pairs each is the context, and in how many the dish. Sums that follow
    from these and from the sweeps' further tables are computed where they are needed, and held in ``made``."""

    contexts: np.ndarray
    dishes: np.ndarray
    made: dict = field(default_factory=dict)

    def tables(self, sweeps: list[Sweep], number: int) -> np.ndarray:
        """Each context's tables before the sweep of this number."""
        if ("t", number) not in self.made:
            self.made["t", number] = self._with(self.contexts, sweeps[number - 1].contexts if number else None, sweeps, number)
        return self.made["t", number]

    def customers(self, sweeps: list[Sweep], number: int) -> np.ndarray:
        """Each dish's customers in the parent restaurant before the sweep of this number."""
        return self._with(self.dishes, sweeps[number - 1].dishes if number else None, sweeps, number)

    def _with(self, first: np.ndarray, more: np.ndarray | None, sweeps: list[Sweep], number: int) -> np.ndarray:
        out = first.astype(np.int64)
        if number:
            out[sweeps[number - 1].ids] += more
        return out

    def parent(self, near: Near, sweeps: list[Sweep], root: Root, own_sum: float, s: Settings) -> np.ndarray:
        """The parent's probability of each dish in a sweep."""
        if ("p", root.sweep) not in self.made:
            c = self.customers(sweeps, root.sweep)
            self.made["p", root.sweep] = root.probability(c, root.seated(c, near.with_end, s), own_sum, s)
        return self.made["p", root.sweep]


@dataclass
class Sweep:
    """One sweep: its parent restaurant, that one's tables, and the words' tables beyond one a pair."""

    root: Root
    own: float
    ids: np.ndarray | None = None
    contexts: np.ndarray | None = None
    dishes: np.ndarray | None = None

    def without_words(self) -> Sweep:
        return Sweep(self.root, self.own)

    def rare(self, c: int, s: Settings) -> float:
        """The parent's probability of a dish with c = 0 or 1 customers, which has as many tables."""
        one = np.array([float(c)])
        return float(self.root.probability(one, one, self.own, s)[0])


def is_near(column: str, k: int) -> Column:
    return F.col(column).between(0, k)


def both_near(u: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    return (u >= 0) & (u <= k) & (w >= 0) & (w <= k)


def filled(ids: np.ndarray, k: int, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    inside = (ids >= 0) & (ids <= k)
    return np.where(inside, near[np.where(inside, ids, k)], far)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of numbers; null becomes NaN."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(x.max(initial=0)))


class Model:
    """Training counts, the sampled sums, and what is sent to tasks."""

    def __init__(self, train: DataFrame, s: Settings):
        self.s, self.context = s, train.sparkSession.sparkContext
        self.texts = train.count()
        self.counts = stored(word_counts(train), "words")
        total = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.kinds = total["n"] + self.texts, total["v"] + (1 if self.texts else 0)
        top = self.counts.orderBy(F.desc("n"), "h").limit(s.sent).toArrow()
        by_rank, self.near_counts = top.column("h").to_numpy(), np.append(top.column("n").to_numpy(), self.texts)
        order = np.argsort(by_rank)
        self.k = len(by_rank)
        self.near = self.context.broadcast(Near(by_rank[order], order.astype(np.int32)))
        last = (int(by_rank[-1]), int(self.near_counts[-2])) if self.k else (0, 1 << 62)
        self.rest = self.counts.where((F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("h") > last[0]))).select(F.col("h").alias("id"), "n")
        #: whether a word that is not sent may occur more than once
        self.multi = not self.rest.where("n > 1").limit(1).isEmpty()
        #: pairs that occur again lie apart from those that occur once, which the sweeps do not read
        self.pairs = stored(pair_counts(train, self.near).withColumn("again", F.col("n") > 1), "pairs", by="again")
        self.again, self.once = self.pairs.where("again").drop("again"), self.pairs.where("NOT again").drop("again")
        self._sample()
        self._send()

    def _repeated(self, far: DataFrame | None, of_u: list[str], of_w: list[str]) -> DataFrame:
        """Pairs that occur twice or more, with these columns of their words where these are not sent."""
        rows, both = self.again, is_near("u", self.k) & is_near("w", self.k)
        none = [F.lit(None).cast("double").alias(c) for c in of_u + of_w]
        if far is None:
            return rows.select("u", "w", "n", *none)
        joined = rows.where(~both).join(far.select(F.col("id").alias("u"), *of_u), "u", "left").join(far.select(F.col("id").alias("w"), *of_w), "w", "left")
        return rows.where(both).select("u", "w", "n", *none).unionByName(joined)

    def _sample(self) -> None:
        s, k, near = self.s, self.k, self.near
        first = stored(repeats_by_word(self.again, k), "by-word")
        contexts, dishes = self.near_counts.astype(np.int64), self.near_counts.astype(np.int64)
        got = first.where(is_near("id", k)).toArrow()
        contexts[got["id"].to_numpy()] -= got["contexts"].to_numpy()
        dishes[got["id"].to_numpy()] -= got["dishes"].to_numpy()
        base = Base(small(contexts), small(dishes))
        self.base = self.context.broadcast(base)
        far = None
        if self.multi:
            pairs = {c: F.col("n") - F.coalesce(c, F.lit(0)) for c in ("contexts", "dishes")}
            far = self.rest.where("n > 1").join(first, "id", "left").withColumns(pairs)
            far = far.select("id", "contexts", "dishes", F.col("contexts").cast("double").alias("t0"), F.col("dishes").alias("c"))
            far = stored(far, "far")
        ones = self.rest.where("n = 1").count()
        root_tables, sweeps = float(self.kinds), []
        for number in range(s.sweeps):
            c = base.customers(sweeps, number)
            held = far.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0] if self.multi else 0
            root = Root(float(c.sum() + held + ones), root_tables, self.kinds, number)
            root_tables = float(root.seated(c, near.value.with_end, s).sum() + ones)
            t, p = f"t{number}", f"p{number}"
            if self.multi:
                far = stored(self._seat_far(far, root), "far")
                root_tables += far.agg(F.coalesce(F.sum("own"), F.lit(0.0))).first()[0]
                share = (F.greatest(F.col("c") - s.discount * F.col("own"), F.lit(0.0)) + (s.strength + s.discount * root_tables) / (self.kinds + 1)) / (s.strength + root.customers)
                far = far.withColumn(p, share)
            sweeps.append(Sweep(root, root_tables))
            sent = self.context.broadcast([x.without_words() for x in sweeps[:-2]] + sweeps[-2:])
            more = self._sweep(self._repeated(far, [t], [p]), sent)
            if self.multi:
                more = stored(more, "more")
            got = more.where(is_near("id", k)).toArrow()
            sent.destroy()  # what was made with it is stored or here
            sweeps[-1].ids, sweeps[-1].contexts, sweeps[-1].dishes = (small(got[c].to_numpy()) for c in ("id", "contexts", "dishes"))
            if self.multi:
                added = more.where(~is_near("id", k)).select("id", F.col("contexts").alias("mc"), F.col("dishes").alias("md"))
                far = stored(far.drop("own").join(added, "id", "left").withColumns({
                    f"t{number + 1}": (F.col("contexts") + F.coalesce("mc", F.lit(0))).cast("double"), "c": F.col("dishes") + F.coalesce("md", F.lit(0)),
                }).drop("mc", "md"), "far")
        # the sweeps that count start from the tables of the one before
        self.sweeps, self.far = [x.without_words() if i < s.burn_in - 1 else x for i, x in enumerate(sweeps)], far

    def _seat_far(self, far: DataFrame, root: Root) -> DataFrame:
        s = self.s

        def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batch_iter:
                own = root.seated(batch.column("c").to_numpy(), batch.column("id").to_numpy(), s)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "own"])

        return far.mapInArrow(run, T.StructType([*far.schema.fields, T.StructField("own", T.DoubleType())]))

    def _sweep(self, rows: DataFrame, sent) -> DataFrame:
        """(id, contexts, dishes): a word's tables beyond one a pair, as the context and as the dish."""
        s, k, near, base = self.s, self.k, self.near, self.base

        def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sweeps = sent.value
            last, number = sweeps[-1], len(sweeps) - 1
            parent, tables = base.value.parent(near.value, sweeps, last.root, last.own, s), base.value.tables(sweeps, number)
            tally = Tally(k)
            for batch in batch_iter:
                u, w = batch.column("u").to_numpy(), batch.column("w").to_numpy()
                pw, tu = filled(w, k, parent, column(batch, f"p{number}")), filled(u, k, tables, column(batch, f"t{number}"))
                extra = (seat(batch.column("n").to_numpy(), pw, tu, near.value.keys(u, w), number, s) - 1).astype(np.int64)
                some = extra > 0
                yield from tally.add(u[some], w[some], extra[some])
            yield tally.rest()

        return by_word(rows, run)

    def _send(self) -> None:
        s, k, near, base = self.s, self.k, self.near, self.base
        kept = range(s.burn_in, s.sweeps)
        rows = self._repeated(self.far, [f"t{i}" for i in kept], [f"p{i}" for i in kept])
        # the most frequent pairs, as many whole counts as fit
        most, cut, room = 1 << 16, (1 << 16) + 1, s.sent_pairs
        for n, size in sorted(self.again.groupBy(F.least("n", F.lit(most))).count().collect(), reverse=True):
            if size > room:
                break
            cut, room = n, room - size
        sweeps = self.context.broadcast(self.sweeps)
        swept(self.pairs.sparkSession)

        def frequent(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batch_iter:
                keys, x = seated_weights(batch, near.value, base.value, sweeps.value, s)
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([x.astype(np.float32).tobytes()])], names=["keys", "xs"])

        self.cut = cut
        top = rows.where(F.col("n") >= cut).mapInArrow(frequent, "keys binary, xs binary").toArrow()
        keys, x = (np.frombuffer(b"".join(top.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("xs", np.float32)))
        sweeps.destroy()
        order = np.argsort(keys)
        top = keys[order], x[order]
        left = self.again.where(F.col("n") < cut).select("u", "w")
        if self.multi:  # and the words that are not sent and occur twice or more
            left = left.unionByName(self.rest.where("n > 1").select(F.col("id").alias("u"), F.lit(None).cast("long").alias("w")))
        bloom = bloom_of(left, near, fitting_bits(left.count(), s))
        kinds, run = np.unique(self.near_counts[:-1], return_counts=True)
        self.sent = self.context.broadcast(Sent(k, kinds[::-1], run[::-1], self.texts, self.sweeps, top[0], top[1], bloom, s))
        del self.sweeps, self.near_counts  # the driver does not need them again
        swept(self.pairs.sparkSession)


def fitting_bits(n: int, s: Settings) -> int:
    return min(s.bits, max(64, 1 << (16 * n).bit_length()))


def bloom_of(rows: DataFrame, near, bits: int) -> np.ndarray:
    """A Bloom filter of the pairs (u, w), and of the words u where w is null."""

    def marks(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            if batch.num_rows:
                u, w = batch.column("u").to_numpy(), batch.column("w").fill_null(0).to_numpy()
                word = batch.column("w").is_null().to_numpy(zero_copy_only=False)
                at = np.unique(np.where(word, root_keys(u), near.value.keys(u, w)) & np.uint64(bits - 1))
                word = at >> np.uint64(6)
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(mask.view(np.int64))], names=["at", "mask"])

    marked = rows.mapInArrow(marks, "at long, mask long")
    marked = marked.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    for batch in marked.to_batches():
        bloom[batch.column("at").to_numpy()] = batch.column("mask").to_numpy().view(np.uint64)
    return bloom


def in_bloom(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bloom) * 64 - 1)
    return (bloom[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def seated_weights(batch: pa.RecordBatch, near: Near, base: Base, sweeps: list[Sweep], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(key, customers less the discount of their tables, averaged over the sweeps that count) of each pair."""
    u, w, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "w", "n"))
    keys, total, k = near.keys(u, w), np.zeros(len(u)), len(near.rank)
    for i in range(s.burn_in, s.sweeps):
        parent = filled(w, k, base.parent(near, sweeps, sweeps[i].root, sweeps[i].own, s), column(batch, f"p{i}"))
        tables = filled(u, k, base.tables(sweeps, i), column(batch, f"t{i}"))
        total += n - s.discount * seat(n, np.nan_to_num(parent), np.nan_to_num(tables, nan=1.0), keys, i, s)
    return keys, total / (s.sweeps - s.burn_in)


@dataclass
class Sent:
    """What every task has for scoring; see the module's bounds."""

    k: int
    kinds: np.ndarray
    runs: np.ndarray
    texts: int
    sweeps: list[Sweep]
    pair_keys: np.ndarray
    pair_weights: np.ndarray
    bloom: np.ndarray
    s: Settings
    ready: bool = False

    def prepare(self, near: Near, base: Base) -> Sent:
        """Computes the sums of the words that are sent, once a process."""
        if not self.ready:
            s, kept = self.s, range(self.s.burn_in, self.s.sweeps)
            self.count = np.append(np.repeat(self.kinds, self.runs), self.texts)
            self.log_count = np.log10(self.count + 1.0)
            inverse = 1 / (s.strength + self.count)
            back = [(s.strength + s.discount * base.tables(self.sweeps, i + 1)) * inverse for i in kept]
            parent = [base.parent(near, self.sweeps, self.sweeps[i].root, self.sweeps[i].own, s) / len(kept) for i in kept]
            self.rare = np.array([[self.sweeps[i].rare(c, s) for i in kept] for c in (0, 1)])
            # a word's numbers lie side by side; the last row is for words that are not sent, which occur once
            one = [1 / (s.strength + 1), *[(s.strength + s.discount) / (s.strength + 1) for _ in kept]]
            self.of_u = np.vstack([np.column_stack([inverse, *back]), one])
            self.of_w = np.vstack([np.column_stack(parent), self.rare[1] / len(kept)])
            self.places = Places(self.pair_keys)
            self.ready = True
        return self

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the pair is sent, its weight)."""
        if not len(self.pair_keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at, found = self.places.find(keys)
        return found, np.where(found, self.pair_weights[at], 0.0)

    def marked(self, keys: np.ndarray) -> np.ndarray:
        return in_bloom(self.bloom, keys)

    def log(self, weight: np.ndarray, u: np.ndarray, w: np.ndarray, far: dict | None = None) -> np.ndarray:
        """log10 probability of each pair. Words that are not sent occur once, but as ``far`` has them."""
        if far is None:
            of_u, of_w = (x[np.where((ids >= 0) & (ids <= self.k), ids, self.k + 1)] for x, ids in ((self.of_u, u), (self.of_w, w)))
            return np.log10(weight * of_u[:, 0] + np.einsum("ij,ij->i", of_u[:, 1:], of_w))
        p = weight * filled(u, self.k, self.of_u[:, 0], far["inverse"])
        for i, (back, parent) in enumerate(zip(far["back"], far["parent"])):
            p = p + filled(u, self.k, self.of_u[:, i + 1], back) * filled(w, self.k, self.of_w[:, i], parent / len(far["parent"]))
        return np.log10(p)


def _asked_pairs(made: Model, asked: DataFrame, n: int) -> Callable[[Column], DataFrame]:
    """Pairs that fulfil a condition, less those that nobody asks for where a filter can tell; joins get the others."""
    near, bits = made.near, max(64, min(fitting_bits(n, made.s), made.s.bits >> 2))
    if n > bits:  # nearly every pair would pass
        return made.pairs.where
    wanted = made.context.broadcast(bloom_of(asked.select("u", "w"), near, bits))
    swept(asked.sparkSession)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            keys = near.value.keys(batch.column("u").to_numpy(), batch.column("w").to_numpy())
            yield batch.filter(pa.array(in_bloom(wanted.value, keys)))

    return lambda condition: made.pairs.where(condition).mapInArrow(run, made.pairs.schema)


def _deltas(made: Model, once: DataFrame) -> DataFrame:
    """(key, learned, unseen) of pairs of words that are sent: by how much log10 of their probability differs from what
    a training text takes for a pair that it does not find, and from what another text does."""
    s, k, near, sent, sums = made.s, made.k, made.near, made.sent, made.base
    kept = range(s.burn_in, s.sweeps)
    none = [F.lit(None).cast("double").alias(c) for i in kept for c in (f"t{i}", f"p{i}")]
    inside = is_near("u", k) & is_near("w", k)
    again = made.again.where(inside & (F.col("n") < made.cut)).select("u", "w", "n", *none)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = sent.value.prepare(near.value, sums.value), near.value
        for batch in batch_iter:
            u, w = batch.column("u").to_numpy(), batch.column("w").to_numpy()
            _, weight = seated_weights(batch, words, sums.value, m.sweeps, s)
            value, one = m.log(weight, u, w), np.ones(len(u))
            learned, unseen = (value - m.log(x * one, u, w) for x in (1 - s.discount, 0))
            yield rows(u, w, learned, unseen)

    def run_once(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.prepare(near.value, sums.value)
        for batch in batch_iter:
            u, w = batch.column("u").to_numpy(), batch.column("w").to_numpy()
            one = np.ones(len(u))
            yield rows(u, w, 0 * one, m.log((1 - s.discount) * one, u, w) - m.log(0 * one, u, w))

    def rows(u: np.ndarray, w: np.ndarray, learned: np.ndarray, unseen: np.ndarray) -> pa.RecordBatch:
        columns = u * (k + 1) + w, learned.astype(np.float32), unseen.astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "learned", "unseen"])

    out = "key long, learned float, unseen float"
    return again.mapInArrow(run, out).unionByName(once.select("u", "w").mapInArrow(run_once, out))


def score(docs: DataFrame, held_out: Column, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row.

    Learns from the rows whose ``held_out`` is false; where it is null (as for a null doc_id) the row is scored only.
    Null text is empty and has its end as the only token. Rows that repeat a doc_id are scored each. An empty table
    gives no rows; without training rows every word is unknown.
    """
    s = settings or Settings()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    made = Model(source.where(~F.col("held_out")), s)
    near, sent, sums, k = made.near, made.sent, made.base, made.k
    low = float(np.log10(made.tokens + (made.kinds + 1)))

    def scored(batch: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray]], m: Sent, words: Near) -> pa.RecordBatch:
        """Rows with what is known here, and the lists of pairs left open. Each pair is looked up once for all texts."""
        texts, tokens = len(found), np.array([len(u) for u, _ in found])
        u, w = (np.concatenate(x) for x in zip(*found))
        doc = np.repeat(np.arange(texts), tokens)
        code, far = u * (k + 1) + w, np.flatnonzero(~both_near(u, w, k))
        code[far] = words.keys(u[far], w[far]).view(np.int64) | 1 << 62  # beyond what ranks can make
        order = np.argsort(code)
        new = np.append(True, np.diff(code[order]) != 0)
        first, pair = order[new], np.empty(len(code), np.int64)
        pair[order] = np.cumsum(new) - 1
        u, w = u[first], w[first]
        keys = words.keys(u, w)
        here = (w >= 0) & (w <= k)
        far = ~both_near(u, w, k)
        sent_pair, weight = m.look(keys)
        # a training text's pairs and words occur, and once unless sent or marked
        again = np.zeros(len(keys), bool)
        for ids in (u, w):
            beyond = np.flatnonzero((ids < 0) | (ids > k))
            again[beyond] |= m.marked(root_keys(ids[beyond]))
        learned = np.array([x is False for x in batch.column("held_out").to_pylist()])[doc]
        ask = np.where(learned, ((again & far) | (~sent_pair & m.marked(keys)))[pair], (far | ~sent_pair)[pair])
        # what a pair of words that are sent has if the joins do not find it
        unseen, value = np.zeros(len(keys), bool), m.log(np.where(sent_pair, weight, 1 - s.discount), u, w)
        unseen[pair[~learned]] = True
        unseen &= ~sent_pair & ~far
        absent = value.copy()
        absent[unseen] = m.log(np.zeros(unseen.sum()), u[unseen], w[unseen])
        value = np.where(learned, value[pair], absent[pair])
        at = np.where(here, w, k)
        c, log_count = np.where(here, m.count[at], 1), np.where(here, m.log_count[at], np.log10(2.0))
        settled = here[pair] | ~ask

        def per_text(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x, texts)

        known = per_text(settled & (c > 0)[pair]).astype(np.int64)
        base = per_text(np.where(settled, log_count[pair], 0.0)) - tokens * low
        left, times = np.unique(doc[ask] * len(keys) + pair[ask], return_counts=True)
        value[ask & far[pair]] = 0.0
        left_doc, left_pair = np.divmod(left, len(keys))
        ends = pa.array(np.searchsorted(left_doc, np.arange(texts + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (u[left_pair], w[left_pair], times.astype(np.int32))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(per_text(value)), *lists],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base", "value", "u", "w", "m"],
        )

    def local(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = sent.value.prepare(near.value, sums.value), near.value
        for batch in batch_iter:
            start, found, held = 0, [], 0
            for no, text in enumerate(raw_texts(batch, "text"), 1):
                found.append(steps(words, text))
                held += len(found[-1][0])
                if held > MOST_TOKENS or no == batch.num_rows:
                    yield scored(batch.slice(start, no - start), found, m, words)
                    start, found, held = no, [], 0

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, value double, u array<long>, w array<long>, m array<int>"
    first = stored(source.mapInArrow(local, out).withColumn("row", F.monotonically_increasing_id()), "scores")
    learned, inside, kept = ~F.coalesce("held_out", F.lit(True)), is_near("u", k) & is_near("w", k), range(s.burn_in, s.sweeps)
    asked = first.select("row", learned.alias("known"), F.explode(F.arrays_zip("u", "w", "m")).alias("x")).select("row", "known", "x.u", "x.w", "x.m")
    of_u, of_w = [f"t{i}" for i in range(s.burn_in, s.sweeps + 1)], [f"p{i}" for i in kept]
    shape = {c: F.lit(None).cast("double") for c in of_u + of_w}
    # what a training text asks for and does not find occurs once, so pairs that occur once are for the other texts
    pairs = _asked_pairs(made, asked.where("NOT known"), first.where(~learned).agg(F.coalesce(F.sum(F.size("u")), F.lit(0))).first()[0])
    once = ~F.col("again")
    found = asked.where(inside).select("row", "known", (F.col("u") * (k + 1) + F.col("w")).alias("key"), "m").join(_deltas(made, pairs(once & inside)), "key")
    nearby = found.groupBy("row").agg(F.sum(F.col("m") * F.when(F.col("known"), F.col("learned")).otherwise(F.col("unseen"))).alias("more"))
    words = made.rest.withColumns(shape) if made.far is None else made.rest.join(made.far.select("id", *of_u, *of_w), "id", "left")
    side_u = words.select(F.col("id").alias("u"), F.col("n").alias("nu"), *of_u)
    side_w = words.select(F.col("id").alias("w"), F.col("n").alias("nw"), *of_w)
    far_pairs = made.again.where(~inside).unionByName(pairs(once & ~inside).drop("again"))
    others = asked.where(~inside).join(far_pairs, ["u", "w"], "left").withColumn("n", F.coalesce("n", F.col("known").cast("long")))
    others = others.join(side_u, "u", "left").join(side_w, "w", "left").select("row", "u", "w", "m", "n", "nu", "nw", *of_u, *of_w)

    def answer(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = sent.value.prepare(near.value, sums.value), near.value
        for batch in batch_iter:
            plain = {c: batch.column(c).fill_null(0) for c in ("n", "nu", "nw")}
            for c, values in plain.items():
                batch = batch.set_column(batch.schema.get_field_index(c), c, values)
            u, w, times = batch.column("u").to_numpy(), batch.column("w").to_numpy(), batch.column("m").to_numpy()
            nu, nw = plain["nu"].to_numpy(), plain["nw"].to_numpy()
            _, weight = seated_weights(batch, words, sums.value, m.sweeps, s)
            rare, t = m.rare[np.minimum(nw, 1)].T, {i: column(batch, f"t{i + 1}") for i in kept}
            far = {
                "inverse": 1 / (s.strength + nu),
                "back": [(s.strength + s.discount * np.where(np.isnan(t[i]), np.minimum(nu, 1), t[i])) / (s.strength + nu) for i in kept],
                "parent": [np.where(np.isnan(p), rare[j], p) for j, p in enumerate(column(batch, c) for c in of_w)],
            }
            value = times * m.log(weight, u, w, far)
            away = ~((w >= 0) & (w <= k))
            known, base = np.where(away & (nw > 0), times, 0), np.where(away, times * np.log10(nw + 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(known, pa.int64()), pa.array(base), pa.array(value)], names=["row", "known", "base_more", "more"])

    later = others.mapInArrow(answer, "row long, known long, base_more double, more double")
    nothing = {"known": F.lit(0).cast("long"), "base_more": F.lit(0.0)}
    later = later.unionByName(nearby.withColumns(nothing)).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base_more", "more")])
    done = first.drop("u", "w", "m").join(later, "row", "left")
    result = F.col("value") + F.coalesce("more", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(made.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), result.alias("score"), F.pow(F.lit(10.0), -result / F.col("n_tokens")).alias("perplexity"),
    )
