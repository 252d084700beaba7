import math
import os
import random
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickerloom.llm import pitman_yor, queries


def test_query_base_score(spark, tmp_path):
    rows = cases.texts(5)
    folder = cases.table(spark, tmp_path, "documents", cases.documents(spark, rows))
    got = {r.doc_id: r for r in queries.QUERIES["op8_lm_scoring"](spark, folder).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for d, t in rows:
        r, w = got[d], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / len(w)), rel_tol=1e-9)


def grammar(n, seed):
    rng = random.Random(seed)
    follow = {w: rng.sample([f"w{i}" for i in range(40)], 3) for w in [f"w{i}" for i in range(40)]}
    rng = random.Random(seed + n)
    out = []
    for _ in range(n):
        w, text = "w0", []
        for _ in range(30):
            w = rng.choice(follow[w])
            text.append(w)
        out.append(" ".join(text))
    return out


def test_order_of_words_is_learned(spark):
    rows = list(enumerate(grammar(150, 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pitman_yor.score(docs, F.col("doc_id") % 3 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.75 * got[1]


MASK = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_seat(n, base, tables, key, sweep, s):
    t, k = min(n, 1), 1
    while k < n:
        block = min(max(1, k // 16), n - k)
        weight = (s.strength + s.discount * tables) * base
        draw = (mix(key ^ mix(((s.seed * 1_000_003 + sweep) << 20) + k)) >> 11) / 2**53
        t += math.floor(block * weight / (weight + max(k - s.discount * t, 1e-9)) + draw)
        k += max(1, k // 16)
    return t


def plain_scores(rows, held, s):
    """Dictionaries and one pair at a time, without ranks, joins or filters. Returns scores and the sum of predictions."""
    code = lambda x: x if isinstance(x, int) else xxhash.xxh3_64_intdigest(x.encode()) | 1 << 40
    def steps(t):
        words = (t or "").lower().split()
        return list(zip([11, *map(code, words)], [*map(code, words), 13]))

    pairs = Counter(p for d, t in rows if not held(d) for p in steps(t))
    key = {p: mix((mix((p[0] + 0x9E3779B97F4A7C15) & MASK) + p[1]) & MASK) for p in pairs}
    customers, tables, guests = Counter(), Counter(), Counter()
    for (u, w), n in pairs.items():
        customers[u] += n
        tables[u] += 1
        guests[w] += 1
    kinds, root = len(guests), float(len(guests))
    kept = []
    for sweep in range(s.sweeps):
        own = {w: plain_seat(c, 1 / (kinds + 1), root, mix(w ^ 0xA5A5A5A5), sweep, s) for w, c in guests.items()}
        total, root = sum(guests.values()), sum(own.values())
        parent = {w: (max(guests[w] - s.discount * own[w], 0) + (s.strength + s.discount * root) / (kinds + 1)) / (s.strength + total) for w in guests}
        fresh = (s.strength + s.discount * root) / (kinds + 1) / (s.strength + total)
        t = {p: plain_seat(n, parent[p[1]], tables[p[0]], key[p], sweep, s) for p, n in pairs.items()}
        tables, guests = Counter(), Counter()
        for (u, w), x in t.items():
            tables[u] += x
            guests[w] += x
        if sweep >= s.burn_in:
            kept.append((t, dict(tables), parent, fresh))

    def predict(u, w):
        p = 0
        for t, tables, parent, fresh in kept:
            mine = pairs[u, w] - s.discount * t.get((u, w), 0)
            p += (mine + (s.strength + s.discount * tables.get(u, 0)) * parent.get(w, fresh)) / (s.strength + customers[u]) / len(kept)
        return p

    sums = [sum(predict(u, w) for w in guests) + predict(u, 5) for u in [*list(customers)[:5], 7]]
    return {d: sum(math.log10(predict(*p)) for p in steps(t)) for d, t in rows}, sums


@pytest.mark.parametrize("sent, sent_pairs, bits", [(1000, 1000, 1 << 16), (7, 12, 1 << 16), (7, 0, 64), (0, 0, 1 << 10), (30, 5, 128), (0, 1000, 64)])
def test_scores_do_not_depend_on_what_is_sent(spark, sent, sent_pairs, bits):
    rng = random.Random(4)
    words = [f"w{int(rng.expovariate(0.15))}" for _ in range(700)] + [f"once{i}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "new w0 new w1 once3 new"), (63, "w0 " * 3000)]
    s = pitman_yor.Settings(sent=sent, sent_pairs=sent_pairs, bits=bits)
    held = lambda d: d % 4 == 1
    want, sums = plain_scores(rows, held, s)
    assert np.allclose(sums, 1)
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 == 1, s).collect()
    known = Counter(x for d, t in rows if not held(d) for x in [*(t or "").split(), None])
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-5), r
        tokens = [*(dict(rows)[r.doc_id] or "").split(), None]
        assert r.n_known == sum(known[x] > 0 for x in tokens)
        assert math.isclose(r.base_score, sum(math.log10((known[x] + 1) / (sum(known.values()) + len(known) + 1)) for x in tokens), rel_tol=1e-9)


def test_tables_per_dish():
    s, keys = pitman_yor.Settings(), np.arange(5, dtype=np.uint64)
    t = pitman_yor.seat(np.array([0, 1, 2, 5000, 10**9]), np.full(5, 0.2), 10.0, keys, 0, s)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and t[2] <= t[3] <= 200 and t[4] < 500


def test_awkward_tables(spark):
    held = F.lit(True)
    got = pitman_yor.score(cases.documents(spark, [(1, None), (1, "a b"), (1, "a b"), (None, "c")]), held).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 3, 3] and all(r.n_known == 0 and math.isfinite(r.score) and r.train_tokens == 0 for r in got)
    assert pitman_yor.score(cases.documents(spark, []), held).count() == 0


def test_broadcasts_of_finished_sweeps_are_removed(spark, monkeypatch):
    sent, real = [], type(spark.sparkContext).broadcast

    def watched(self, value):
        sent.append((value, real(self, value)))
        return sent[-1][1]

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", watched)
    monkeypatch.setattr(pitman_yor, "MOST_TOKENS", 20)
    rows = list(enumerate(grammar(20, 1)))
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 == 0).collect()
    want, _ = plain_scores(rows, lambda d: d % 3 == 0, pitman_yor.Settings())
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-5) for r in got)
    sweeps = [(value, x) for value, x in sent if isinstance(value, list)]
    assert len(sweeps) == 5 and all(not os.path.exists(x._path) for _, x in sweeps)
    assert all(sum(x.ids is not None for x in value) <= 3 for value, _ in sweeps)


def test_joins_get_only_pairs_that_are_asked_for(spark, monkeypatch):
    seen, real = [], pitman_yor._asked_pairs

    def watched(made, asked, n):
        pairs = real(made, asked, n)
        seen.append((pairs(F.lit(True)).count(), made.pairs.count(), asked.select("u", "w").distinct().join(made.pairs, ["u", "w"]).count(), asked.count() == n))
        return pairs

    monkeypatch.setattr(pitman_yor, "_asked_pairs", watched)
    rows = [(i, " ".join(f"w{i * 7 + j}" for j in range(20))) for i in range(40)]
    pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 == 1, pitman_yor.Settings(sent_pairs=0)).collect()
    joined, stored, asked, counted = seen[0]
    assert counted and 0 < asked <= joined < stored


@pytest.mark.parametrize("kind", [np.int64, np.uint64])
@pytest.mark.parametrize("n", [1, 2, 5, 3000])
def test_hashes_are_found_by_their_first_bits(n, kind):
    rng = np.random.default_rng(n)
    some = lambda m: rng.integers(0, 2**64, m, dtype=np.uint64).view(kind)
    there = np.unique(some(n))
    x = np.concatenate([rng.choice(there, 50), some(50), there[:1], there[-1:]])
    at, found = pitman_yor.Places(there).find(x)
    assert (found == np.isin(x, there)).all() and (there[at[found]] == x[found]).all()


def test_sweeps_read_pairs_that_occur_again(spark, capsys):
    """Numbers of pairs follow from the words' counts and the pairs that occur twice or more, which lie apart."""
    rows = list(enumerate(grammar(20, 3) + ["once0 w1 once1", "w1"]))
    made = pitman_yor.Model(spark.createDataFrame(rows, "doc_id long, text string"), pitman_yor.Settings(sent=10, sent_pairs=0))
    made.again.explain()
    plan = capsys.readouterr().out
    assert "again" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    pairs = [(r.u, r.w, r.n) for r in made.pairs.collect()]
    assert made.again.count() == sum(n > 1 for *_, n in pairs) and min(r.n for r in made.again.collect()) == 2
    u, w = Counter(u for u, _, _ in pairs), Counter(w for _, w, _ in pairs)
    base = made.base.value
    assert [base.contexts[i] for i in range(11)] == [u[i] for i in range(11)] and [base.dishes[i] for i in range(11)] == [w[i] for i in range(11)]
    assert all((r.contexts, r.dishes) == (u[r.id], w[r.id]) for r in made.far.select("id", F.col("t0").alias("contexts"), "dishes").collect())
