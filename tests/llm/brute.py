"""Plain versions of the operators' definitions, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def without_repeats(rows, length, as_words):
    """{doc_id: (units, removed, spans, kept bytes)} for (doc_id, text), ids distinct."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        units = [w.encode() for w in words(text)] if as_words else [bytes([b]) for b in (text or "").encode()]
        gone = [False] * len(units)
        for i in range(len(units) - length + 1):
            window = tuple(units[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(units), sum(gone), spans, (b" " if as_words else b"").join(u for u, g in zip(units, gone) if not g))
    return out


def sha(x):
    return hashlib.sha256(x).hexdigest()


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """{id: smallest id reachable}."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def simhash(rows):
    """{doc_id: (fingerprint, component)}."""
    fp = {d: fingerprint(t) for d, t in rows}
    roots = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    return {d: (f"{fp[d]:016x}", roots[d]) for d in fp}


def base_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def base_failed(text):
    n, *_, repeated = base_counts(text)
    return n < 10 or 100 * repeated > 20 * n


def votes(text):
    """Votes of the rules, 0 abstain, 1 good, 2 bad."""
    t = text or ""
    n, chars, symbols, dup, rep = base_counts(t)
    w, lines = words(t), len([x for x in t.split("\n") if words(x)])
    n1, l1 = max(n, 1), max(lines, 1)
    among = lambda s: sum(c in s for c in t)
    marks = among("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    short, capitals, shouts, ends = sum(len(x) <= 3 for x in w), sum("A" <= c <= "Z" for c in t), t.count("!"), among(".!?")
    v = lambda bad, good: 2 if bad else 1 if good else 0
    return (
        v(symbols > 0.1 * n1, symbols <= 0.01 * n1), v(marks > 0.12 * chars, marks < 0.08 * chars),
        v(short < 0.08 * n1, short > 0.15 * n1) if n >= 20 else 0, v(capitals > 0.3 * chars, capitals < 0.1 * chars),
        v(shouts > 0.2 * n1, shouts <= 0.02 * n1),
        v(rep > 0.15 * n1 or (dup > 0.5 * l1 and l1 > 3), rep <= 0.02 * n1 and dup <= 0.1 * l1) if n >= 20 else 0,
        v(len(set(w)) < 0.3 * n1, len(set(w)) > 0.45 * n1) if 30 <= n <= 5000 else 0,
        v(ends < 0.005 * n1 or ends > 0.5 * n1, 0.02 * n1 <= ends <= 0.3 * n1) if n >= 50 else 0,
    )


def good(texts):
    """Whether each text is kept: base rule, then expectation-maximisation one text at a time."""
    all_votes = [votes(t) for t in texts]
    seen = [v for v, t in zip(all_votes, texts) if not base_failed(t)]
    prior, on_good, on_bad = 0.2, [0.05] * 8, [0.5] * 8

    def p_good(vote):
        odds = math.log((1 - prior) / prior)
        for v, g, b in zip(vote, on_good, on_bad):
            odds += math.log(g / b) if v == 2 else math.log((1 - g) / (1 - b)) if v == 1 else 0
        return 1 / (1 + math.exp(min(-odds, 700)))

    for _ in range(40 if seen else 0):
        p = [p_good(v) for v in seen]
        rate = lambda j, weight: min(max((sum(x for x, v in zip(weight, seen) if v[j] == 2) + 1) / (sum(x for x, v in zip(weight, seen) if v[j]) + 20), 1e-4), 1 - 1e-4)  # noqa: E731,B023
        q = [1 - x for x in p]
        new_good = [rate(j, p) for j in range(8)]
        new_bad = [max(rate(j, q), new_good[j]) for j in range(8)]
        moved = max(abs(x - y) for x, y in zip(new_good + new_bad, on_good + on_bad))
        prior, on_good, on_bad = min((sum(q) + 1) / (len(seen) + 5), 0.5), new_good, new_bad
        if moved < 1e-5:
            break
    return [not base_failed(t) and p_good(v) >= 0.5 for t, v in zip(texts, all_votes)]


def pieces(ids, longest=2048):
    """(start, length, crc32) of the binary pieces of a list of ids."""
    out, at = [], 0
    while at < len(ids):
        size = longest
        while size > len(ids) - at:
            size //= 2
        out.append((at, size, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + size]))))
        at += size
    return out
