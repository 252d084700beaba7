"""Substring dedup with suffix automata of reference shards.

Passages that may repeat form shards of bounded size. A shard's suffix automaton holds every word sequence of
its passages, and each state knows the earliest place where its sequences end. Passages are streamed through it:
the matching statistics give the longest match that ends at each word, and from its state the suffix of window
length and that window's earliest place follow. What matches at an earlier place in at least the window length is
removed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Units, drop_repeats

NOWHERE = 1 << 126


class SuffixAutomaton:
    """Automaton of several sequences; ``origin`` of a state is the smallest place where its sequences end."""

    def __init__(self):
        self.length, self.link, self.next, self.origin = [0], [-1], [{}], [NOWHERE]

    def _split(self, p: int, symbol, q: int) -> int:
        """The state for the part of q's sequences that extend p's."""
        copy = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(self.next[q].copy())
        self.origin.append(NOWHERE)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, symbols: Iterable, place: int) -> None:
        """Add a sequence whose first symbol ends at ``place``; each further one at the next whole number."""
        length, link, edges, origin = self.length, self.link, self.next, self.origin
        last = 0
        for symbol in symbols:
            known = edges[last].get(symbol)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, symbol, known)
                if place < origin[last]:
                    origin[last] = place
            else:
                new = len(length)
                length.append(length[last] + 1)
                link.append(0)
                edges.append({})
                origin.append(place)
                p = last
                while p >= 0 and symbol not in edges[p]:
                    edges[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = edges[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
                last = new
            place += 1

    def settle(self) -> None:
        """Give every state the smallest place below it; call once after the last ``add``."""
        origin, link = self.origin, self.link
        for v in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            if origin[v] < origin[link[v]]:
                origin[link[v]] = origin[v]

    def statistics(self, symbols: Iterable):
        """Per symbol: length of the longest match that ends there, and its state."""
        state, matched = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            yield matched, state

    def origins(self, symbols: Iterable, least: int):
        """Per symbol: the smallest place of the last ``least`` symbols, None where no match is as long.

        Matching statistics cut off at ``least``: a longer match is followed by its last ``least`` symbols only, so
        the state is always the one that holds them.
        """
        edges, link, length, origin = self.next, self.link, self.length, self.origin
        state, matched = 0, 0
        for symbol in symbols:
            further = edges[state].get(symbol)
            while further is None and state:
                state = link[state]
                matched = length[state]
                further = edges[state].get(symbol)
            if further is not None:
                state = further
                matched += 1
                if matched >= least:
                    matched = least
                    while length[link[state]] >= least:
                        state = link[state]
                    yield origin[state]
                    continue
            yield None


def first_of_kind(length: int):
    """Kernel: builds the automaton of a shard and streams its passages; masks the windows without an earlier match."""

    def kernel(contexts: list[bytes], counts: list[int], docs: list[int], starts: list[int]) -> list[np.ndarray]:
        shard = SuffixAutomaton()
        passages = [c.split(b" ") for c in contexts]
        # documents in order, then words in order, as one number
        rank = {doc: i << 40 for i, doc in enumerate(sorted(set(docs)))}
        places = [rank[doc] + start for doc, start in zip(docs, starts)]
        for words, place in zip(passages, places):
            shard.add(words, place)
        shard.settle()
        out = []
        for words, n, place in zip(passages, counts, places):
            found = list(shard.origins(words, length))[length - 1 :]
            out.append(np.fromiter(map(int.__eq__, found, range(place + length - 1, place + length - 1 + n)), bool, n))
        return out

    return kernel


def drop_repeated_words(docs: DataFrame, length: int = 20, gram: int = 5, portion: int = 25_000, most_classes: int = 20_000, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_units, spans, kept, text, row): texts as words without what a repeated sequence of ``length`` words covers.

    See ``repeats.drop_repeats`` for the order, null and repeated rows. An automaton of the whole corpus could not
    be sent to every task, so shards hold the passages of a range of anchors, about ``portion`` bytes, and
    go to the task that streams the passages with these anchors.
    """
    return drop_repeats(docs, Units(True, length, gram), first_of_kind(length), portion, most_classes, id_col, text_col, keep, keep_anchors=True)
