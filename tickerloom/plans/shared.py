"""Per-``Tables`` memo, so that a query builds each derived frame once."""

from __future__ import annotations

import functools


def shared(fn):
    @functools.wraps(fn)
    def get(t):
        memo = t.__dict__.setdefault("_memo", {})
        if fn not in memo:
            memo[fn] = fn(t)
        return memo[fn]

    return get
