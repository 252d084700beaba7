"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation learns from their
agreement how each votes on good and on bad documents, and the posterior probability replaces all-must-pass.

DataFrame functions only. Votes are summed by pattern, so a round of the estimation reads at most
3 ** number-of-rules rows, whatever the number of documents, and returns one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import GAP, stored

#: The symbols that are counted, and white space.
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\f\r"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ABSTAIN, GOOD, BAD = 0, 1, 2
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that an array is computed once per row and not once per element that reads it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_q``: the base counts and what the rules read. Null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.columns
    out = _once(docs, _w=F.array_remove(F.split(text, GAP), ""))
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    out = _once(out, _h=F.when(F.size("_w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # only a text with a repeated window is worth sorting
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = _once(out, _s=F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("_s", lambda x, k: F.coalesce((x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"]), (x["h"] == F.get("_s", k - 1)["h"]), (x["h"] == F.get("_s", k + 1)["h"]), F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANK, "") != "")
    out = _once(out, _l=lines)
    return out.select(
        *own,
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            (F.length(F.translate(text, BLANK, ""))).cast("long").alias("word_chars"),
            _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
            _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
            _count_of(text, ".!?").cast("long").alias("n_ends"),
            _count_of(text, "!").cast("long").alias("n_shouts"),
            _count_of(text, MARKS).cast("long").alias("n_marks"),
            F.size(F.filter("_w", lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
        ).alias("_q"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Name and vote of each rule, over the struct ``_q``."""
    q = F.col("_q")
    n = F.greatest(q["n_words"], F.lit(1))
    lines = F.greatest(q["n_lines"], F.lit(1))
    some = lambda least, vote: F.when(q["n_words"] >= least, vote).otherwise(ABSTAIN)
    return {
        "symbols": _vote(q["n_symbols"] > 0.1 * n, q["n_symbols"] <= 0.01 * n),
        "punctuation": _vote(q["n_marks"] > 0.12 * q["word_chars"], q["n_marks"] < 0.08 * q["word_chars"]),
        "short_words": some(20, _vote(q["n_short"] < 0.08 * n, q["n_short"] > 0.15 * n)),
        "capitals": _vote(q["n_capitals"] > 0.3 * q["word_chars"], q["n_capitals"] < 0.1 * q["word_chars"]),
        "shouting": _vote(q["n_shouts"] > 0.2 * n, q["n_shouts"] <= 0.02 * n),
        "repetition": some(20, _vote((q["n_repeat_words"] > 0.15 * n) | ((q["n_dup_lines"] > 0.5 * lines) & (lines > 3)), (q["n_repeat_words"] <= 0.02 * n) & (q["n_dup_lines"] <= 0.1 * lines))),
        "distinct_words": F.when(q["n_words"].between(30, 5000), _vote(q["n_distinct"] < 0.3 * n, q["n_distinct"] > 0.45 * n)).otherwise(ABSTAIN),
        "sentence_ends": some(50, _vote((q["n_ends"] < 0.005 * n) | (q["n_ends"] > 0.5 * n), q["n_ends"].between(0.02 * n, 0.3 * n))),
    }


@dataclass
class Model:
    """Share of bad documents; per rule the probability that its vote is bad, on good and on bad documents."""

    bad: float
    on_good: list[float]
    on_bad: list[float]


#: Where the estimation begins, and how far apart a rule's two sides stay: a bad vote never speaks for a document.
START = (0.2, 0.05, 0.5)
FLOOR = 1e-4


def posterior(votes: list[str], model: Model) -> Column:
    """Probability that a document with these vote columns is good. A rule that abstains says nothing."""
    odds = F.lit(math.log((1 - model.bad) / model.bad))
    for v, g, b in zip(votes, model.on_good, model.on_bad):
        odds = odds + F.when(F.col(v) == BAD, F.lit(math.log(g / b))).when(F.col(v) == GOOD, F.lit(math.log((1 - g) / (1 - b)))).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(-odds, F.lit(700.0))))


def fit(patterns: DataFrame, votes: list[str], rounds: int = 40, tolerance: float = 1e-5) -> Model:
    """Expectation-maximisation over (votes..., n): one row per pattern seen. No row: the starting values."""
    model = Model(START[0], [START[1]] * len(votes), [START[2]] * len(votes))
    for _ in range(rounds):
        p = posterior(votes, model)
        sides = {"g": F.col("n") * p, "b": F.col("n") * (1 - p)}
        sums = [F.sum(w).alias(s) for s, w in sides.items()]
        for j, v in enumerate(votes):
            for s, w in sides.items():
                sums.append(F.sum(F.when(F.col(v) == BAD, w).otherwise(0.0)).alias(f"{s}{j}_bad"))
                sums.append(F.sum(F.when(F.col(v) != ABSTAIN, w).otherwise(0.0)).alias(f"{s}{j}_all"))
        row = patterns.agg(*sums).first()
        if row["g"] is None:
            return model
        rate = lambda s, j: min(max((row[f"{s}{j}_bad"] + 1) / (row[f"{s}{j}_all"] + 20), FLOOR), 1 - FLOOR)
        on_good = [rate("g", j) for j in range(len(votes))]
        on_bad = [max(rate("b", j), g) for j, g in enumerate(on_good)]
        moved = max(abs(x - y) for x, y in zip(on_good + on_bad, model.on_good + model.on_bad))
        model = Model(min((row["b"] + 1) / (row["g"] + row["b"] + 5), 0.5), on_good, on_bad)
        if moved < tolerance:
            break
    return model


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``_q`` (base counts), ``_votes``, ``_p_good`` and ``_kept``.

    Every row is judged: null and empty text fails the base rule, repeated rows get the same answer, an empty
    table gives none. The features are stored once; the estimation reads vote patterns only.
    """
    named = rules()
    votes = [f"_v{j}" for j in range(len(named))]
    marked = features(docs, text_col)
    marked = stored(marked.withColumn("_votes", F.struct(*[c.alias(v) for v, c in zip(votes, named.values())])), "quality")
    # texts that fail the base rule are rejected anyway and teach nothing
    seen = marked.where(~base_failed(F.col("_q"))).select("_votes.*").groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))
    model = fit(stored(seen.coalesce(1), "votes"), votes)
    out = marked.select("*", *[F.col(f"_votes.{v}").alias(v) for v in votes]).withColumn("_p_good", posterior(votes, model)).drop(*votes)
    return out.withColumn("_kept", ~base_failed(F.col("_q")) & (F.col("_p_good") >= threshold))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, base counts, base_failed, p_good, kept) per row."""
    out = judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", threshold)
    return out.select("doc_id", *[F.col(f"_q.{c}") for c in BASE], base_failed(F.col("_q")).alias("base_failed"), F.round("_p_good", 9).alias("p_good"), F.col("_kept").alias("kept"))
