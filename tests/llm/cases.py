"""Small tables with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, kept string, row int, length int, `key` string"


def prose(rng, n, vocabulary=400):
    out = []
    for i in range(n):
        w = rng.choice(["of", "the", "in", "to", "a"]) if rng.random() < 0.4 else "".join(rng.choice(["ka", "lo", "mi", "ter", "un"]) for _ in range(rng.randint(1, 3))) + str(rng.randint(0, vocabulary))
        out.append(w + ("." if i % 12 == 11 else ""))
    return " ".join(out)


def texts(seed=1):
    """(doc_id, text): prose, exact and near copies, shared passages, periods, nulls, blanks, a long text."""
    rng = random.Random(seed)
    passage, other = prose(rng, 60), prose(rng, 45)
    base = [prose(rng, rng.randint(30, 160)) for _ in range(14)]
    rows = [*base, base[0], base[0], base[3] + " tail", "x" + base[3]]
    rows += [base[i] + " " + passage + " " + base[i + 1][:80] for i in range(4, 9)]
    rows += [other + " " + passage, passage, other, None, "", " \t\n", "one", "é" * 150 + " " + "é" * 150, "ab" * 400, "z " * 300]
    rows += ["Line of a page that says the same.\n" * 9, prose(rng, 30).upper().replace(" ", "!! ") + "!!", " ".join(w + "###" for w in prose(rng, 80).split())]
    rows += [base[5] + "\n" + base[6] + "\n" + base[5], prose(rng, 6000)]
    return [(3 * i + (i % 2), t) for i, t in enumerate(rows)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    lang = lambda d: None if d % 11 == 0 else ("en", "de", "fr")[d % 3]
    source = lambda d: None if d % 13 == 5 else "src0" if d % 3 else f"src{d % 7}"
    full = [(d, t, lang(d or 0), source(d or 0), len(t) if t is not None else None, 1, "x", 2, 3, "k") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def table(spark, folder, name, df):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
