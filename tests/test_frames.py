"""Distributed building blocks against plain Python on random data, with one hot key."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import expr as ex
from tickerloom.functions import frames as fr


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(900):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(6)}"
        value = rnd.choice([rnd.gauss(0, 1), 0.25, 1000.0 * rnd.random()])
        out.append((key, rnd.randrange(12), i, value, rnd.uniform(-0.1, 0.12)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, day int, id int, value double, r double").repartition(5)


def by_key(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def test_exact_median_equals_statistics(frame, rows):
    got = {r.key: r.m for r in fr.exact_median(frame, ["key"], "value", "m", accuracy=16).collect()}
    want = {k: statistics.median(x[3] for x in g) for k, g in by_key(rows).items()}
    assert got == pytest.approx(want)


def test_exact_median_of_equal_values(spark):
    df = spark.createDataFrame([("a", 2.0)] * 4 + [("b", 1.0), ("b", 3.0)], "key string, value double")
    got = {r.key: r.m for r in fr.exact_median(df, ["key"], "value", "m").collect()}
    assert got == {"a": 2.0, "b": 2.0}


def test_sequence_in_groups_equals_full_sort(frame, rows):
    got = {r.id: (r.seq, r.total) for r in fr.sequence_in_groups(frame, ["key"], "day", ["id"]).collect()}
    want = {}
    for g in by_key(rows).values():
        for i, r in enumerate(sorted(g, key=lambda x: (x[1], x[2])), 1):
            want[r[2]] = (i, len(g))
    assert got == want


def test_equity_path_equals_loop(frame, rows):
    got = {r.id: (r.equity, r.peak) for r in fr.equity_path(frame, ["key"], "day", ["id"], "r").collect()}
    for g in by_key(rows).values():
        equity, peak = 1.0, 0.0
        for r in sorted(g, key=lambda x: (x[1], x[2])):
            equity *= 1 + r[4]
            peak = max(peak, equity)
            assert got[r[2]] == pytest.approx((equity, peak))


@pytest.mark.parametrize("n,total", [(5, 23), (5, 3), (10, 100), (4, 5)])
def test_ntile_from_rank(spark, n, total):
    from pyspark.sql import Window as W

    df = spark.range(1, total + 1).withColumn("want", F.ntile(n).over(W.orderBy("id")))
    df = df.withColumn("got", ex.ntile_from_rank(F.col("id"), F.lit(total), n))
    assert df.where("want <> got OR got IS NULL").count() == 0


def test_latest_by_and_null_strict_helpers(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, 3.0)], "key string, v int, x double")
    got = {r.key: r.v for r in fr.latest_by(df, ["key"], [F.desc("v")]).collect()}
    assert got == {"a": 2, "b": 1}
    row = spark.range(1).select(
        ex.strict_greatest(F.lit(1.0), F.lit(None).cast("double")).alias("g"),
        ex.safe_div(F.lit(1), F.lit(0)).alias("d"),
        ex.finite(F.lit(float("inf"))).alias("f"),
        ex.normalise_flags(F.array(F.lit(" B"), F.lit("A"), F.lit(""), F.lit("A"))).alias("flags"),
        ex.merge_flags(F.array(F.lit("X")), F.array(F.lit("A"), F.lit(None), F.lit("X"))).alias("merged"),
    ).first()
    assert (row.g, row.d, row.f, row.flags, row.merged) == (None, None, None, ["A", "B"], ["X", "A"])


def test_add_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    wide = fr.add_missing_columns(df, spark.createDataFrame([(1, "x")], "a int, b string").schema)
    assert wide.columns == ["a", "b"] and wide.first().b is None
    with pytest.raises(ValueError):
        fr.require_columns(df, ["a", "z"])
