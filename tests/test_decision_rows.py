"""Research rows with their champion: derived once, from the days and bars they need."""

import datetime as dt

import __spark_entry__  # noqa: F401
from tickerloom.operators import dataset as ds
from tickerloom.plans import catalog, table_queries
from tickerloom.plans import learning_queries as lq
from tickerloom.plans.signal_queries import trades_of
from tickerloom.plans.tables import Tables, stored

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def test_splits_are_known_before_outcomes_are_resolved(spark):
    rows = [(s, DAY + dt.timedelta(i), 9.0 + i % 5, 10.0 + i % 7, 8.0 + i % 3, 9.0 + i % 6, 5.0, [i]) for s in "AB" for i in range(120)]
    candles = spark.createDataFrame(
        rows, "ticker string, session_date date, open double, high double, low double, close double, volume double, own array<int>"
    )
    plain = ds.training_dataset(candles).orderBy("ticker", "reference_date").collect()
    kept = ds.training_dataset(candles.repartition("ticker"), keep=["own"], clean=True)
    assert [r.asDict() for r in kept.drop("own").orderBy("ticker", "reference_date").collect()] == [r.asDict() for r in plain]
    assert all((r.reference_date - DAY).days == r.own[0] for r in kept.select("reference_date", "own").collect())
    plan = kept.where("dataset_split = 'test'")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, line in enumerate(plan) if "Join Inner" in line) > 10  # all steps of the outcomes stand above it
    physical = kept._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert physical.count("Exchange hashpartitioning(ticker") == 1


def test_research_rows_have_the_champion_of_all_trades(spark):
    t = Tables(spark, SF)
    cols = ["ticker", "reference_date", "dataset_split", "label_class", *lq.CHAMPION]
    want = ds.attach_champion(lq.dataset_of(t).where(lq.RESEARCH), trades_of(t), "champion").select(*cols)
    got = lq.research_rows(t)
    assert got.where("champion_trade_active").count() > 0
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.collect()))
    one = t.indexed_bars.selectExpr("ticker", "session_date AS reference_date", "array(struct(tk, idx)) AS want")
    assert got.join(one, ["ticker", "reference_date"]).where("bars = want").count() == got.count()


def test_daily_rows_are_derived_from_the_line_items_once(spark):
    t = Tables(spark, SF)
    assert stored(t) is stored(t)
    plan = stored(t).daily._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan
    assert stored(t).daily.columns == t.daily.columns and stored(t).daily.exceptAll(t.daily).isEmpty()
    assert "l_suppkey" not in lq.budgeted(t)._jdf.queryExecution().optimizedPlan().toString()


def test_daily_evaluation_reads_stored_daily_rows(spark):
    plan = catalog.QUERIES["daily_evaluation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan


def test_kline_batches_read_stored_klines(spark, monkeypatch):
    plans, real = [], table_queries.sq.upsert_klines

    def watched(path, now, **stamps):
        handle = real(path, now, **stamps)

        def both(batch, no):
            plans.append(batch._jdf.queryExecution().optimizedPlan().toString())
            handle(batch, no)

        return both

    monkeypatch.setattr(table_queries.sq, "upsert_klines", watched)
    table_queries._kline_batches(Tables(spark, SF))
    assert len(plans) == 3 and not any("l_suppkey" in p for p in plans)
