"""Queries over parsers, sinks, streaming and the classifier."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import learning
from ..operators.dataset import fit_scaler
from ..operators.indicators import FEATURES, eod_feature_table
from ..sources import io, parsers
from ..streaming import quotes as sq
from .learning_queries import clean_bars, dataset_of
from .registry import cte, query
from .shared import shared
from .signal_queries import baseline_of
from .tables import Tables


@shared
def daily_lines(t: Tables):
    """Fixed-width daily price lines written from the bars, with header and trailer lines."""

    def digits(c, n: int):
        return F.lpad(F.round(c).cast("long").cast("string"), n, "0")

    factor = F.when(F.dayofmonth("session_date") % 10 == 0, 10).otherwise(1)
    price = [digits(F.col(c) * 100 * factor, 13) for c in ("open", "high", "low")]
    line = F.concat(
        F.lit("01"), F.date_format("session_date", "yyyyMMdd"), F.lit("02"), F.rpad(F.lower("ticker"), 12, " "),
        F.rpad(F.lit("010NAME"), 32, " "), *price, F.rpad(F.lit(""), 13, "0"),
        digits(F.col("close") * 100 * factor, 13), F.rpad(F.lit(""), 26, "0"), digits(F.col("trades"), 5),
        digits(F.col("volume"), 18), digits(F.col("financial_volume") * 100, 18), F.rpad(F.lit(""), 22, "0"),
        digits(factor, 7), F.lit("TAIL"),
    )
    kinds = F.array(line, F.concat(F.lit("99"), F.substring(line, 3, 300)))
    other = F.array(F.concat(F.lit("0120240101"), F.repeat(F.lit(" "), F.lit(210))))
    bars = t.bars.withColumn("value", F.explode(F.when(F.col("trades") % 5 == 0, F.concat(kinds, other)).otherwise(F.array(line))))
    return bars.select("value")


@query(
    "parse_cotahist",
    "ticker session_date open:d high:d low:d close:d trades:n volume:d financial_volume:d quotation_factor:n flags:a",
    """SELECT *, CASE WHEN day(session_date) % 10 = 0 THEN 10 ELSE 1 END AS quotation_factor,
              CASE WHEN high = low THEN ['NO_RANGE'] ELSE [] END AS flags
       FROM bars WHERE ticker IN (SELECT ticker FROM tickers WHERE active)""",
    "bars tickers",
)
def _cotahist(t: Tables):
    return parsers.parse_daily_lines(daily_lines(t), t.tickers.where("active"))


@shared
def klines(t: Tables):
    """Kline arrays written from the bars: four pairs, some broken, some still open."""
    ms = F.unix_millis(F.col("session_date").cast("timestamp_ntz").cast("timestamp"))
    symbol = F.concat("ticker", F.element_at(F.array(*[F.lit(s) for s in ("USDT", "FDUSD", "BRL", "XYZ")]), (F.col("trades") % 4 + 1).cast("int")))
    text = [ms.cast("string")] + [F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in ("open", "high", "low", "close")]
    text += [F.concat(F.lit('"'), (F.col("volume") * F.when(F.col("trades") % 6 == 0, -1).otherwise(1)).cast("string"), F.lit('"')),
             (ms + 86399999).cast("string"), F.lit('"1.5"'), F.col("trades").cast("string"), F.lit('"0.5"')]
    tail = F.when(F.col("trades") % 7 == 0, F.lit("")).otherwise(F.lit(',"0.25"'))
    return t.bars.select(symbol.alias("symbol"), F.concat(F.lit("["), F.concat_ws(",", *text), tail, F.lit("]")).alias("kline"))


cte(
    "kline_rows",
    """SELECT *, (['USDT', 'FDUSD', 'BRL', 'XYZ'])[1 + trades % 4] AS quote_asset,
              trades % 7 <> 0 AND trades % 4 <> 3 AS whole FROM bars""",
    "bars",
)


@query(
    "normalize_klines",
    "symbol base_asset quote_asset day open:d high:d low:d close:d base_volume:d trade_count:n flags:a",
    """SELECT ticker || quote_asset AS symbol, ticker AS base_asset, quote_asset, session_date AS day, open, high, low,
              close, volume * CASE WHEN trades % 6 = 0 THEN -1 ELSE 1 END AS base_volume, trades AS trade_count,
              CASE WHEN trades % 6 = 0 THEN ['NEGATIVE_VOLUME'] ELSE [] END AS flags
       FROM kline_rows WHERE whole AND session_date < DATE '2024-11-01'""",
    "kline_rows",
)
def _klines(t: Tables):
    good, _ = parsers.normalize_klines(klines(t), dt.datetime(2024, 11, 1))
    return good.withColumn("day", F.to_date("event_time"))


@query(
    "kline_rejects",
    "symbol rows:n",
    "SELECT ticker || quote_asset AS symbol, count(*) AS rows FROM kline_rows WHERE NOT whole GROUP BY 1",
    "kline_rows",
)
def _kline_rejects(t: Tables):
    _, bad = parsers.normalize_klines(klines(t), dt.datetime(2024, 11, 1))
    return bad.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "extract_page_price",
    "page_id:n unresolved:b price:d",
    """SELECT page_id, page_id % 6 = 5 AS unresolved,
              CASE WHEN page_id % 6 < 4 THEN (100000 + page_id * 37 % 90000) / 100.0 END AS price FROM pages""",
)
def _page_price(t: Tables):
    """Whole pages with a price in one of the known places, or a page of an unknown ticker."""
    k = F.col("page_id")
    price = (100000 + k * 37 % 90000) / 100
    comma = F.format_number(price, 2)  # 1,234.50
    lone = F.replace(F.format_string("%.2f", price), F.lit("."), F.lit(","))
    place = F.element_at(
        F.array(
            F.concat(F.lit('<div data-last-price="'), lone, F.lit('">x</div>')),
            F.concat(F.lit('{"price": { "raw" : '), F.format_string("%.2f", price), F.lit("}}")),
            F.concat(F.lit('<div jsname="ip75Cb" class="a"><span class="b YMlKec c">R$ '), comma, F.lit("</span></div>")),
            F.concat(F.lit('<div class="YMlKec">&nbsp;</div><div class="YMlKec fxKbKc"><b>R$&nbsp;'), comma, F.lit("</b></div>")),
            F.lit("<div>no price</div>"),
            F.concat(F.lit('<div data-last-price="1.0"></div>')),
        ),
        (k % 6 + 1).cast("int"),
    )
    head = F.when(k % 6 == 5, F.concat(F.lit("<title>t"), k.cast("string"), F.lit(" - Google Finance</title>"))).otherwise("")
    pages = t.read("pages").select(
        "page_id", F.concat(F.lit("T"), k.cast("string")).alias("ticker"), F.concat(head, "html", place).alias("html")
    )
    return parsers.extract_page_price(pages)


@query(
    "rpc_price",
    "page_id:n price:d",
    "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN page_id / 8.0 + 1 END AS price FROM pages",
)
def _rpc(t: Tables):
    k = F.col("page_id")
    blob = F.concat(F.lit('[[["a","b","c",[0,1,2,3,4,['), (k / 8 + 1).cast("string"), F.lit(",2]]]]]"))
    rpc = F.when(k % 4 != 0, "mKsvE").otherwise("other")
    line = F.concat(F.lit('[["wrb.fr","'), rpc, F.lit('","'), F.replace(blob, F.lit('"'), F.lit('\\"')), F.lit('"]]'))
    payload = F.concat_ws("\n", F.lit(")]}'"), F.lit("12"), line, F.lit("x"))
    return t.read("pages").select("page_id", parsers.rpc_price(payload, "mKsvE").alias("price"))


@query(
    "quote_rows",
    "ticker quote_date quote_time price:d captured_at",
    """SELECT ticker, quote_date, substr(quote_time, 1, 5) || ':00' AS quote_time, round(price, 2) AS price,
              date_trunc('minute', captured_at) AS captured_at FROM quotes""",
    "quotes",
)
def _quote_rows(t: Tables):
    return parsers.quote_rows(t.quotes.withColumn("quote_time", F.substring("quote_time", 1, 5)))


@query(
    "latest_occurrence",
    "ticker session_date close:d",
    "SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY updated_at DESC) = 1",
    "daily",
)
def _latest_occurrence(t: Tables):
    return parsers.latest_occurrence(t.daily, ["ticker"], "updated_at")


# ------------------------------------------------------------------ slices and sinks


@query(
    "upsert_daily",
    "ticker session_date close:d financial_volume:d created_at",
    """SELECT coalesce(s.ticker, b.ticker) AS ticker, coalesce(s.session_date, b.session_date) AS session_date,
              coalesce(s.close, b.close) AS close, coalesce(s.financial_volume, b.financial_volume) AS financial_volume,
              CASE WHEN b.ticker IS NOT NULL THEN 'old' ELSE 'new' END AS created_at
       FROM (SELECT * FROM bars WHERE session_date < DATE '2024-10-01') AS b
       FULL JOIN (SELECT * FROM dedup WHERE session_date >= DATE '2024-09-02') AS s
            ON s.ticker = b.ticker AND s.session_date = b.session_date""",
    "bars dedup",
)
def _upsert(t: Tables):
    cols = ["ticker", "session_date", "close", "financial_volume"]
    target = t.bars.where("session_date < DATE '2024-10-01'").select(*cols, F.lit("old").alias("created_at"))
    source = t.daily.where("session_date >= DATE '2024-09-02'").withColumn("created_at", F.lit("new"))
    merged = io.upsert(target, source.select(*cols, "created_at", "updated_at"), ["ticker", "session_date"],
                       [F.desc("updated_at")], ["created_at"])
    return merged


@query(
    "seed_config",
    "strategy_id status created_at updated_at",
    """SELECT strategy_id, CASE WHEN strategy_id LIKE '%gap%' THEN 'pausada' ELSE 'em_teste' END AS status,
              CASE WHEN n > 200 OR strategy_id NOT LIKE '%gap%' THEN 'first' ELSE 'second' END AS created_at,
              CASE WHEN strategy_id LIKE '%gap%' THEN 'second' ELSE 'first' END AS updated_at
       FROM (SELECT strategy_id, count(*) AS n FROM bsignals GROUP BY 1)
       WHERE n > 200 OR strategy_id LIKE '%gap%'""",
    "bsignals",
)
def _seed(t: Tables):
    """Configuration rows seeded twice: an update keeps the first creation time."""
    found = baseline_of(t).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n"))

    def seeded(df, status: str, stamp: str):
        return df.select("strategy_id", F.lit(status).alias("status"), F.lit(stamp).alias("created_at"), F.lit(stamp).alias("updated_at"))

    first = seeded(found.where("n > 200"), "em_teste", "first")
    second = seeded(found.where(F.contains("strategy_id", F.lit("gap"))), "pausada", "second")
    return io.upsert(first, second, ["strategy_id"], keep_from_target=["created_at"])


@query(
    "replace_slice",
    "session_date rows:n volume:d",
    """SELECT session_date, count(*) AS rows, sum(CASE WHEN session_date >= DATE '2024-11-01' THEN 1 ELSE volume END) AS volume
       FROM bars GROUP BY 1""",
    "bars",
)
def _replace(t: Tables):
    new = t.bars.where("session_date >= DATE '2024-11-01'").withColumn("volume", F.lit(1.0))
    out = io.replace_slice(t.bars, new, F.col("session_date") >= F.lit(dt.date(2024, 11, 1)))
    return out.groupBy("session_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


@query(
    "json_safe",
    "ticker session_date ratio:d trades:n",
    "SELECT ticker, session_date, CASE WHEN volume <> 25 THEN close / (volume - 25) END AS ratio, trades FROM bars",
    "bars",
)
def _json_safe(t: Tables):
    zero = F.col("volume") == 25
    ratio = F.when(zero & (F.col("trades") == 1), float("nan")).when(zero, float("inf"))
    rows = t.bars.select("ticker", "session_date", F.coalesce(ratio, F.try_divide("close", F.col("volume") - 25)).alias("ratio"),
                         F.col("trades").cast("double").alias("trades"))
    return io.json_safe(rows, ["trades"])


@query(
    "active_universe",
    "ticker is_benchmark:b",
    """SELECT * FROM (SELECT ticker, FALSE AS is_benchmark FROM tickers WHERE active ORDER BY ticker LIMIT 48)
       UNION ALL SELECT * FROM (VALUES ('IBOV', TRUE), ('SMLL', TRUE))""",
    "tickers",
)
def _active_universe(t: Tables):
    return io.active_universe(t.tickers, [" ibov", "SMLL", "IBOV"], 50)


@query(
    "active_universe_all",
    "ticker is_benchmark:b",
    "SELECT ticker, FALSE AS is_benchmark FROM tickers WHERE active UNION ALL SELECT * FROM (VALUES ('IBOV', TRUE), ('SMLL', TRUE))",
    "tickers",
)
def _active_universe_all(t: Tables):
    return io.active_universe(t.tickers, [" ibov", "SMLL", "IBOV"])


@shared
def snapshots(t: Tables):
    """Three snapshots of one dataset; the newest lacks test rows."""
    rows = dataset_of(t).select("ticker", "reference_date", "dataset_split")
    n = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    rows = rows.withColumn("n", n).where("NOT (n = 3 AND dataset_split = 'test') AND NOT (n = 2 AND ticker < 'S00003')")
    return rows.withColumns({"dataset_snapshot": F.concat(F.lit("snap"), F.col("n").cast("string")), "created_at": F.col("n")})


@query(
    "latest_snapshot",
    "ticker reference_date dataset_split",
    "SELECT * FROM dataset WHERE dataset_split IN ('train', 'validation')",
    "dataset",
)
def _snapshot(t: Tables):
    return io.latest_snapshot(snapshots(t))


@query(
    "latest_complete_snapshot",
    "dataset_snapshot rows_count:n max_reference_date",
    "SELECT 'snap1' AS dataset_snapshot, count(*) AS rows_count, max(reference_date) AS max_reference_date FROM dataset",
    "dataset",
)
def _complete(t: Tables):
    return io.latest_complete_snapshot(snapshots(t))


# ------------------------------------------------------------------ streaming

# one quote for each ticker and time: the newest
cte("newest_ticks", "SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY seq DESC) = 1", "ticks")
cte(
    "newest_candles",
    """SELECT ticker, time_bucket(INTERVAL 15 MINUTE, ts) AS candle_at, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
              arg_max(price, ts) AS close, count(*) AS samples,
              CASE WHEN count(*) = 1 THEN ['NO_VOLUME_SOURCE', 'SINGLE_QUOTE_BUCKET'] ELSE ['NO_VOLUME_SOURCE'] END AS flags
       FROM newest_ticks GROUP BY ALL""",
    "newest_ticks",
)


def _stream(t: Tables):
    """The quote table as a stream of files."""
    events = t.read("events")
    raw = t.spark.readStream.schema(events.schema).parquet(f"{t.sf_dir}/events*.parquet")  # a pattern: the source lists files
    streamed = Tables(t.spark, t.sf_dir)
    streamed.read = lambda name: raw  # same derivation, streaming source
    return streamed.quotes


def _run(t: Tables, plan, name: str):
    """Everything there is, then a heartbeat after the last quote, which closes the open buckets."""
    run = f"{io.checkpoint_dir(t.spark)}/{name}-{dt.datetime.now():%Y%m%d%H%M%S%f}"
    df = plan(sq.stream_quotes(_stream(t), beats=sq.clock(t.spark, f"{run}/clock")))
    sq.run_to_table(df, f"{run}/out", f"{run}/state")
    last = t.quotes.agg(F.max("captured_at")).first()[0]
    if last is not None:
        sq.heartbeat(t.spark, f"{run}/clock", last.replace(tzinfo=dt.timezone.utc) + dt.timedelta(days=1))
        sq.run_to_table(df, f"{run}/out", f"{run}/state")
    return t.spark.read.schema(df.schema).parquet(f"{run}/out")


@query(
    "stream_candles_15m",
    "ticker candle_at open:d high:d low:d close:d samples:n flags:a",
    "SELECT * FROM newest_candles",
    "newest_candles",
)
def _stream_candles(t: Tables):
    return _run(t, lambda ticks: sq.finish_candles(sq.stream_candles(ticks)), "candles")


@query(
    "stream_rollup_1h",
    "ticker candle_at open:d high:d low:d close:d",
    """SELECT ticker, date_trunc('hour', c.candle_at) AS candle_at, arg_min(open, c.candle_at) AS open, max(high) AS high, min(low) AS low,
              arg_max(close, c.candle_at) AS close FROM newest_candles AS c GROUP BY ticker, date_trunc('hour', c.candle_at)""",
    "newest_candles",
)
def _stream_rollup(t: Tables):
    return _run(t, lambda ticks: sq.finish_candles(sq.stream_rollup(sq.stream_candles(ticks))), "rollup")


# ------------------------------------------------------------------ classifier


FIT = ["return_1d", "volatility_20d", "volume_ratio_20d", "distance_sma_20d_pct"]
STEPS, RATE = 3, 0.5
_net = lambda x, m: "[" + ", ".join(f"{m}[{c}][5] + " + " + ".join(f"{m}[{c}][{i}] * {x}[{i}]" for i in range(1, 5)) + "" for c in (1, 2, 3)) + "]"
_soft = "list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z)))))"
cte(
    "fit_scale",
    "SELECT " + ", ".join(f"avg({f}::DOUBLE) AS m_{f}, coalesce(nullif(stddev_samp({f}::DOUBLE), 0), 1) AS s_{f}" for f in FIT) + " FROM dataset WHERE dataset_split = 'train' AND label_class IS NOT NULL",
    "dataset",
)
cte(
    "fit_rows",
    "SELECT ticker, reference_date, dataset_split, label_class, [" + ", ".join(f"coalesce((coalesce({f}::DOUBLE, m_{f}) - m_{f}) / s_{f}, 0)" for f in FIT) + ", 1.0::DOUBLE] AS x FROM dataset, fit_scale",
    "dataset fit_scale",
)
cte(
    "fit_weights",
    """SELECT label_class, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE * CASE WHEN label_class = 'neutral' THEN 1 ELSE 1.25 END AS weight, n
       FROM (SELECT label_class, count(*) AS n FROM dataset WHERE dataset_split = 'train' AND label_class IS NOT NULL GROUP BY 1)""",
    "dataset",
)
cte("fit_0", "SELECT list_transform(range(3), lambda c: [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0]) AS m", "fit_rows")
for _n in range(1, STEPS + 1):
    _cell = "m[{c}][{i}] - " + str(RATE) + "::DOUBLE * sum(weight * ((" + _soft + ")[{c}] - CASE WHEN label_class = ['down', 'neutral', 'up'][{c}] THEN 1 ELSE 0 END) * x[{i}]) / sum(weight)"
    cte(
        f"fit_{_n}",
        "SELECT [" + ", ".join("[" + ", ".join("any_value(" + _cell.format(c=c, i=i).split(" - ", 1)[0] + ") - " + _cell.format(c=c, i=i).split(" - ", 1)[1] for i in range(1, 6)) + "]" for c in (1, 2, 3)) + "] AS m"
        + f" FROM (SELECT label_class, weight, x, m, {_net('x', 'm')} AS z FROM fit_rows JOIN fit_weights USING (label_class), fit_{_n - 1} WHERE dataset_split = 'train')",
        f"fit_rows fit_weights fit_{_n - 1}",
    )


@query("class_weights", "label_class weight:d", "SELECT * FROM fit_weights", "fit_weights")
def _class_weights(t: Tables):
    return learning.class_weights(dataset_of(t).where("dataset_split = 'train'"))


@query(
    "train_classifier",
    "dataset_split suggested_action rows:n mean_confidence:d",
    f"""SELECT dataset_split, suggested_action, count(*) AS rows, avg(confidence) AS mean_confidence
        FROM (SELECT dataset_split, CASE WHEN p[3] >= 0.35 AND p[3] >= p[1] THEN 'BUY' WHEN p[1] >= 0.35 AND p[1] > p[3] THEN 'SELL' ELSE 'HOLD' END AS suggested_action,
                     greatest(p[1], p[3]) AS confidence
              FROM (SELECT dataset_split, {_soft} AS p FROM (SELECT dataset_split, {_net('x', 'm')} AS z FROM fit_rows, fit_{STEPS}))) GROUP BY ALL""",
    f"fit_rows fit_{STEPS}",
)
def _classifier(t: Tables):
    """Three steps of the class-weighted softmax regression; the network with a hidden layer is held by tests."""
    data = io.cut(dataset_of(t), "dataset")
    network, scaler = learning.train_classifier(data, FIT, hidden=(), steps=STEPS, rate=RATE, momentum=0.0)
    scored = learning.score_predictions(network, scaler, data, learning.ModelCard("eod", "v1", threshold=0.35))
    return scored.groupBy("dataset_split", "suggested_action").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("mean_confidence")
    )


FIXED = [[((7 * j + 3 * c) % 11 - 5) / 10 for j in range(len(FEATURES))] + [(c - 1) / 20] for c in range(3)]
CARD = learning.ModelCard("eod_linear", "fixed_v1", threshold=0.5, run_id="run-7", created_at=dt.datetime(2024, 12, 20, tzinfo=dt.timezone.utc))
_z = ", ".join(" + ".join([f"{row[-1]}::DOUBLE", *[f"{w}::DOUBLE * z_{f}" for w, f in zip(row, FEATURES)]]) + f" AS z{c}" for c, row in enumerate(FIXED))
_snap = "sha256(concat_ws('|', ticker, reference_date::VARCHAR, " + ", ".join(f"coalesce(floor({f}::DOUBLE * 1e6 + 0.5)::BIGINT::VARCHAR, '')" for f in FEATURES) + "))"


@query(
    "score_predictions",
    """ticker reference_date valid_for model_id model_version feature_version label_version inference_config_version prob_up:d prob_down:d prob_neutral:d
       suggested_action confidence:d decision_threshold:d close:d financial_volume:d feature_snapshot source_snapshot job_run_id created_at metadata_json""",
    f"""
    WITH scale AS (SELECT {", ".join(f"avg({f}::DOUBLE) AS m_{f}, coalesce(nullif(stddev_samp({f}::DOUBLE), 0), 1) AS s_{f}" for f in FEATURES)} FROM dataset WHERE dataset_split = 'train'),
        scaled AS (SELECT dataset.*, {_snap} AS feature_snapshot, {", ".join(f"(coalesce({f}::DOUBLE, m_{f}) - m_{f}) / s_{f} AS z_{f}" for f in FEATURES)} FROM dataset, scale),
        logits AS (SELECT *, {_z} FROM scaled),
        powers AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM logits),
        probs AS (SELECT *, e0 / (e0 + e1 + e2) AS prob_down, e1 / (e0 + e1 + e2) AS prob_neutral, e2 / (e0 + e1 + e2) AS prob_up FROM powers),
        days AS (SELECT reference_date, sha256(concat_ws('|', count(*), sum(('0x' || feature_snapshot[1:15])::BIGINT), sum(('0x' || feature_snapshot[16:30])::BIGINT))) AS source_snapshot
            FROM scaled GROUP BY 1)
    SELECT ticker, reference_date, valid_for, 'eod_linear' AS model_id, 'fixed_v1' AS model_version, 'feature_eod_tabular_v3' AS feature_version,
           'label_eod_barrier_v2' AS label_version, 'inference_v1' AS inference_config_version, prob_up, prob_down, prob_neutral,
           CASE WHEN prob_up >= 0.5 AND prob_up >= prob_down THEN 'BUY' WHEN prob_down >= 0.5 AND prob_down > prob_up THEN 'SELL' ELSE 'HOLD' END AS suggested_action,
           greatest(prob_up, prob_down) AS confidence, 0.5 AS decision_threshold, close, financial_volume, feature_snapshot, source_snapshot,
           'run-7' AS job_run_id, TIMESTAMP '2024-12-20 00:00:00' AS created_at,
           '{{"flags":{{"has_missing_ohlcv":' || has_missing_ohlcv || ',"has_zero_volume":' || has_zero_volume || ',"is_suspicious_candle":' || is_suspicious_candle
             || '}},"history_days":' || history_days || '}}' AS metadata_json
    FROM probs JOIN days USING (reference_date)""",
    "dataset",
)
def _score(t: Tables):
    data = dataset_of(t)
    scaler = fit_scaler(data.where("dataset_split = 'train'"))
    return learning.score_predictions(learning.Network.of(FEATURES, [FIXED]), scaler, data, CARD)


@query(
    "inference_features",
    "ticker reference_date close:d return_1d:d volatility_20d:d",
    """SELECT * FROM model_features WHERE reference_date = (SELECT max(session_date) FROM dedup)""",
    "model_features dedup",
)
def _inference(t: Tables):
    bars = clean_bars(t)
    newest = bars.agg(F.max("session_date").alias("reference_date"))
    return eod_feature_table(bars).join(F.broadcast(newest), "reference_date", "left_semi")
