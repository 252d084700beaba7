"""Parsers for exchange text files, kline arrays and quote pages, as column expressions."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import flag_list
from ..functions.frames import latest_by

# ------------------------------------------------------------------ daily price file (fixed width)

# fixed values: 0-based start and end of each field in a daily price record
FIELDS = {
    "trade_date": (2, 10),
    "ticker": (12, 24),
    "open": (56, 69),
    "high": (69, 82),
    "low": (82, 95),
    "close": (108, 121),
    "trades": (147, 152),
    "quantity": (152, 170),
    "turnover": (170, 188),
    "factor": (210, 217),
}


def read_daily_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or many latin-1 daily price files, read in parallel."""
    return spark.read.option("encoding", "ISO-8859-1").text(path)


def unzip_lines(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """Lines of the expected (else first) text member of each zip archive.

    Archives are unpacked inside the tasks, one archive at a time. ``missing_file`` names
    an expected member that was absent; an archive without text gives one row without value.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with zipfile.ZipFile(io.BytesIO(row.content)) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(".txt")]
                    missing = expected if expected and expected not in names else None
                    if not names:
                        yield pd.DataFrame({"path": [row.path], "value": [None], "missing_file": [missing]})
                        continue
                    name = expected if expected in names else names[0]
                    with archive.open(name) as handle:
                        text = io.TextIOWrapper(handle, encoding="latin1")
                        while block := text.readlines(1 << 22):
                            lines = [line.rstrip("\r\n") for line in block]
                            yield pd.DataFrame({"path": row.path, "value": lines, "missing_file": missing})

    return files.mapInPandas(unpack, "path string, value string, missing_file string")


def parse_daily_lines(lines: DataFrame, tickers: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Daily candles out of fixed-width lines; a bad number leaves its field NULL.

    Prices are cents divided by the quotation factor. ``tickers`` is a short list or a
    frame with a ``ticker`` column (joined as a semi join).
    """

    def field(name: str) -> Column:
        start, end = FIELDS[name]
        return F.trim(F.substring("value", start + 1, end - start))

    def whole(name: str) -> Column:
        text = field(name)
        return F.when(text == "", F.lit(0).cast("long")).otherwise(text.try_cast("long"))

    factor = F.greatest(whole("factor"), F.lit(1))
    rows = lines.where(F.startswith("value", F.lit("01"))).withColumn("ticker", F.upper(field("ticker")))
    rows = rows.where("ticker <> ''")
    if isinstance(tickers, DataFrame):
        allowed = tickers.select(F.upper(F.trim("ticker")).alias("ticker"))
        rows = rows.join(allowed, "ticker", "left_semi")
    elif tickers:
        rows = rows.where(F.col("ticker").isin([t.strip().upper() for t in tickers if t.strip()]))
    out = rows.withColumns(
        {"session_date": F.try_to_date(field("trade_date"), "yyyyMMdd"), "quotation_factor": factor}
        | {c: whole(c) / 100 / factor for c in ("open", "high", "low", "close")}
        | {
            "trades": whole("trades"),
            "volume": whole("quantity").cast("double"),
            "financial_volume": whole("turnover") / 100,
        }
    )
    flags = flag_list(
        [
            ("ZERO_VOLUME", F.col("volume") == 0),
            ("ZERO_TRADES", F.col("trades") == 0),
            ("NO_RANGE", F.col("high") == F.col("low")),
        ]
    )
    return out.withColumns({"flags": flags, "timeframe": F.lit("1D")}).drop("value")


def latest_occurrence(candles: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Last row per key by an explicit ordinal."""
    return latest_by(candles, list(keys), [F.desc(ordinal)])


def split_target_date(candles: DataFrame, day: dt.date) -> tuple[DataFrame, DataFrame]:
    """(rows of the day, rows of other days)."""
    same = F.col("session_date") == F.lit(day)
    return candles.where(same), candles.where(~same | F.col("session_date").isNull())


# ------------------------------------------------------------------ klines

# fixed values: quote assets in matching order
QUOTE_ASSETS = ("USDT", "USDC", "FDUSD", "BTC", "ETH", "BRL")


def split_symbol(symbol: Column) -> tuple[Column, Column]:
    """(base, quote) of a pair; NULL when no known quote asset ends it."""
    pattern = f"^(.+)({'|'.join(QUOTE_ASSETS)})$"
    # the greedy base would swallow the F of FDUSD only if USD were listed; assets do not overlap
    hit = symbol.rlike(pattern)
    return F.when(hit, F.regexp_extract(symbol, pattern, 1)), F.when(hit, F.regexp_extract(symbol, pattern, 2))


def normalize_klines(
    raw: DataFrame, now: dt.datetime, exchange: str | None = None, interval: str | None = None, source: str | None = None,
    ingested_at: dt.datetime | None = None, run_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candles, rejects) from ``symbol`` and a JSON array ``kline``; open candles are dropped.

    A row with fewer than 11 fields, an unreadable number or an unknown symbol is rejected. ``exchange``,
    ``interval``, ``source``, ``ingested_at`` and ``job_run_id`` are columns of the candles: those of ``raw`` where
    it has them (their gaps filled), else the given values.
    """
    stamps = {"exchange": exchange, "interval": interval, "source": source, "ingested_at": ingested_at, "job_run_id": run_id}
    stamp = {c: F.lit(v) if c not in raw.columns else F.coalesce(c, F.lit(v)) for c, v in stamps.items() if v is not None}
    base, quote = split_symbol(F.col("symbol"))
    rows = raw.withColumns({"_a": F.from_json("kline", "array<string>"), "base_asset": base, "quote_asset": quote})

    def at(i: int, kind: str) -> Column:
        return F.get("_a", F.lit(i)).try_cast(kind)

    typed = rows.withColumns(
        {
            "event_time": F.timestamp_millis(at(0, "long")),
            "close_time": F.timestamp_millis(at(6, "long")),
            "trade_count": at(8, "long"),
        }
        | {
            c: at(i, "double")
            for c, i in {
                "open": 1, "high": 2, "low": 3, "close": 4, "base_volume": 5, "quote_volume": 7,
                "taker_buy_base_volume": 9, "taker_buy_quote_volume": 10,
            }.items()
        }
    )
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    needed = ["event_time", "close_time", "open", "high", "low", "close", "base_volume", "quote_volume", "trade_count",
              "base_asset"]
    whole = F.coalesce(F.size("_a") >= 11, F.lit(False))
    for n in needed:
        whole = whole & F.col(n).isNotNull()
    flags = flag_list(
        [
            ("NON_POSITIVE_PRICE", F.least(o, h, lo, c) <= 0),
            ("INVALID_OHLC_RANGE", (h < F.greatest(o, lo, c)) | (lo > F.least(o, h, c))),
            ("NEGATIVE_VOLUME", (F.col("base_volume") < 0) | (F.col("quote_volume") < 0)),
            ("NEGATIVE_TRADE_COUNT", F.col("trade_count") < 0),
        ]
    )
    limit = F.lit(now.replace(tzinfo=dt.timezone.utc) if now.tzinfo is None else now)
    good = typed.where(whole & (F.col("close_time") <= limit)).withColumns({"flags": flags} | stamp).drop("_a", "kline")
    return good, typed.where(~whole).select(*raw.columns)


# ------------------------------------------------------------------ quote pages

# fixed values: markup that carries the price, in the order it is trusted
ATTRIBUTE = r"""(?i)data-last-price=(['"])([^'"]+)\1"""
PAYLOAD = r'"price"\s*:\s*\{\s*"raw"\s*:\s*(-?[0-9.,]+)'
CONTAINER_NAME, PRICE_CLASS = "ip75Cb", "YMlKec"
PRICE_DIV = r"""(?s)<div[^>]*class=(['"])(?=[^'"]*\bfxKbKc\b)(?:[^'"]*\s)?YMlKec(?:\s[^'"]*)?\1[^>]*>(.*?)</div>"""
ANY_DIV = r"""(?s)<div[^>]*class=(['"])(?:[^'"]*\s)?YMlKec(?:\s[^'"]*)?\1[^>]*>(.*?)</div>"""


# fixed values: named characters of HTML that occur in prices
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def parse_number(text: Column) -> Column:
    """``R$ 10,50`` -> 10.5: a lone comma is the decimal point, otherwise commas group thousands."""
    kept = F.regexp_replace(text, "[^0-9.,-]", "")
    commas = F.length(kept) - F.length(F.replace(kept, F.lit(",")))
    decimal_comma = (commas == 1) & ~F.contains(kept, F.lit("."))
    plain = F.when(decimal_comma, F.replace(kept, F.lit(","), F.lit("."))).otherwise(F.replace(kept, F.lit(",")))
    return plain.try_cast("double")


def _text(html: Column) -> Column:
    """Visible text: character entities decoded (those of no known character dropped), tags removed."""

    def decoded(text: Column, pattern: str, base: int) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        code = lambda e: F.conv(F.regexp_extract(e, pattern, 1), base, 10).cast("long")
        known = lambda e: code(e).between(1, 0x10FFFF) & ~code(e).between(0xD800, 0xDFFF)
        sign = lambda e: F.when(known(e), F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")).otherwise("")
        return F.aggregate(found, text, lambda t, e: F.replace(t, e, sign(e)))

    text = decoded(decoded(html, "&#([0-9]{1,7});", 10), "&#[xX]([0-9A-Fa-f]{1,6});", 16)
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "&#?[A-Za-z0-9]+;", ""))


def _first_text(parts: Column) -> Column:
    return F.get(F.filter(F.transform(parts, lambda p: _text(p)), lambda p: p != ""), F.lit(0))


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; NULL without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def _attribute(piece: Column) -> Column:
    """Quoted value at the start of ``piece``, which followed an attribute's equals sign; NULL if it is not quoted."""
    value = F.regexp_extract(piece, r"""^["']([^"']*)["']""", 1)
    same = F.substring(piece, 1, 1) == F.substring(piece, F.length(value) + 2, 1)
    return F.when(same & F.substring(piece, 1, 1).isin('"', "'"), value)


def _following(html: Column, attribute: str) -> Column:
    """The pieces of ``html`` that follow each mention of ``attribute=``."""
    pieces = F.split(html, f"{attribute}=", -1)
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def _named_texts(html: Column) -> Column:
    """Of each container with the known name, the text right behind the first tag of the price class."""
    named = F.filter(_following(html, "jsname"), lambda p: F.coalesce(_attribute(p) == CONTAINER_NAME, F.lit(False)) & F.contains(_after(p, ">"), F.lit("</div>")))
    contents = F.transform(named, lambda p: F.substring_index(_after(p, ">"), "</div>", 1))

    def first_price(content: Column) -> Column:
        priced = F.filter(_following(content, "class"), lambda p: F.coalesce(F.array_contains(F.split(_attribute(p), r"\W+"), PRICE_CLASS), F.lit(False)))
        texts = F.transform(priced, lambda p: F.substring_index(_after(p, ">"), "<", 1))
        return F.get(F.filter(texts, lambda x: F.length(x) > 0), F.lit(0))

    return F.transform(contents, lambda c: F.coalesce(first_price(c), F.lit("")))


def page_price(html: Column) -> Column:
    """Price of a quote page: attribute, JSON payload, named container, then price classes."""
    return F.coalesce(
        parse_number(F.regexp_extract(html, ATTRIBUTE, 2)),
        parse_number(F.regexp_extract(html, PAYLOAD, 1)),
        parse_number(_first_text(_named_texts(html))),
        parse_number(_first_text(F.regexp_extract_all(html, F.lit(PRICE_DIV), F.lit(2)))),
        parse_number(_first_text(F.regexp_extract_all(html, F.lit(ANY_DIV), F.lit(2)))),
    )


def extract_page_price(pages: DataFrame) -> DataFrame:
    """Price per page; a page whose title is only the ticker and the site name is unresolved."""
    title = F.upper(F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)))
    plain = F.upper(F.concat(F.col("ticker"), F.lit(" - Google Finance")))
    return pages.withColumn("unresolved", title == plain).withColumn(
        "price", F.when(~F.col("unresolved"), page_price(F.col("html")))
    )


def rpc_price(payload: Column, rpc_id: str) -> Column:
    """Price inside a batched RPC reply: the framed line of ``rpc_id`` holds a JSON text."""
    frames = F.filter(
        F.transform(F.split(payload, "\n"), lambda line: F.trim(line)),
        lambda line: line.startswith('[["wrb.fr"') & (F.get_json_object(line, "$[0][1]") == rpc_id),
    )
    blob = F.get_json_object(F.get(frames, F.lit(0)), "$[0][2]")
    return F.get_json_object(blob, "$[0][0][3][5][0]").try_cast("double")


def quote_rows(quotes: DataFrame) -> DataFrame:
    """Stored form of collected quotes: price with two decimals, full time text, local event time."""
    time = F.when(F.length("quote_time") == 5, F.concat("quote_time", F.lit(":00"))).otherwise(F.col("quote_time"))
    return quotes.withColumns({"price": F.round("price", 2), "quote_time": time}).withColumn(
        "captured_at", F.concat_ws(" ", F.col("quote_date").cast("string"), "quote_time").try_cast("timestamp_ntz")
    )
