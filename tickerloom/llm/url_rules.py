"""URL filters: rules for a host with its subdomains and a path prefix, found by short hashes of expressions.

Each URL is expanded into expressions: a suffix of its host's labels joined to a prefix of its path that ends
at a slash (or is empty). Each rule is one expression, with the rest of its path, if any, beside it. The two
sides meet in an equi-join on the first four bytes of the expressions' SHA-256; full digests, the rest of the
path and precedence decide. Only expressions as deep as some rule are made, which drops none that could fit.

Verdicts depend on host and path alone, so each distinct pair is judged once and joined back.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that may be sent to every task; more are joined by shuffling, with the URLs' side salted.
MOST_SENT = 50_000
SALTS = 16
OUT = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, path up to ``?`` or ``#``; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules (host, path, verdict) of pairs like ``("block", "example.com/en/")``."""
    rows = [(host, slash + path, verdict) for verdict, text in rules for host, slash, path in [text.partition("/")]]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def host_suffixes(host: Column, most: Column | int) -> Column:
    """Suffixes of at most ``most`` labels, the shortest first; no labels are empty by themselves."""
    labels = F.split(host, r"\.", -1)
    depth = F.least(F.size(labels), F.lit(most))
    return F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(labels, -k, k), "."))


def path_prefixes(path: Column, most: Column | int) -> Column:
    """The empty prefix and those that end at the first to the ``most``-th slash."""
    parts = F.split(path, "/", -1)
    depth = F.least(F.size(parts) - 1, F.lit(most))
    cut = lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))).otherwise(F.lit(""))
    return F.transform(F.sequence(F.lit(0), depth), cut)


def _hashed(df: DataFrame) -> DataFrame:
    """Adds the full digest of ``expression`` and its short prefix."""
    return df.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8))


def judge(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow", most_sent: int = MOST_SENT, salts: int = SALTS
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the deciding rule, else null), ``verdict``.

    A rule (``host``, ``path``, ``verdict``) fits its host and all subdomains where the URL's path starts with its
    path, character by character. The longest (host and path together) wins, then the longer host; of equal rules
    with different verdicts the greater word wins, so ``block`` before ``allow``. No rule: ``otherwise``. A null URL
    or one without ``://`` has an empty host and path, which only a rule without both fits. Rules with a null field
    fit nothing. Repeated rows are judged each; columns of ``pages`` named like a result are replaced.
    """
    host, path = host_and_path(F.col(url_col))
    pages = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.withColumns({"stem": F.regexp_extract("path", r"(?s)^(.*/)?", 0), "rule": F.concat("host", "path")})
    known = _hashed(known.withColumn("expression", F.concat("host", "stem")))
    deep = known.agg(
        F.count("*").alias("n"), F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.max(F.size(F.split("stem", "/", -1)) - 1).alias("slashes")
    ).first()
    known = known.select("short", F.col("digest").alias("rule_digest"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "rule", "verdict")

    urls = pages.select("host", "path").distinct()
    made = urls.withColumn("suffix", F.explode(host_suffixes(F.col("host"), deep["labels"] or 1)))
    made = made.withColumn("prefix", F.explode(path_prefixes(F.col("path"), deep["slashes"] or 0)))
    made = _hashed(made.withColumn("expression", F.concat("suffix", "prefix"))).drop("suffix", "prefix", "expression")
    if deep["n"] <= most_sent:
        met = made.join(F.broadcast(known), "short")
    else:  # a rule such as a top-level domain meets a large part of all URLs
        made = made.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)))
        met = made.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["short", "salt"])
    inside = (F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), "rule_host"))
    fits = met.where((F.col("digest") == F.col("rule_digest")) & inside & F.startswith("path", F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "rule", "verdict")).alias("_best")
    )
    joined = pages.join(best, ["host", "path"], "left")
    kept = [c for c in pages.columns if c not in OUT]
    return joined.select(
        *kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict")
    )
