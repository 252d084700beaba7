"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding, html_text, language_id, mixing, packing, pitman_yor, quality, simhash, suffix_automaton, suffix_sort, threshold_search, token_alignment, url_rules
from .shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def packed_rows(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Weights of the registered mix; a name that is not listed has the weight of "*".
MIX_WEIGHTS = ({"d0": 2, "d1": 3, "*": 4}, {"en": 6, "de": 2, "fr": 2, "*": 1}, {"*": 1})
MIX_EPOCHS, MIX_SEED = 4, 17


def mix_levels() -> dict:
    """Domain (source number modulo 4), language, source."""
    number = F.regexp_extract("source", r"(\d{1,9})$", 1)
    domain = F.when(number.isNull() | (number == ""), F.lit("(none)")).otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))
    return {"domain": domain, "language": mixing.named("lang"), "origin": mixing.named("source")}


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), mix_levels(), MIX_WEIGHTS, None, MIX_EPOCHS, MIX_SEED)


def mix_sql(docs: str = "documents") -> str:
    """DuckDB: rows (doc_id, domain, language, origin, epoch, n_tokens, taken); the budgets level by level with brute-force windows."""
    level = """
    {n}0 AS (SELECT {keys}, sum(cap) AS cap, max({w}) AS w, max({b}) AS b FROM {src} WHERE cap > 0 GROUP BY {keys}),
    {n}1 AS (SELECT *, sum(cap) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w, {own}) - cap AS pre,
        sum(w) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w DESC, {own} DESC) AS rest FROM {n}0),
    {n}2 AS (SELECT {cols}, (SELECT min_by(struct_pack(l := o.b - o.pre, r := o.rest, at := o.cap::DOUBLE / o.w, nm := o.{own}), row(o.cap::DOUBLE / o.w, o.{own}))
        FROM {n}1 o WHERE o.cap * o.rest >= (o.b - o.pre) * o.w {same}) AS cut FROM {n}1 m),
    {n} AS (SELECT {src}.* EXCLUDE ({drop}), CASE WHEN cut IS NULL OR row(m.cap::DOUBLE / m.w, m.{own}) < row(cut.at, cut.nm) THEN m.cap ELSE least(m.cap, (cut.l * m.w) // cut.r) END AS {out}
        FROM {src} JOIN {n}2 m USING ({keys}))"""
    case = lambda col, w: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in w.items() if k != "*") + (" ELSE " if len(w) > 1 else "WHEN true THEN ") + f"{w['*']} END"
    w1, w2, w3 = (case(c, w) for c, w in zip(("domain", "language", "origin"), MIX_WEIGHTS))
    steps = [
        level.format(n="a", keys="domain", w="w1", b="total", src="base", parent="1", own="domain", cols="domain, cap, w, b", same="", drop="total", out="b1"),
        level.format(n="b", keys="domain, language", w="w2", b="b1", src="a", parent="domain", own="language", cols="domain, language, cap, w, b", same="AND o.domain = m.domain", drop="b1", out="b2"),
        level.format(n="c", keys="domain, language, origin", w="w3", b="b2", src="b", parent="domain, language", own="origin", cols="domain, language, origin, cap, w, b", same="AND o.domain = m.domain AND o.language = m.language", drop="b2", out="b3"),
    ]
    return f"""
WITH slim AS (SELECT doc_id, CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' THEN '(none)' ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) END AS domain,
        coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS origin,
        len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    held AS (SELECT * FROM slim WHERE n > 0),
    leaf AS (SELECT domain, language, origin, sum(n)::BIGINT AS tokens, sum(n)::BIGINT * {MIX_EPOCHS} AS cap, {w1} AS w1, {w2} AS w2, {w3} AS w3 FROM held GROUP BY ALL),
    base AS (SELECT *, least(sum(tokens) OVER (), sum(cap) OVER ())::BIGINT AS total FROM leaf),
    {",".join(steps)},
    budget AS (SELECT domain, language, origin, tokens, b3::BIGINT // tokens AS whole, b3::BIGINT % tokens AS rest FROM c),
    ordered AS (SELECT held.*, whole, rest, coalesce(sum(n) OVER (PARTITION BY domain, language, origin ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM held JOIN budget USING (domain, language, origin)),
    taken AS (SELECT doc_id, domain, language, origin, n, whole, unnest(range(whole + CASE WHEN start < rest THEN 1 ELSE 0 END)) AS epoch, least(n, rest - start) AS part FROM ordered)
SELECT doc_id, domain, language, origin, epoch::BIGINT AS epoch, n::BIGINT AS n_tokens, CASE WHEN epoch = whole THEN part ELSE n END::BIGINT AS taken FROM taken"""


ORACLES["op9_mixing"] = mix_sql()


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir))


def _digest(left: DataFrame, size: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return left.select("doc_id", F.col("n_units").alias(size), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(suffix_automaton.drop_repeated_words(documents(spark, sf_dir)), "n_words")


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(suffix_sort.drop_repeated_bytes(documents(spark, sf_dir)), "n_bytes")


@query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _crc(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), _crc("doc_id", 3) == 1)


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir), _crc("doc_id", 7) == 2)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(number.alias("id"), label.cast("long").alias("label"), threshold_search.whole_vectors(vectors, "embedding", 256).alias("vector"))
    return threshold_search.mine(rows, F.col("id") % 50 == 0)


ORACLES["op11_hard_negatives"] = """
WITH taking AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS own, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM taking a JOIN taking b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
    positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))[0]


#: The registered rules: verdict, host and path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rule_table(spark, URL_RULES)).drop("url")


ORACLES["op12_url_filters"] = f"""
WITH rules(verdict, rule) AS (VALUES {", ".join(map(str, URL_RULES))}),
    rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    fits AS (SELECT n, max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) AS best FROM parts JOIN rules
        ON ('.' || host).ends_with('.' || split_part(rule, '/', 1)) AND path.starts_with(rule[instr(rule, '/'):]) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)"""


def repeats_sql(words: bool) -> str:
    """DuckDB: every window spelled out and ranked by where it starts; what a later equal covers goes."""
    if words:
        size, length, split, join = "n_words", 20, "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')", "string_agg(unit, ' ' ORDER BY place)"
        cut = f"array_to_string(units[k + 1 : k + {length}], ' ')"
    else:
        size, length, split, join = "n_bytes", 100, "hex(encode(coalesce(text, '')))", "string_agg(unit, '' ORDER BY place)"
        cut = f"substr(units, 2 * k + 1, {2 * length})"
    count = "len(units)" if words else "len(units) // 2"
    unit = "units[k + 1]" if words else "substr(units, 2 * k + 1, 2)"
    digest = f"sha256(coalesce({join}, ''))" if words else f"sha256(unhex(coalesce({join}, '')))"
    return f"""
WITH texts AS (SELECT doc_id, {split} AS units FROM documents),
    sized AS (SELECT doc_id, units, {count}::BIGINT AS n FROM texts),
    windows AS (SELECT doc_id, unnest(range(n - {length - 1})) AS place, unnest(list_transform(range(n - {length - 1}), lambda k: {cut})) AS content FROM sized WHERE n >= {length}),
    later AS (SELECT doc_id, place FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, place) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + {length})) AS place FROM later),
    spans AS (SELECT doc_id, count(*)::BIGINT AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < place - 1)::BIGINT AS n_spans
        FROM (SELECT doc_id, place, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM gone) GROUP BY doc_id),
    parts AS (SELECT doc_id, unnest(range(n)) AS place, unnest(list_transform(range(n), lambda k: {unit})) AS unit FROM sized),
    kept AS (SELECT doc_id, {digest} AS kept_sha256 FROM parts ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, n AS {size}, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM sized LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""


ORACLES["op1_substring_dedup"] = repeats_sql(True)
ORACLES["op4_suffix_array_dedup"] = repeats_sql(False)
ORACLES["op7_embedding_near_dedup"] = """
WITH RECURSIVE usable AS (
        SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm FROM embeddings
        WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
        AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (a.norm * b.norm) >= 0.93),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    roots AS (SELECT a AS vec_id, least(a, min(b)) AS root FROM reach GROUP BY a),
    degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(vec_id = coalesce(root, vec_id), false) AS kept
FROM embeddings LEFT JOIN degree USING (vec_id) LEFT JOIN roots USING (vec_id)"""
