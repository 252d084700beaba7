import random
import re

import pytest

from tickerloom.llm import queries, url_rules

ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com", "http://example.com/", "http://example.com/en", "http://example.com/en/",
    "http://notexample.com/en/x", "http://a.b.example.com/en/x?y#z", "http://example.com:80/en/x", "http://example.com./en/", "http://x.net/es/1", "http://x.net/es", "https://net/fr/",
    "http://x.net?/es/", "http://x.net#/es/", "a://b://c.com/", "http://..com/", "http://É.com/\n/x", "http://x.com/" + "a/" * 3000, "http://" + "a." * 3000 + "com/en/", "x" * 100000 + "://com/",
    "http://x.com/ééé/", "http://user@www.example.com/en/2", "http://www.example.com/en/?q", "http://com/", "//com/",
]


def plain(url, rules, otherwise="allow"):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, otherwise)))


def split(rules):
    return [(t.partition("/")[0], "/" + t.partition("/")[2], v) for v, t in rules]


def test_query(spark, tmp_path):
    rows = [(i if i % 7 else None, u, "h") for i, u in enumerate(ODD + ODD[5:9])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.QUERIES["op12_url_filters"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    want = [(i, *plain(u, split(queries.URL_RULES))) for i, u, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("sent", [0, 10_000])
def test_many_rules(spark, sent):
    rng = random.Random(3)
    hosts = [".".join(rng.choice(["a", "b", "com", "net", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    paths = ["/".join(["", *(rng.choice(["en", "e", "", "x.html"]) for _ in range(rng.randint(0, 4)))]) for _ in range(40)]
    rules = [(rng.choice(hosts), rng.choice(["", *paths, "/e", "/en/x"]), rng.choice(["allow", "block"])) for _ in range(300)] + [("", "/en", "block"), ("com", "", "allow")]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, table, most_sent=sent).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_awkward_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.com/a", "mine", 5)] * 2, "page_id long, url string, rule string, host int")
    rules = url_rules.rule_table(spark, [("block", "com/")])
    got = url_rules.judge(pages, rules)
    assert [(r.page_id, r.host, r.rule, r.verdict) for r in got.collect()] == [(1, "x.com", "com/", "block")] * 2
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0), otherwise="block").collect()} == {"block"}


def test_expressions_meet_by_short_hash(spark):
    pages = spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string")
    plan = url_rules.judge(pages, url_rules.rule_table(spark, [("block", "com/")]), most_sent=0)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(.*\(short#\d+ = short#\d+\).*salt#", plan) and "Cartesian" not in plan
