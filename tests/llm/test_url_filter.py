import random
import time

import pytest
from pyspark.sql import functions as F

from spotweave.llm import queries, url_filter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:k].translate(UPPER), rest[k:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h), len(p), h, p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else "allow"


def urls(seed, count):
    r = random.Random(seed)
    hosts = ["example.com", "WWW.Example.COM", "a.example.com", "www.example.com.", "x.net", "net", "b.x.net", "notexample.com", "com", "ex.org", "com.net", "", ".com", "a..com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/es/1?q=/en/", "/fr/#f", "?x=/en/", "#a", "/é/en/"]
    return [r.choice(["http", "ftp", ""]) + "://" + r.choice(hosts) + r.choice(paths) for _ in range(count)]


ODD = [None, "", "no scheme/en/", "://", "http://a://b.com/en/", "x\nhttp://example.com/en/\ny", "http://example.com/" + "en/" * 5000, "http://" + "a." * 300 + "net/fr/z"]


@pytest.mark.parametrize("limit", [None, 0])
def test_verdicts_match_brute_force(spark, monkeypatch, limit):
    if limit is not None:  # rules looked up by shuffle
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rows = list(enumerate(urls(3, 300) + ODD)) + [(5, "http://example.com/en/"), (5, "http://example.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("short", F.lit("k")).withColumn("best", F.lit(2)).repartition(3)
    rules = [*queries.URL_RULES, ("", "", "block"), (None, "/", "block"), ("com", None, "block")]
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()), key=str)
    assert got == sorted(((i, *brute(u, queries.URL_RULES)) for i, u in rows), key=str)


def test_of_equal_rules_block_wins_and_no_rules_allow(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    rules = lambda *r: spark.createDataFrame(list(r), "host string, path string, action string")
    assert url_filter.judge_urls(pages, rules(("b", "/", "allow"), ("B", "/", "block"))).first()["verdict"] == "block"
    assert tuple(url_filter.judge_urls(pages, rules()).first()) == (1, "a.b", "/", None, "allow")


def test_empty_table(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []


def test_hosts_and_paths_of_any_length_cost_their_length(spark):
    long = "http://" + "a." * 20_000
    rows = [(1, long + "net/fr/x"), (2, long + "org/fr/x"), (3, "http://www.example.com/en/" + "y/" * 200_000), (4, "http://" + "." * 20_000 + "com/"), (5, "http://" + "a" * 50_000 + ".net/es/")]
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    judged = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules)
    judged.count()
    start = time.monotonic()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
    assert time.monotonic() - start < 10  # every suffix of the first two hosts would be 400 MB each
    assert got == {i: brute(u, queries.URL_RULES) for i, u in rows}
