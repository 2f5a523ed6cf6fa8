import re

import pytest

from tessera.llm import urls as U

URLS = [None, "", "no scheme", "http://example.org", "http://example.org/", "https://WWW.Example.ORG/es/x?y#z", "http://example.org/ES/", "http://notexample.org/es/",
        "http://example.org/en/1", "http://example.org/en/12345.html", "http://example.org/en/2", "http://example.com/de/", "http://a.b.com/fr/x", "http://com/fr/",
        "http://example.net/ads/1", "http://ads.example.net/", "http://example.org/ads/x", "http://x.net?a=b://c/ads/", "ftp://example.org:80/es/", "://org/", "http:///org/",
        "http://example.org/es/" + "a" * 50_000, "http://x.net/login", "http://x.net/loginx", "http://x.net/a\nb/ads/", "http://example.com/de/", "http://xn--é.org/é"]
PLACES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in PLACES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[1:]
    blocked = url and any(re.search(r.regex, url.lower()) for r in U.PATTERN_RULES)
    return host, path, None, "block" if blocked else "allow"


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_verdicts_against_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", broadcast)
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id bigint, url string").selectExpr("*", "1 as token", "2 as verdict", "3 as host", "'p' as place")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(spark, pages).collect()}
    assert got == {k: brute(u) for k, u in enumerate(URLS)}


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://example.org/es/1",), ("http://example.org/x",), ("http://shop.org/es/",)], "url string")
    index = {r["name"]: r["token"] for r in U.rule_index(spark, pages, U.PLACE_RULES).collect()}
    assert index["org/"] == "org" and index["example.org/es/"] == "es" or index["example.org/es/"] == "example"
    assert index["com/de/"] in ("com", "de")


def test_rule_without_literal_meets_every_url(spark):
    rules = [U.pattern_rule("digits", r"[0-9]{5}")]
    pages = spark.createDataFrame([(1, "http://a/12345"), (2, "http://a/1")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in U.judge(spark, pages, rules=rules).collect()} == {1: "block", 2: "allow"}


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a/12345")], "page_id bigint, url string")
    plan = U.judge(spark, pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert U.judge(spark, spark.createDataFrame([], "page_id bigint, url string")).count() == 0
