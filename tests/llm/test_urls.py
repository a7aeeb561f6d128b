import re

import pytest
from pyspark.sql import functions as F

from weft.llm import urls
from weft.llm.queries import HOST_RULES, PAGE_RULES

URLS = [
    None, "", "no scheme", "http://", "http://example.org", "http://EXAMPLE.org/es/x", "https://a.example.org/en/12?q=1",
    "https://a.example.org/en/2", "https://x.com/fr/", "https://x.com/de/1#f", "https://x.com/login", "https://x.net/LOGIN?x",
    "https://x.net/search?a=1&q=2", "https://ad.doubleclick.net/x", "https://notdoubleclick.net/", "http://x.net/a://b.org/",
    "http://x.net\n/ads/", "http://org/",
]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", url)
    host = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in rules if re.search(r.regex(), host + m[2] + m[3])]
    won = max(fits, key=lambda r: (r.rank, len(r.name), r.name), default=None)
    return host, m[2], won and won.name, won.verdict if won else default


@pytest.mark.parametrize("inline", [True, False])
def test_like_trying_every_rule(spark, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(urls, "INLINE_RULES", 0)
    clash = ["_target", "_tokens", "_won", "target", "tokens", "won", "row", "asked", "token", "a.b"]
    rows = [(i, u, "x", "y", *clash) for i, u in enumerate([*URLS, *URLS[5:8]])]
    pages = spark.createDataFrame(rows, ", ".join(["page_id long, url string, host string, verdict string", *(f"`{c}` string" for c in clash)]))
    tokenless = [urls.Rule("many", "*in?x", "block"), urls.Rule("x", "x.n*", "block", 2)]
    for rules in (HOST_RULES + PAGE_RULES, HOST_RULES + tokenless, tokenless, []):
        got = urls.filter_urls(pages, rules)
        assert got.columns == ["page_id", "url", *clash, "host", "path", "rule", "verdict"]
        for r in got.collect():
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r
            assert [r[c] for c in clash] == clash
        assert got.count() == len(rows)


def test_rules_are_filed_under_whole_and_rare_tokens(spark):
    rule = urls.host_rule("example.org/en/1", "block")
    assert rule.tokens() == ["en", "example", "org"]  # "1" may go on
    assert urls.Rule("r", "*track*x", "block").tokens() == []
    pages = spark.createDataFrame([("http://a.org/en/",), ("http://b.org/en/",), ("http://example.org/",)], "url string")
    assert urls.rarest_tokens(pages, [rule]) == {"example": [0]}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(empty, HOST_RULES).count() == 0


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://x.com/fr/")], "page_id long, url string")
    plan = urls.filter_urls(pages, HOST_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Physical Plan")[-1]
    assert F is not None
