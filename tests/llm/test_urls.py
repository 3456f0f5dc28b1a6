"""URL filters against a plain loop over the rules."""

import pytest

from territory_engine.llm import urls as U

URLS = [None, "", "no scheme", "http://", "http:///net/", "http://NET/", "http://a.net", "http://a.net/", "https://x.Example.NET/en/5?q#f",
        "http://example.com/de/1", "http://notexample.com/de/1", "http://example.com/de", "ftp://m.example.org/fr/", "http://org/fr/x",
        "http://a.net?x=/", "http://a.net#y/", "http://a..net/", "http://.net/", "http://user@a.net:80/", "x://y://z.net/", "http://é.net/\n/x",
        "http://deep.a.b.c.example.net/en//x/", "HTTP://EXAMPLE.NET/EN/1", "http://example.net/en/" + "a/" * 300, "http://example.net/de/"]


def plain(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), a, h, p) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3] + best[4], best[2] if best else default


@pytest.mark.parametrize("rules", [U.RULES, [("net", "/e", "allow"), ("example.net", "", "block"), ("a.net", "", "allow"), ("a.net", "", "block"),
                                             ("", "/", "block"), ("com", "/de/1", "block"), ("net", "/en/a/a/a", "allow")]])
def test_verdicts_equal_a_plain_loop(spark, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:3] + [None])] + [(None, URLS[9], "x")], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules + [rules[0], (None, "/", "block")], "host string, path string, action string")
    got = sorted(map(str, U.judge(pages, table).select("page_id", "host", "path", "rule", "verdict").collect()))
    want = [(r["page_id"], *plain(r["url"], rules, U.DEFAULT)) for r in pages.collect()]
    assert got == sorted(str(U.judge(pages, table).select("page_id", "host", "path", "rule", "verdict").collect()[0].__class__(
        page_id=a, host=b, path=c, rule=d, verdict=e)) for a, b, c, d, e in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, action string")
    assert U.judge(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert U.judge(one, rules.limit(0)).first()["verdict"] == U.DEFAULT


def test_a_url_of_a_megabyte(spark):
    rows = [(1, "http://a.example.net/en/" + "b/" * 500_000), (2, "http://" + "c." * 500_000 + "net/x"), (3, "http://example.net/en/" + "d" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, action string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages, rules).select("page_id", "rule", "verdict").collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("example.net/en/", "allow")}
