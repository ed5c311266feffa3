from tabloom.llm.url_filters import RULES, judge_urls, split_url

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "https://notexample.org/es/", "http://x.com/fr/?a", "http://com/de/1",
    "http://b.com/DE/", "http://org", "http://a.org/", "http://a.org?x://y", "ftp://u@h.com:80/fr/", "x://y://z/fr/", "http://example.org./es/", "http://a..org/", "http://ÉX.org/", "http://a.com/fr/\n?q", "a" * 50_000 + "://b.org/" + "c" * 50_000,
]


def plain(url, rules=RULES, default="allow"):
    host, path = split_url(url)
    fit = [(len(h) + len(p), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


def test_every_rule_against_a_plain_scan(spark):
    urls = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string, rank string")
    want = {i: plain(u) for i, u in enumerate([*URLS, URLS[4]])}
    for most in (1 << 20, 10):  # one trie, and one for each rule
        got = judge_urls(urls, RULES, most=most).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
        assert {r["rank"] for r in got} == {"d"}


def test_block_wins_over_an_equal_allow_and_default(spark):
    rules = [("allow", "a.org", "/x"), ("block", "a.org", "/x")]
    urls = spark.createDataFrame([("http://a.org/xy",), ("http://b.org/",)], "url string")
    assert [r.verdict for r in judge_urls(urls, rules, default="block").collect()] == ["block", "block"]
    assert judge_urls(urls.where("false"), rules).collect() == []
    assert {r.verdict for r in judge_urls(urls, []).collect()} == {"allow"}


def test_columns_of_any_name_stay(spark):
    urls = spark.createDataFrame([(1, "http://b.com/de/x", "a", "b", "c", "d", "e")], "page_id long, `the.url` string, _fit string, `a.b` string, row string, fit string, rule string")
    row = judge_urls(urls, RULES, url="the.url").collect()[0]
    assert row.asDict() == {"page_id": 1, "the.url": "http://b.com/de/x", "_fit": "a", "a.b": "b", "row": "c", "fit": "d", "host": "b.com", "path": "/de/x", "rule": "com/de/", "verdict": "block"}
