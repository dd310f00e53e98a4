import re

from copyloom.llm import url_filter
from copyloom.llm.queries import URL_RULES

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.NET/en/", "http://example.net/EN/1", "http://example.net",
    "http://net/", "http://notnet/", "http://x.example.com/de/5?q=1", "http://example.com/de", "http://example.com:80/de/",
    "http://w.org/fr/x#y", "http://w.org?/fr/", "ftp://a.net/b://c", "no scheme.net/", "", None, "://", "http://a.com/ü/" + "y" * 5000,
    "http://example.org/en/1", "http://example.org/en/1",
]


def plain(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule in URL_RULES:
        name, slash, tail = rule.where.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail):
            fits.append(rule)
    best = max(fits, key=lambda r: len(r.where), default=None)
    return host, path, best and best.where, best and best.verdict


def table(spark):
    return spark.createDataFrame(
        [(i, u, "h", "p", "r") for i, u in enumerate(URLS)],
        "page_id bigint, url string, host string, path string, rule string",
    )


def test_against_plain(spark):
    pages = table(spark)
    labelled = url_filter.labels_from_rules(pages, URL_RULES)
    assert {r.verdict for r in labelled.collect()} == {"allow", "block"}
    got = url_filter.judged(pages, URL_RULES, url_filter.fit(labelled)).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))


def test_the_model_tells_hosts_apart(spark):
    urls = [(f"http://{'spam' if i % 2 else 'news'}{i}.com/{'win' if i % 2 else 'read'}/{i}", "block" if i % 2 else "allow") for i in range(120)]
    model = url_filter.fit(spark.createDataFrame(urls, "url string, verdict string"))
    pages = spark.createDataFrame([(1, "http://spam999.com/win/7"), (2, "http://news998.com/read/8")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in url_filter.judged(pages, [], model).collect()} == {1: "block", 2: "allow"}


def test_few_labels_and_empty(spark):
    labelled = spark.createDataFrame([("http://a/", "block"), ("http://b/", None), (None, "block")], "url string, verdict string")
    assert url_filter.fit(labelled) == 1.0
    assert url_filter.fit(labelled.limit(0)) == 0.0
    assert url_filter.judged(table(spark).limit(0), URL_RULES, 0.0).collect() == []
    assert {r.verdict for r in url_filter.judged(table(spark), [], 1.0).collect()} == {"block"}


def test_the_sample_counts_different_urls(spark):
    hot = [("http://a.net/hot",)] * 3000
    few = [(f"http://example.com/de/{i}",) for i in range(20)] + [(f"http://example.net/en/{i}",) for i in range(20)]
    pages = spark.createDataFrame([*hot, *few, (None,)], "url string")
    got = [tuple(r) for r in url_filter.labels_from_rules(pages, URL_RULES, most=100).collect()]
    assert len(got) == len(set(got)) == 41 and {v for _, v in got} == {"allow", "block"}
