import re

import pytest

from sparkrank.llm import url_filter
from sparkrank.llm.queries import URL_RULES
from sparkrank.llm.url_filter import build_cascade, filter_urls


def brute(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, otherwise)))


URLS = ["http://www.Example.COM/en/x?y", "https://example.com/en", "https://example.com/en/", "http://notexample.com/en/1", "x://a.net/es/1#z", "http://net/fr/q", "http://net/FR/", "http://a.com", "http://a.com/", "http://com/", "no scheme", "", None, "http:///en/", "http://É.net/fr/", "a://b://c.com/d", "http://u:p@a.com:80/x", "http://.com/", "http://a..net/fr/", "http://a.com?x=/", "http://a.com#/"]


def test_rules(spark):
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(frame, URL_RULES).collect()}
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}
    assert filter_urls(frame.where("false"), URL_RULES).count() == 0
    assert {r.verdict for r in filter_urls(frame, [], otherwise="block").collect()} == {"block"}
    with pytest.raises(ValueError):
        filter_urls(frame, [("allow", "a", "/"), ("block", "a", "/")])


def test_cascade_is_exact(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    listed = keys.where("xxhash64(key) % 7 = 0")
    n = listed.count()
    cascade = build_cascade(listed, keys, n, 5000)
    assert len(cascade.levels) > 1
    inside = keys.where(cascade.contains(keys.key))
    assert inside.count() == n and inside.join(listed, "key", "left_anti").count() == 0


def test_levels_do_not_grow_with_the_universe(spark):
    """With 200 listed keys the second level stays of the list's order while the universe grows tenfold."""
    sizes = []
    for n in (20_000, 200_000):
        keys = spark.range(n).selectExpr("concat('k', id) AS key")
        listed = keys.where("key in ({})".format(",".join(f"'k{i * 97}'" for i in range(200))))
        cascade = build_cascade(listed, keys, 200, n)
        assert keys.where(cascade.contains(keys.key)).count() == 200
        sizes.append([len(b.words) for b in cascade.levels])
    assert all(sum(s[1:]) < 40 for s in sizes) and sizes[1][0] < 2 * sizes[0][0], sizes


def test_rules_beyond_the_plan_and_very_long_urls(spark, monkeypatch):
    urls = [*URLS, "http://" + "a." * 3000 + "net/fr/" + "x" * 100_000, "http://a.net/es/" + "y/" * 20_000] * 2
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    want = {i: brute(u, URL_RULES) for i, u in enumerate(urls)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(frame, URL_RULES).collect()} == want
    monkeypatch.setattr(url_filter, "MOST_RULES", 2)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(frame, URL_RULES).collect()} == want
